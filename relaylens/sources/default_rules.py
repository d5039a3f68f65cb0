"""The shipped bounce-rule list.

FIXED VALUES: the default classification rules, in document order
(type, category, alternatives).  Patterns are kept exactly as written,
including the ``(:?`` groups and the empty alternative; classification
results depend on them verbatim.  Users normally load their own list with
``load_bounce_rules``; ``write_rules_xml`` writes this list in that format.
"""

DEFAULT_RULES = [
    ("soft", "try again", [
        "try.*later",
        "connection.*lost",
        "lost.*connection",
        "cannot deliver to this user at this time",
        "(:?temporarily|temporary).*(:?deferred|error|unavailable)",
        "(:?problem|zkuste pozdeji|temporary|temporarily|insufficient system storage)",
        "450 |451 |400 ",
    ]),
    ("soft", "bad domain: connection timeout", [
        "connection timed out|session timeout exceeded|timed out while|timeout waiting for client input",
    ]),
    ("soft", "mailbox is full", [
        "552 ",
        "(:?mailbox|schranka|full|over|exceeded).*(:?preplnena|exceeded|mailbox|quota|full|storage)",
    ]),
    ("soft", "access forbidden", [
        "(:?denied|ip address|overeni|refused|access forbidden).*(:?|ip |blocked)",
        "refused to talk to me|not our customer",
    ]),
    ("soft", "bad domain/command: connection refused", [
        "connection.*refused",
        "syntax error in parameters or arguments",
        "command not allowed",
    ]),
    ("soft", "bad domain: host/domain not found", [
        "(:?host|domain).*(:?not found|disabled)",
    ]),
    ("soft", "relay denied", [
        "(:?relay|access|relaying|relay access).*(:?denied|not permitted|not allowed)",
        "(:?we do not|unable to|isn't allowed).*(:?relay|relayed)",
    ]),
    ("soft", "network unreachable", [
        "network.*unreachable",
        "no route to host",
        "(:?unrouteable|unroutable).*(:?address|host)",
    ]),
    ("soft", "Sender Policy Framework", [
        "sender policy framework|spf|intrusion prevention",
    ]),
    ("soft", "violation", [
        "(:?too many|too much).*(:?connections|mail|send|recipients)",
        "connection limit exceeded",
        "one recipient domain per session",
    ]),
    ("soft", "service unavailable", [
        "service.*(:?unavailable|not available)",
        "internal error|try that server first|local error in processing|insufficient system resources|system failure",
    ]),
    ("soft", "policy breach", [
        "(:?rejected|denied|policy).*(:?policy|violation)",
    ]),
    ("soft", "greylisting", [
        "(:?greylisting|graylisted|greylisted|graylisting)",
    ]),
    ("soft", "dns problem", [
        "(:?dns|name service).*(:?timeout|error)",
    ]),
    ("soft", "message content, size or other validations and rules", [
        "(:?content|message|rules).*(:?rejection|rejected|refused|size exceeds)",
    ]),
    ("soft", "uncategorized or provider specific", [
        "loops back to myself|bad address syntax",
    ]),
    ("soft", "error on other side", [
        "alias expansion.*error",
        "unable to figure out my ip addresses",
        "unable to accept message",
    ]),
    ("hard", "mailbox not found, is inactive, disabled or does not exist", [
        "(:?mailbox|address|user|account|recipient|@).*(:?rejected|unknown|disabled|unavailable|invalid|inactive|not exist)",
        "(:?rejected|unknown|unavailable|no|illegal|invalid|no such).*(:?mailbox|address|user|account|recipient|alias)",
        "(:?address|user|recipient) does(n't| not) have .*(:?mailbox|account)",
        "550 |553 |501 ",
    ]),
    ("hard", "spam detection and blacklisting", [
        "(:?spam|unsolicited|blacklisting|blacklisted|blacklist|554 )",
    ]),
    ("hard", "expired, returned to sender", [
        "returned to sender",
    ]),
    ("hard", "authentication required", [
        "(:?auth).*(:?required)",
    ]),
]
