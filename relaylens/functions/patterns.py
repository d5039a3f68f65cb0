"""Fixed values of the mail-log format.

Everything in this module must equal the values the log format and the
original agent use; results depend on them verbatim.  They are listed
plainly, in natural order, and nowhere else in the package.
"""

# --- FIXED VALUES: log line shapes ------------------------------------------
# Each pattern must match the *whole* line; the first matching kind wins, in
# this order: A (delivery attempt), M (message-id), C (client-id header),
# E (expired), R (queue removed).  Group numbers are used by ``parse_lines``.
ATTEMPT_RE = (
    r"^(\d{4} [a-zA-Z]+ \d{1,2} \d{2}:\d{2}:\d{2}.\d{3}).*?([a-zA-Z0-9]{15}): "
    r"to=<(.*?@.*?)>.*?status=(sent|deferred|bounced) \((.*)\)$"
)
MESSAGE_ID_RE = r"^.*?: ([a-zA-Z0-9]{15}): message-id=(.*?)$"
CLIENT_ID_RE = r"^.*?: ([a-zA-Z0-9]{15}): info: header client-id: (.*?) .*$"
EXPIRED_RE = (
    r"^(\d{4} [a-zA-Z]+ \d{1,2} \d{2}:\d{2}:\d{2}.\d{3}).*?([a-zA-Z0-9]{15}): "
    r"from=<(.*?@.*?)>.*?status=(expired), (.*)$"
)
REMOVED_RE = r"^.*?: ([a-zA-Z0-9]{15}): removed$"

# Compound message id written by registered mail clients:
# "<" + 98494 + "." + id + "." + random + "@" + clientId + ">", where 98494 is
# the Java string hash of "cid".  msg_id becomes "98494.{id}.{rnd}".
COMPOUND_MSG_ID_RE = r"^<(98494\..+)@(.+)>$"

# Line dates: year, English month name (short or full, any case), day, time with milliseconds.  Numbers
# beyond their range run over into the next larger unit (day 31 of a month of 30 is the next month's first).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December")
LOG_DATE_RE = r"^(\d{4}) ([a-zA-Z]+) (\d{1,2}) (\d{2}):(\d{2}):(\d{2})\.(\d{3})$"

LINE_DATE_RE = r"^(\d{4} [a-zA-Z]+ \d{1,2} \d{2}:\d{2}:\d{2}\.\d{3})"  # at the start of any line

# --- FIXED VALUES: delivery record constants ---------------------------------
SENDER_UNKNOWN = "unknown"
STATE_SOFT, STATE_HARD, STATE_UNKNOWN, STATE_OK, STATE_FINALLY_OK = 0, 1, 2, 3, 4
INFO_FINALLY_OK = "finally OK"
INFO_OK = "OK"
INFO_EXPIRED = "expired, returned to sender"
INFO_UNDECIDED = "unable to decide on type of bounce"

# --- FIXED VALUES: log file selection ----------------------------------------
ROTATED_FILE_PATTERN = r"mail\.log\.(\d{1,3}).*"
LIVE_FILE_NAME = "mail.log"
MAX_MB_TO_INDEX = 1000  # the original's default; here a budget applies only if it is asked for
MIN_FILE_BYTES = 10
COMPRESSED_SIZE_FACTOR = 10  # ".gz"/"tar" files count ten times their size
