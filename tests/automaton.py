"""Sequential reference automaton for tests: one pass over parsed lines in
file order, exactly as the original agent's per-queue state machine."""


def diagnostics(parsed_rows):
    """(position, reason) for duplicate message-ids, client-ids without a
    queue and expiries that were never deferred."""
    q, out = {}, []
    for i, r in enumerate(parsed_rows):
        k, qid = r["kind"], r["queue_id"]
        cur = q.get(qid)
        if k == "M":
            if cur is not None:
                out.append((i, "duplicate message-id"))
            q[qid] = [r["client_id"], False, None]
        elif k == "C":
            if cur is None:
                out.append((i, "client-id without queue"))
            elif cur[0] is None:
                cur[0] = r["client_id"]
        elif k in ("A", "E"):
            if cur is None:
                continue
            if cur[0] is None:
                del q[qid]
                continue
            if k == "A" and r["status"] == "deferred" and not cur[1]:
                cur[1], cur[2] = True, r["rcpt_email"]
            if k == "E" and not cur[1]:
                out.append((i, "expired, never deferred"))
        elif k == "R":
            q.pop(qid, None)
    return out


def run(parsed_rows, seed=None):
    """parsed_rows: dicts with kind, queue_id, event_ms, rcpt_email, sender_email,
    status, info, msg_id, client_id, ordered by file position.
    Returns (records, open_queues dict)."""
    q = {}
    for s in seed or []:
        q[s["queue_id"]] = [s["msg_id"], s["client_id"], s["rcpt_email"], bool(s["has_been_deferred"])]
    out = []
    for r in parsed_rows:
        k, qid = r["kind"], r["queue_id"]
        cur = q.get(qid)
        if k == "M":
            q[qid] = [r["msg_id"], r["client_id"], None, False]
        elif k == "C":
            if cur is not None and cur[1] is None:
                cur[1] = r["client_id"]
        elif k == "A":
            if cur is None:
                continue
            if cur[1] is None:
                del q[qid]
                continue
            deferred_before = cur[3]
            if r["status"] == "deferred" and (cur[2] is None or not cur[3]):
                cur[2], cur[3] = r["rcpt_email"], True
            out.append((cur[1], r["event_ms"], qid, cur[0], r["rcpt_email"], "unknown", r["status"], r["info"],
                        deferred_before))
        elif k == "E":
            if cur is None:
                continue
            if cur[1] is None:
                del q[qid]
                continue
            if cur[3] and cur[2] is not None:
                out.append((cur[1], r["event_ms"], qid, cur[0], cur[2], r["sender_email"], r["status"], r["info"],
                            True))
        elif k == "R":
            q.pop(qid, None)
    return out, q
