"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

RAW_LINES = T.StructType([
    T.StructField("file", S), T.StructField("rotation", I), T.StructField("block_start", L),
    T.StructField("line_seq", L), T.StructField("line", S),
])

OPEN_QUEUES = T.StructType([
    T.StructField("queue_id", S), T.StructField("msg_id", S), T.StructField("client_id", S),
    T.StructField("rcpt_email", S), T.StructField("has_been_deferred", B), T.StructField("last_ms", L),
])

DELIVERY_COLUMNS = [
    "client_id", "date_ms", "date", "queue_id", "msg_id", "rcpt_email", "sender_email",
    "status", "info", "state", "state_info", "day", "source_file",
]

# the nine fields of a delivery record, plus its client: set identity
RECORD_KEY = [
    "client_id", "date_ms", "queue_id", "msg_id", "rcpt_email", "sender_email",
    "status", "info", "state", "state_info",
]

# the same fields in the order used for de-duplication: a sort-based
# aggregate compares an 8-byte prefix of the first key, which date_ms makes
# nearly unique
DEDUP_ORDER = [
    "date_ms", "queue_id", "client_id", "rcpt_email", "msg_id", "status", "state", "info",
    "sender_email", "state_info",
]

# the index table as it is stored; client_id is taken from client_key
DELIVERIES = ("date_ms long, date timestamp, queue_id string, msg_id string, rcpt_email string, sender_email string, "
              "status string, info string, state int, state_info string, source_file string, run long, client_key string, day date")

# what a run looked at: of each file the first line's md5, size, the last bytes' md5 and the time of its last change (to know
# an unchanged file without reading it), whether its last line was held back, the number of lines taken in by this or
# an earlier run and their fingerprint, and how many of them this run took
INGESTED_FILES = T.StructType([
    T.StructField("file", S), T.StructField("digest", S), T.StructField("size_bytes", L), T.StructField("tail", S),
    T.StructField("modified", T.TimestampType()), T.StructField("held", B),
    T.StructField("lines", L), T.StructField("fingerprint", S), T.StructField("taken", L), T.StructField("rows", L),
    T.StructField("ingested_at", T.TimestampType()),
])

# files that a run did not take in, or not wholly, and why
SKIPPED_FILES = T.StructType([
    T.StructField("file", S), T.StructField("size_bytes", L), T.StructField("reason", S),
])
