"""Operator 12: spelling variants grouped through a variable-length gram index.

Words come from whole texts: runs of letters, a few of them with a letter lost by a fixed rule, counted over
all documents.  Two words are near if one inserted, deleted or replaced code point makes one of the other.

1. Gram dictionary: all bigrams, and longer grams (up to ``LONGEST``) whose prefix is more frequent than a
   bound and which are not rare themselves.  The bound rises with the vocabulary, so the dictionary has at
   most ``8 * DICTIONARY`` grams of each length and can go to every task.
2. Decomposition: at each place of the padded word the longest gram of the dictionary, without those that lie
   inside an earlier one.
3. Affected grams: for every possible edit the grams are counted that contain it, or that a gram
   reaching over the edit could swallow.  All but the worst such number survive any one edit, so near words
   share at least that many; hence they share one of each word's rarest ``affected + 1`` grams, at a place
   that differs as one edit allows.  Words whose bound is 0 get fixed bigrams besides, whose bound never is.
4. List merging: words meet in the list of a gram, its place and the word's length.  Lists with more than
   ``LIST`` rows are split by the half of the word that an edit leaves as it is, left or right: no near pair is lost.
5. Pairs that meet are verified by their edit distance.

Cases: null and empty texts have no words; a null document id counts as ``null`` in the hash's input; very long texts
are read whole; repeated rows count each time; among near words of equal count the least in code point order
is the form; words of equal or too similar counts are no form; an empty table, or one without frequent
words, gives no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RARE = 199  # a run whose hash this divides loses a code point
SHORTEST, LEAST = 6, 5  # code points and occurrences of a word
RATIO = 5  # a form is at least so many times as frequent
LONGEST = 5  # code points of a gram
EXTEND = 64  # a gram with more occurrences is extended
DICTIONARY = 1 << 15
LIST = 64
WORDS_A_TASK = 50_000
HELD = 400_000  # different words that a task holds before it passes them on
_OPEN, _CLOSE, _FIXED = "\x01", "\x02", "\x03"


def _letters() -> bytes:
    """Letters of Latin-1 by code point, A-Z in lower case; everything else is a space."""
    table = bytearray(b" " * 256)
    table[0xC0:] = range(0xC0, 0x100)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return bytes(table)


_LETTERS = _letters()


def runs(text: str | None) -> Counter:
    """Runs of letters as Latin-1 bytes, with their number in the text."""
    return Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split())


def altered(run: bytes, seed: int, rare: int = RARE) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % rare:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, rare: int = RARE, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n of all words that are long and frequent enough."""
    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in runs(text).items():
                    if len(run) >= shortest:
                        held[altered(run, seed, rare)] += n
                if len(held) > HELD:
                    yield frame(held)
                    held.clear()
        if held:
            yield frame(held)

    def frame(held):
        kept = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= shortest]
        return pd.DataFrame(kept, columns=["word", "n"])

    ids = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text")
    counted = ids.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Grams:
    """A gram dictionary: how often each gram begins a piece, and what longer grams begin and end with."""

    def __init__(self, counts: dict[str, int]):
        self.long = {g for g in counts if len(g) > 2}
        self.longest = max(map(len, self.long), default=2)
        self.begins = {g[:k] for g in self.long for k in range(2, len(g))}
        self.ends = {g[-k:] for g in self.long for k in range(2, len(g))}
        self.rank = dict(counts)
        for g in self.long:  # a longer gram stands for its prefix where both begin
            self.rank[g[:-1]] = self.rank.get(g[:-1], 0) - counts[g]

    def pieces(self, s: str) -> list[tuple[int, int]]:
        """First and last place of the grams of a padded word."""
        out, last = [], -1
        for a in range(len(s) - 1):
            b = a + 1
            for q in range(min(self.longest, len(s) - a), 2, -1):
                if s[a:a + q] in self.long:
                    b = a + q - 1
                    break
            if b > last:
                out.append((a, b))
                last = b
        return out

    def affected(self, s: str, pieces: list[tuple[int, int]]) -> int:
        """At most so many grams of the word are lost by one edit, wherever it is."""
        worst = 0
        for i in range(1, len(s)):
            # to the left, from the first place at which a gram could reach the edit
            reach = i
            for j in range(max(0, i - self.longest + 1), i - 1):
                if s[j:i] in self.begins:
                    reach = j
                    break
            left = sum(1 for a, b in pieces if b < i and a >= reach)
            for first in (i, i + 1):  # the first code point after an insertion before i, after a change of i
                if first > i and i == len(s) - 1:
                    continue
                swallowed = -1
                for e in range(min(len(s) - 1, first + self.longest - 2), first, -1):
                    if s[first:e + 1] in self.ends:
                        swallowed = e
                        break
                over = sum(1 for a, b in pieces if a < first and b >= i)
                worst = max(worst, left + over + sum(1 for a, b in pieces if first <= a and b <= swallowed))
        return worst

    def signature(self, word: str) -> tuple[list[str], list[int]]:
        """Grams and places by which the word meets its near words."""
        s = _OPEN + word + _CLOSE
        pieces = self.pieces(s)
        affected = self.affected(s, pieces)
        found = sorted((self.rank.get(s[a:b + 1], 0), s[a:b + 1], a) for a, b in pieces)[:affected + 1]
        if len(pieces) <= affected:
            # bigrams alone: an edit takes two of them at most
            found += sorted((self.rank.get(s[a:a + 2], 0), _FIXED + s[a:a + 2], a) for a in range(len(s) - 1))[:3]
        return [g for _, g, _ in found], [a for _, _, a in found]


def dictionary(words: DataFrame, n_words: int, extend: int = EXTEND) -> dict[str, int]:
    """Grams with their counts in the words: all bigrams, and frequent longer ones (a bounded number)."""
    padded = F.concat(F.lit(_OPEN), "word", F.lit(_CLOSE))
    starts = F.sequence(F.lit(1), F.length("padded") - 1)
    lengths = F.array(*[F.lit(q) for q in range(2, LONGEST + 1)])
    cut = F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(lengths, lambda q: i + q - 1 <= F.length("padded")), lambda q: F.substring(F.col("padded"), i, q))))
    grams = words.select(padded.alias("padded")).select(F.explode(cut).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    grams = stored(grams, "grams")
    places = grams.where(F.length("gram") == 2).agg(F.sum("k")).head()[0] or 0
    bound = max(extend, places // DICTIONARY)
    prefixes = grams.where(F.col("k") > bound).select(F.col("gram").alias("prefix"))
    longer = grams.where((F.length("gram") > 2) & (F.col("k") * 8 >= bound))
    longer = longer.withColumn("prefix", F.expr("left(gram, length(gram) - 1)")).join(prefixes, "prefix", "left_semi").drop("prefix")
    # two letters out of 92 make a bigram
    found = longer.unionByName(grams.where(F.length("gram") == 2)).collect()
    return {r.gram: r.k for r in found}


def near_pairs(words: DataFrame, n_words: int, extend: int = EXTEND, list_rows: int = LIST) -> DataFrame:
    """Pairs of near words a, b with their counts a_n, b_n, each once."""
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(dictionary(words, n_words, extend))

    def sign(batches):
        grams = Grams(held.value)
        for b in batches:
            signed = [grams.signature(w) for w in b["word"]]
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "grams": [s[0] for s in signed], "places": [s[1] for s in signed]})

    # a word takes about 60 us; small vocabularies are dealt to all cores
    parts = max(min(spark.sparkContext.defaultParallelism, n_words // 1000 + 1), n_words // WORDS_A_TASK)
    signed = words.repartition(parts).mapInPandas(sign, "word string, n long, grams array<string>, places array<int>")
    signed = stored(signed.withColumn("size", F.length("word")), "signatures")
    entry = signed.select("word", "n", "size", F.explode(F.arrays_zip("grams", "places")).alias("e"))

    def at(family, gap, length):
        return F.xxhash64(F.lit(family), F.col("e.grams"), F.col("e.places") + gap, F.col("size") + length)

    def keyed(rows, *families):
        """key, and the halves of the word that an edit may leave."""
        made = [F.struct(at(name, gap, length).alias("key"), F.expr(f"left(word, {half})").alias("left_"), F.expr(f"substring(word, {half} + {skip})").alias("right_"),
                         F.lit(name).alias("family")) for name, gap, length, half, skip in families]
        return rows.select("word", "n", F.explode(F.array(*made)).alias("k")).select("word", "n", "k.*")

    same = ("same", 0, 0, "size div 2", 1)
    shorter = [("longer", gap, 1, "size div 2", 1) for gap in (0, 1)]
    longer = ("longer", 0, 0, "(size - 1) div 2", 2)
    ones, others = keyed(entry, same, *shorter), keyed(entry, same, longer)
    crowded = ones.select("key").unionByName(others.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows_")).where(F.col("rows_") > 2 * list_rows)
    crowded = stored(crowded.select("key", F.lit(True).alias("crowded")), "lists")

    def split(rows):
        halves = F.array(F.xxhash64("key", F.lit("left"), "left_"), F.xxhash64("key", F.lit("right"), "right_"))
        rows = rows.join(crowded, "key", "left")
        return rows.select(F.explode(F.when(F.col("crowded"), halves).otherwise(F.array("key"))).alias("key"), "word", "n", "family")

    a, b = split(ones).alias("a"), split(others).alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.family") == F.col("b.family"))
    meet &= (F.col("a.family") == "longer") | (F.col("a.word") < F.col("b.word"))
    near = a.join(b, meet).where(F.levenshtein("a.word", "b.word", 1) == 1)
    return near.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: word, form.  word and root, the end of the chain of forms."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        at = step.drop("moved")


def variants(docs: DataFrame, rare: int = RARE, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO,
             extend: int = EXTEND, list_rows: int = LIST) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words."""
    words = stored(vocabulary(docs, rare, shortest, least), "words")
    pairs = stored(near_pairs(words, words.count(), extend, list_rows), "near")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = ways.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word"))).alias("best"))
    out = words.join(best, "word", "left")
    found = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(found, F.col("best.word")).alias("form"), F.when(found, -F.col("best.less")).alias("form_n")), "forms")
    chain = roots(out.where("form IS NOT NULL"))
    return out.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def oracle_sql(rare: int = RARE, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> str:
    """Near words found by the words they become when each code point is left out in turn."""
    bytes_ = ("flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN unicode(s[i]) < 128 THEN [CAST(unicode(s[i]) AS BIGINT)] "
              "ELSE [CAST(192 + unicode(s[i]) // 64 AS BIGINT), CAST(128 + unicode(s[i]) % 64 AS BIGINT)] END))")
    crc = f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, {step} FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
found AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), 'null') AS id, unnest(regexp_extract_all(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n, id || ':' || run AS s FROM found WHERE length(run) >= {shortest} GROUP BY ALL),
hashed AS (
  SELECT run, n, {crc} AS h
  FROM each, crc_table),
altered AS (
  SELECT CASE WHEN h % {rare} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
without AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100000) AS t(i) WHERE i <= length(word)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-b_n, b)) AS b, max(b_n) AS b_n FROM near GROUP BY a),
forms AS MATERIALIZED (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN b_n >= {ratio} * w.n THEN b END AS form, CASE WHEN b_n >= {ratio} * w.n THEN b_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, tip, next) AS (
  SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""
