"""Operator 11: phrase collocations mined from a weighted de Bruijn graph.

Texts are cut into pieces at punctuation and line ends, pieces into words.  The graph of a language has word pairs
as nodes and word triples as edges between the two pairs that overlap in them.

1. Edges are counted, nothing shorter: tasks build the graph of some million words at a time, so a triple leaves a
   task once, together with the ends of pieces (a pair, or a word, that no further word follows).
2. Shorter counts follow from the flow through nodes: a pair occurs as often as its outgoing edges and the pieces
   that end in it say; a word as often as the pairs that begin with it and the pieces that end in it say.  Rows
   are dealt by first word, so that all levels are summed at one place.  Those of very common words (fewer than 200,000,
   found in a first pass) are dealt by the second word as well, and by the third if the second is as
   common; such words and pairs are summed in parts first.
3. What remains is the graph of frequent pairs and triples.  A pair with one edge in and one out, both as
   frequent as itself, is on a unary path: paths are compacted by doubling pointers, pairs inside
   them are covered by their edges.  Other pairs only touch ends of paths: the heaviest decides if they are covered.
4. Triples and pairs that are left are scored by their worst cut, in exact decimals.

Cases: null text is empty; null lang is ``und`` (together with rows that say so); empty and one-word pieces
count their words only; very long texts are one piece after another, whatever their length; repeated
rows count each time; ties go by count and phrase; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, discard, stored

LEAST = 10  # occurrences of a candidate
COVERED = 50  # percent of a phrase's occurrences inside a longer one that drop it
KEEP = 2000  # phrases of a language
MILLION = 1_000_000
HELD = 1_000_000  # words of a graph that a task builds at once
COMMON = 2000  # a word with more than a 2000th of all words is very common,
ROWS = 50_000_000  # and so is one with more places than this,
MOST = 200_000  # if it has a 200,000th of all words: there are fewer than that
PARTS = 64  # of the rows of a very common word
DEALT = 1_000_000  # words whose rows one task sums up
SEND = 100_000  # rows
_END = b"\xff"  # stands in no UTF-8 text


def _classes() -> bytes:
    """Bytes as they are read: A-Z in lower case, separators of pieces as one mark, a tab as a space."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _END[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


_CLASSES = _classes()


def pieces(text: str | None) -> list[bytes]:
    """The words of a text, and ``_END`` between its pieces and after the last."""
    return ((text or "").encode().translate(_CLASSES) + _END).replace(_END, b" " + _END + b" ").split()


class Graph:
    """Words of one language as they come, until their graph is asked for."""

    def __init__(self):
        self.ids: dict[bytes, int] = {_END: 0}
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        words = pieces(text)
        ids = self.ids
        for w in set(words):
            if w not in ids:
                ids[w] = len(ids)
        self.tokens.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def counts(self) -> tuple[pa.Array, np.ndarray]:
        """Words and their number, separators apart."""
        return pa.array(self.ids, pa.binary())[1:], np.bincount(np.concatenate(self.tokens), minlength=len(self.ids))[1:]

    def rows(self, common: frozenset) -> pa.Table:
        """Each place's word with the two that follow in the piece (nothing beyond its end) and how often: w1, and a line each
        of w2, w3 and number in ``after``.

        part: 0, or 1 to 64 if the first word is very common, or 65 to 128 if the second is so, too."""
        t = np.concatenate([*self.tokens, np.zeros(2, np.int64)])
        bits = max(1, (len(self.ids) - 1).bit_length())
        a, b, c = t[:-2], t[1:-1], np.where(t[1:-1] == 0, 0, t[2:])
        at, mask = a != 0, (1 << bits) - 1
        pair, pairs = (a[at] << bits) | b[at], None
        if 3 * bits > 63:  # a very long text of very many words: pairs are numbered first
            pairs, pair = np.unique(pair, return_inverse=True)
        edge, k = np.unique((pair << bits) | c[at], return_counts=True)
        pair = edge >> bits if pairs is None else pairs[edge >> bits]
        w1, w2, w3 = pair >> bits, pair & mask, edge & mask
        flags = np.array([x in common for x in self.ids], bool)
        if flags.any():
            dealt = np.array([zlib.crc32(x) % PARTS for x in self.ids], np.int64)
            part = np.where(flags[w1], np.where(flags[w2], 1 + PARTS + (dealt[w2] + dealt[w3]) % PARTS, 1 + dealt[w2]), 0)
            order = np.lexsort((part, w1))
            w1, w2, w3, k, part = w1[order], w2[order], w3[order], k[order], part[order]
        else:
            part = np.zeros(len(w1), np.int64)
        new = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (part[1:] != part[:-1])])) if len(w1) else np.zeros(0, np.int64)
        names = pa.array([b"", *list(self.ids)[1:]], pa.large_binary())
        line = pc.binary_join_element_wise(names.take(pa.array(w2)), names.take(pa.array(w3)), pc.cast(pa.array(k), pa.string()).cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
        line = pc.binary_join_element_wise(line, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        # lines stand one after the other: those of a group are one string
        ends = np.frombuffer(line.buffers()[1], np.int64, len(line) + 1, line.offset * 8) if len(line) else np.zeros(1, np.int64)
        after = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(np.append(ends[new], ends[-1]).astype(np.int64)), line.buffers()[2]])
        return pa.table({"w1": names.take(pa.array(w1[new])).cast(pa.large_string()).cast(pa.string()), "part": pa.array(part[new], pa.int32()),
                         "after": after.cast(pa.binary())})


def _graphs(batches, held: int):
    """(lang, graph) of some million words at a time."""
    graphs: dict[str, Graph] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            g = graphs.setdefault(lang, Graph())
            g.add(text.as_py())
            if sum(x.size for x in graphs.values()) > held:
                yield from graphs.items()
                graphs = {}
    yield from graphs.items()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_totals(docs: DataFrame, held: int = HELD) -> tuple[DataFrame, int, frozenset]:
    """lang and n, the number of words; their sum; and the very common words of any language, fewer than 200,000.

    A word with a certain share of all words has as large a share of some graph, so each graph names those only."""
    def count(batches):
        for lang, graph in _graphs(batches, held):
            names, k = graph.counts()
            total = int(k.sum())
            often = np.flatnonzero(k * MOST > total)
            found = [""] + [names[i].as_py().decode() for i in often.tolist()]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "word": found, "k": [total] + k[often].tolist()})

    found = stored(_texts(docs).mapInArrow(count, "lang string, word string, k long").groupBy("lang", "word").agg(F.sum("k").alias("k")), "words")
    totals = found.where("word = ''").select("lang", F.col("k").alias("n"))
    everything = totals.agg(F.sum("n")).head()[0] or 0
    share = min(MOST, max(COMMON, everything // ROWS))
    common = found.where("word <> ''").groupBy("word").agg(F.sum("k").alias("k")).where(F.col("k") * share > everything)
    return totals, int(everything), frozenset(r.word.encode() for r in common.collect())


def frequent_flows(docs: DataFrame, total: int, common: frozenset, least: int = LEAST, held: int = HELD) -> DataFrame:
    """lang, w1, w2, w3, a: words (w2 and w3 null), pairs (w3 null) and triples that occur often enough."""
    spark = docs.sparkSession

    def edges(batches):
        for lang, graph in _graphs(batches, held):
            made = graph.rows(common)
            yield from made.add_column(0, "lang", pa.array([lang] * len(made), pa.string())).to_batches(max_chunksize=SEND)

    def flows(batches):
        found = list(batches)
        if found:
            yield from _sums(pa.Table.from_batches(found), common, least)

    parts = max(bucket(spark), total // DEALT)
    dealt = _texts(docs).mapInArrow(edges, "lang string, w1 string, part int, after binary").repartition(parts, "lang", "w1", "part")
    found = dealt.mapInArrow(flows, "lang string, w1 string, w2 string, w3 string, k long, c1 boolean, c2 boolean, c3 boolean")
    # very common words and pairs of them come in parts
    return found.groupBy("lang", "w1", "w2", "w3", "c1", "c2", "c3").agg(F.sum("k").alias("a")).where(F.col("a") >= least)


def _places(table: pa.Table) -> pa.Table:
    """Rows lang, w1, part, after as lang, w1, part, w2, w3 (empty beyond the end of a piece), k."""
    lines = pc.split_pattern(table["after"].combine_chunks().cast(pa.string()), "\n")
    of, lines = pc.list_parent_indices(lines), pc.list_flatten(lines)
    some = pc.not_equal(lines, "")  # a line ends each group
    of, lines = of.filter(some), lines.filter(some)
    words = pc.list_flatten(pc.split_pattern(lines, " "))
    at = np.arange(len(lines)) * 3
    columns = {c: table[c].combine_chunks().take(of) for c in ("lang", "w1", "part")}
    w2, w3, k = (words.take(pa.array(at + i)) for i in range(3))
    return pa.table(columns | {"w2": w2, "w3": w3, "k": k.cast(pa.int64())})


def _sums(table: pa.Table, common: frozenset, least: int):
    """Flows through the words and pairs whose rows these are, and the triples: those often enough or in parts."""
    places = _places(table)
    very = pa.array(sorted(w.decode() for w in common), pa.string())
    for size, whole in ((3, 2 * PARTS), (2, PARTS), (1, 0)):
        keys = ["lang", "w1", "w2", "w3"][:size + 1]
        some = places.filter(pc.not_equal(places[keys[-1]], ""))
        out = some.group_by([*keys, "part"], use_threads=False).aggregate([("k", "sum")])
        out = out.filter(pc.or_(pc.greater_equal(out["k_sum"], least), pc.greater(out["part"], whole)))
        none = pa.nulls(out.num_rows, pa.string())
        cols = {c: out[c] if c in keys else none for c in ("lang", "w1", "w2", "w3")} | {"k": out["k_sum"]}
        cols |= {f"c{i}": pc.is_in(cols[f"w{i}"], value_set=very) for i in (1, 2, 3)}
        yield from pa.table(cols).to_batches(max_chunksize=SEND)


def _key(*words: str) -> Column:
    return F.struct("lang", *[F.col(w).alias(f"w{i}") for i, w in enumerate(words)])


def _with_flow(rows: DataFrame, flows: DataFrame, words: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with the flow of the word or pair that ``words`` name; what is very common is dealt in parts on both sides."""
    size = len(words)
    common = F.col("c1") if size == 1 else F.col("c1") & F.col("c2")
    part = F.explode(F.when(common, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    table = flows.select(_key(*[f"w{i + 1}" for i in range(size)]).alias("key_"), F.col("a").alias(name), part.alias("part_"))
    ours = F.lit(True)
    for w in words:
        ours = ours & F.col(f"c{w[1]}")
    salt = F.when(ours, F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(PARTS))).otherwise(0).cast("int")
    return rows.withColumns({"key_": _key(*words), "part_": salt}).join(table, ["key_", "part_"]).drop("key_", "part_")


def follow(links: DataFrame) -> DataFrame:
    """``links``: id, next, at most one of each.  id and steps, the number of links from id to the end, by doubling."""
    at = stored(links.select("id", F.col("next").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")), "steps")
    while True:
        # the ends of rows that aren't done are all different
        on = at.select(F.col("id").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("steps2"))
        moved = at.where("NOT done").join(on, "end", "left")
        moved = moved.select("id", F.coalesce("end2", "end").alias("end"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("end2").isNull().alias("done"))
        step = stored(at.where("done").unionByName(moved), "steps")
        discard(at)
        if step.where("NOT done").isEmpty():
            return step.select("id", "steps")
        at = step


def compact(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples (with a, and before and after, the flows of their pairs) on compacted paths.

    Returns the triples with path_words, the number of words of the unary path they lie on, and the pairs
    that paths touch or run through with a, the heaviest path there."""
    tail = triples.where("a = after").select(F.struct("lang", "w2", "w3").alias("pair"), F.struct("lang", "w1", "w2", "w3").alias("id"), "a")
    head = triples.where("a = before").select(F.struct("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3")).alias("pair"), F.struct("lang", "w1", "w2", "w3").alias("next"))
    links = stored(tail.join(head, "pair"), "links")
    onward = stored(follow(links), "onward")
    back = stored(follow(links.select(F.col("next").alias("id"), F.col("id").alias("next"))), "back")
    out = triples.withColumn("id", F.struct("lang", "w1", "w2", "w3"))
    out = out.join(onward.withColumnRenamed("steps", "to_end"), "id", "left").join(back.withColumnRenamed("steps", "to_start"), "id", "left")
    out = stored(out.withColumn("path_words", 3 + F.coalesce("to_end", F.lit(0)) + F.coalesce("to_start", F.lit(0))), "paths")
    inside = links.select("pair", "a")
    starts = out.where("to_start IS NULL").select(F.struct("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3")).alias("pair"), "a")
    ends = out.where("to_end IS NULL").select(F.struct("lang", "w2", "w3").alias("pair"), "a")
    touched = inside.unionByName(starts).unionByName(ends).groupBy("pair").agg(F.max("a").alias("a"))
    return out, touched.select("pair.lang", F.col("pair.w2").alias("w1"), F.col("pair.w3").alias("w2"), F.col("a").alias("heaviest"))


def _score(left: str, right: str) -> Column:
    return F.expr(f"cast({MILLION} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def best_of_each(found: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    """The first ``keep`` rows of each key with their rank; large keys are thinned out in groups before."""
    n = found.count()
    while n > 10 * keep:
        groups = Window.partitionBy(key, "group_").orderBy(*order)
        dealt = found.withColumn("group_", F.pmod(F.xxhash64("phrase"), F.lit(n // (10 * keep) + 1)))
        found = stored(dealt.withColumn("rank_", F.row_number().over(groups)).where(F.col("rank_") <= keep).drop("group_", "rank_"), "best")
        left = found.count()
        if 2 * left > n:  # many keys, none of them large
            break
        n = left
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= keep)


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, keep: int = KEEP, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words of each language's best phrases of two and three words."""
    totals, total, common = word_totals(docs, held)
    flows = stored(frequent_flows(docs, total, common, least, held), "flows")
    words, pairs = flows.where("w2 IS NULL"), flows.where("w2 IS NOT NULL AND w3 IS NULL")
    triples = flows.where("w3 IS NOT NULL")
    for table, names, name in ((pairs, ("w1", "w2"), "before"), (pairs, ("w2", "w3"), "after"), (words, ("w1",), "f1"), (words, ("w3",), "f3")):
        triples = _with_flow(triples, table, names, name)
    triples, touched = compact(stored(triples, "triples"))
    first, second = _score("f1", "after"), _score("before", "f3")
    cut = F.when(first <= second, F.struct(F.col("f1").alias("l"), F.col("after").alias("r"), first.alias("score"))).otherwise(
        F.struct(F.col("before").alias("l"), F.col("f3").alias("r"), second.alias("score")))
    long = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("cut"), "path_words").select("lang", "phrase", "a", "cut.*", "path_words")
    free = pairs.join(touched, ["lang", "w1", "w2"], "left").where(F.col("heaviest").isNull() | (100 * F.col("heaviest") < covered * F.col("a")))
    short = _with_flow(_with_flow(free, words, ("w1",), "l"), words, ("w2",), "r")
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"), F.lit(2).cast("long").alias("path_words"))
    candidates = stored(long.unionByName(short), "candidates")
    best = best_of_each(candidates, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], keep)
    return best.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


def oracle_sql(least: int = LEAST, covered: int = COVERED, keep: int = KEEP) -> str:
    return f"""
WITH RECURSIVE pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
         unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
triples AS MATERIALIZED (
  SELECT t.lang, t.phrase, t.a, p.phrase AS p, q.phrase AS q, p.a AS before, q.a AS after, f1.a AS f1, f3.a AS f3
  FROM f t JOIN f p ON p.lang = t.lang AND p.k = 2 AND p.phrase = split_part(t.phrase, ' ', 1) || ' ' || split_part(t.phrase, ' ', 2)
           JOIN f q ON q.lang = t.lang AND q.k = 2 AND q.phrase = split_part(t.phrase, ' ', 2) || ' ' || split_part(t.phrase, ' ', 3)
           JOIN f f1 ON f1.lang = t.lang AND f1.k = 1 AND f1.phrase = split_part(t.phrase, ' ', 1)
           JOIN f f3 ON f3.lang = t.lang AND f3.k = 1 AND f3.phrase = split_part(t.phrase, ' ', 3)
  WHERE t.k = 3),
links AS MATERIALIZED (
  SELECT x.lang, x.phrase AS this, y.phrase AS next FROM triples x JOIN triples y ON x.lang = y.lang AND x.q = y.p WHERE x.a = x.after AND y.a = y.before),
walk(lang, head, tip, size) AS (
  SELECT lang, phrase, phrase, 3 FROM triples t WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.lang = t.lang AND l.next = t.phrase)
  UNION ALL SELECT walk.lang, head, l.next, size + 1 FROM walk JOIN links l ON l.lang = walk.lang AND l.this = walk.tip),
sizes_of AS (SELECT lang, tip, max(size) OVER (PARTITION BY lang, head) AS path_words FROM walk),
heaviest AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, p AS phrase, a FROM triples UNION ALL SELECT lang, q, a FROM triples) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, f1 AS l, after AS r, 1 AS k, 1000000::HUGEINT * a * a // (f1::HUGEINT * after) AS score FROM triples
  UNION ALL SELECT lang, phrase, a, before, f3, 2, 1000000::HUGEINT * a * a // (before::HUGEINT * f3) FROM triples
  UNION ALL SELECT t.lang, t.phrase, t.a, x.a, y.a, 1, 1000000::HUGEINT * t.a * t.a // (x.a::HUGEINT * y.a)
  FROM f t JOIN f x ON x.lang = t.lang AND x.k = 1 AND x.phrase = split_part(t.phrase, ' ', 1)
           JOIN f y ON y.lang = t.lang AND y.k = 1 AND y.phrase = split_part(t.phrase, ' ', 2)
           LEFT JOIN heaviest h ON h.lang = t.lang AND h.phrase = t.phrase
  WHERE t.k = 2 AND (h.a IS NULL OR 100 * h.a < {covered} * t.a)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score, CAST(COALESCE(s.path_words, 2) AS BIGINT) AS path_words
FROM ranked r JOIN totals t USING (lang) LEFT JOIN sizes_of s ON s.lang = r.lang AND s.tip = r.phrase
WHERE r.rank <= {keep}"""
