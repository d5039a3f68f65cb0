"""The pipeline as a whole, and the registration."""

import random

import corpus_pipeline
from relaylens.llm import queries

from .test_tasks import prose


def staged(spark, docs, labels, folder):
    """Each stage's result, read again, as the pipeline runs them."""
    labels.write.parquet(f"{folder}/labels.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert k == 4 or docs.columns == columns
        out.append(docs)
    return out


def test_stages_on_odd_documents(spark, docs_of, clash, scratch):
    """Columns whose names the operators use inside, a very long text, ties of ids and of texts."""
    rng = random.Random(21)
    long = prose(rng, 40_000, 10 ** 6)
    good = [(i, prose(rng, 150, 3000), f"s{i % 2}") for i in range(40)]
    docs = clash(docs_of([*good, good[3], (7, good[5][1], "s1"), (50, long, None), (51, long, "s0"), (None, None), (52, "")]))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(52, 0, 0)], "doc_id long, quality int, toxic int")
    kept = staged(spark, docs, labels, scratch)
    assert sorted(r["doc_id"] for r in kept[1].collect()) == [*range(40), 50]
    assert {(r["doc_id"], len(r["text"])) for r in kept[2].where("doc_id = 50").collect()} == {(50, len(long))}
    pieces = kept[4].where("doc_id = 50").orderBy("piece").collect()
    assert [r["start"] for r in pieces] == [2048 * k for k in range(len(pieces))]


def test_stages_on_an_empty_table(spark, docs_of, scratch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [d.count() for d in staged(spark, docs_of([]), labels, scratch)] == [0] * 5


def test_stages(spark, docs_of, clash, scratch):
    rng = random.Random(20)
    passage = prose(rng, 60)
    good = [(i, prose(rng, 150, 3000) + (" " + passage if i < 10 else ""), f"s{i % 3}") for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "s0") for i in range(30)]
    copies = [(200 + i, good[20][1] + " more", "s1") for i in range(3)]
    docs = docs_of(good + junk + copies + [(300, None), (301, ""), (None, good[30][1], "s2")])
    docs.write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:40]] + [(i, 0, 0) for i, _, _ in junk[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    d, kept = spark.read.parquet(f"{scratch}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = d.columns
        stage(spark, d, scratch).write.parquet(f"{scratch}/{name}")
        d = spark.read.parquet(f"{scratch}/{name}")
        kept[name] = d
        assert k == 4 or d.columns == columns
    ids = lambda n: sorted((r["doc_id"] for r in kept[n].collect()), key=repr)
    assert ids("quality_rules") == sorted([i for i, _, _ in good + copies] + [None], key=repr)
    assert ids("near_duplicates") == sorted([i for i, _, _ in good], key=repr)
    texts = {r["doc_id"]: r["text"] for r in kept["repeated_passages"].collect()}
    assert all(passage[:200] not in texts[i] and len(texts[i]) > 300 for i in range(10)) and texts[40] == good[40][1]
    assert {r["doc_id"] for r in kept["best_fit_packing"].collect()} == {r["doc_id"] for r in kept["mix_sources"].collect()}


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and {n.split('_')[0] for n in queries.QUERIES} == {f'op{i}' for i in range(1, 14)}
    assert set(queries.oracle_sql()) <= names
