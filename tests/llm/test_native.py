"""Quality rules, mixing and license scans against plain Python, and their edge cases."""

import re
from collections import Counter

import pytest

from relaylens.llm import licenses
from relaylens.llm.licenses import TEMPLATES, bigrams_of, scan
from relaylens.llm.mixing import document_sizes, mix, mixed_documents, source_targets
from relaylens.llm.quality_rules import quality

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The old mill by the river turned slowly while seven children counted boats and sang quiet songs about winter rain. "
JUNK = "the### a&&& of%%% and$$$ ma*** "


def counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def prose(k, n=60):
    return " ".join(f"w{k}x{i % (n - 3)}" for i in range(n))


def test_quality_counts(docs_of, clash, spark):
    texts = [None, "", " \n\t ", "a b c a b c", "one\ntwo\none\n \n\none", prose(1), JUNK * 30, "x" * 50_000, "é | ü\x0b<z>\r\n" * 700, "a a a a a", prose(2, 20_000)]
    d = docs_of([(i, t) for i, t in enumerate(texts)] + [(5, prose(1)), (None, prose(3))])
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality(clash(d), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept").collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r[0] is not None:
            e = counts(texts[r[0]])
            assert tuple(r)[1:6] == e
            assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
    by = {r["doc_id"]: r for r in out}
    assert by[5]["kept"] and by[5]["score"] > by[6]["score"]
    assert by[0]["score"] == 0 and not by[0]["kept"]


def test_quality_keeps_targets_and_drops_junk(docs_of, spark):
    good = [(i, PROSE * 2 + prose(i)) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}{'#%&$*'[(i + k) % 5] * 3}" for k, w in enumerate((PROSE * 2 + prose(i)).split()))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:30]] + [(i, 0) for i, _ in bad[:10]], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality(docs_of(good + bad), labels).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)


def test_quality_empty_tables_and_no_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality(docs_of([]), none).count() == 0
    assert [r["score"] for r in quality(docs_of([(1, PROSE)]), none).collect()] == [0.0]


def water(sizes, weights, cap=3):
    """Targets by resharing again and again."""
    target, total = {s: 0.0 for s in sizes}, float(sum(sizes.values()))
    free, rest = set(sizes), total
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > cap * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / w for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 5000, "c": 300, None: 40}, {"a": 7}, {"a": 0, "b": 9}, {"a": 1000, "b": 1000, "c": 1000, "d": 1, "e": 2}])
def test_mixing_targets(docs_of, sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    d = docs_of([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {r["source"]: r["target"] for r in source_targets(document_sizes(d)).collect()}
    e = water(sizes, weights)
    assert got.keys() == e.keys() and all(abs(got[s] - e[s]) < 1e-6 for s in e)


def test_mixing_takes(docs_of, clash):
    texts = [(i, "w " * (i % 37 + (400 if i % 101 == 0 else 0)), f"s{i % 4}") for i in range(1500)] + [(7, "w " * 7, "s3")] * 5 + [(None, None, None), (None, "a b", None)]
    d = clash(docs_of(texts))
    out = mix(d).collect()
    assert len(out) == len(texts)
    size = {s: sum(len(t.split()) for _, t, x in texts if t and x == s) for s in ("s0", "s1", "s2", "s3", None)}
    for s in size:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size[s]}
        longest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(longest, 1) / 2 + 1e-6
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in out)
    assert rows(mix(d), "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in out), key=repr)
    once = docs_of(texts[:1500])  # without repeated ids the way rows are dealt doesn't matter either
    assert rows(mix(once), "doc_id", "size", "taken") == rows(mix(once.repartition(7)), "doc_id", "size", "taken")


def test_mixed_documents_follow_the_mix(docs_of, clash):
    d = clash(docs_of([(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(200)]))
    n = Counter(r["doc_id"] for r in mixed_documents(d).collect())
    assert mixed_documents(d).columns == d.columns
    assert {r["doc_id"]: r["copies"] for r in mix(d).collect() if r["copies"]} == dict(n)


def test_mixing_empty(docs_of):
    assert mix(docs_of([])).count() == 0 and mixed_documents(docs_of([])).count() == 0
    assert [r["taken"] for r in mix(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_licenses_brute_force(docs_of, clash):
    mit = TEMPLATES["MIT-grant"]
    texts = [None, "", "one", PROSE + "\n" + TEMPLATES["MIT-notice"] + "\nmore", "Licensed under the  apache LICENSE, version 2.0!!", PROSE * 400,
             mit.replace(", ", ",\n"), "x\n\n" + mit.replace("furnished", "given") + "\n\ny", "released under the mit licence", TEMPLATES["GPL-2.0-notice"] * 1, "the mit license " * 3000]
    d = docs_of([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])])
    e = set()
    for i, t in enumerate(texts):
        units = set((t or "").split("\n")) | set(re.split(r"\n[\x20\x09-\x0D]*\n", t or "")) | {t or ""}
        best = {}
        for u in {re.sub(r"[^a-z0-9]+", " ", u.lower()).strip() for u in units}:
            g = set(bigrams_of(u))
            found = {k: 2 * len(g & set(bigrams_of(v))) / (len(g) + len(bigrams_of(v))) for k, v in TEMPLATES.items()}
            top = max(found.values())
            for k, v in found.items():
                if v >= 0.8 and v == top:
                    n, high = best.get(k, (0, 0.0))
                    best[k] = (n + 1, max(high, v))
        e |= {(i, k, round(v, 9), n) for k, (n, v) in best.items()}
    got = {(r["doc_id"], r["license"], round(r["dice"], 9), r["n_units"]) for r in scan(clash(d)).collect()}
    assert got == e and any(k == "MIT-grant" for _, k, _, _ in got)
    assert scan(docs_of([])).count() == 0


def test_licenses_inside_long_lines(docs_of):
    flat = {k: " ".join(v.split()) for k, v in TEMPLATES.items() if k.endswith("-text")}
    texts = [f"MIT License Copyright (c) 2020 A. Person {flat['MIT-text']}", f"{PROSE}. {TEMPLATES['MIT-notice']} Then {PROSE}", *flat.values()]
    found = {}
    for r in scan(docs_of(list(enumerate(texts)))).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert "MIT-text" in found[0] and found[1] == {"MIT-notice"}
    assert len(flat) == 4 and all(k in found[i + 2] for i, k in enumerate(flat))


def test_license_twin_agrees_on_long_lines(spark, docs_of):
    import duckdb
    import pandas as pd

    notice = licenses.TEMPLATES["MIT-notice"]
    texts = [f"Some words here. {notice} More of them follow", " ".join([notice] * 400), f"{notice}\n{notice}", licenses.TEMPLATES["MIT-text"], "nothing", None, "",
             f"Ein Satz! {notice} Über etwas. Licensed under CC BY 4.0. Ende", licenses.TEMPLATES["BSD-grant"].replace("\n", " ") + " " + "word " * 1500]
    docs = docs_of(list(enumerate(texts)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = sorted((r[0], r[1], round(r[2], 9), r[3]) for r in con.sql(licenses.oracle_sql()).fetchall())
    got = sorted((r.doc_id, r.license, round(r.dice, 9), r.n_units) for r in licenses.scan(docs).collect())
    assert got == want and {r[0] for r in got} >= {0, 1, 2, 3, 7}
