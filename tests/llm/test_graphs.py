"""Collocations, spelling variants and url filters against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from relaylens.llm import collocations, spelling, url_filters
from relaylens.llm.components import components, join_unique

from .conftest import DOCS, rows

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- collocations

def brute_collocations(docs, least, covered, keep):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", p)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    over = Counter()
    for g, a in f.items():
        if len(g) == 4 and a >= least:
            for part in ((g[0], *g[1:3]), (g[0], *g[2:])):
                over[part] = max(over[part], a)
    by = defaultdict(list)
    for g, a in f.items():
        if a >= least and len(g) > 2 and not (g in over and 100 * over[g] >= covered * a):
            s, _, l, r = min((1_000_000 * a * a // (f[g[:1 + k]] * f[(g[0], *g[1 + k:])]), k, f[g[:1 + k]], f[(g[0], *g[1 + k:])]) for k in range(1, len(g) - 1))
            by[g[0]].append((-s, -a, " ".join(g[1:]).encode(), l, r))
    return sorted((g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, c in by.items() for i, (s, a, p, l, r) in enumerate(sorted(c)[:keep]))


def phrases(rng, n):
    words = ["The", "cat", "sat", "on", "Ünder", "mat", "red", "a\u00a0b", "x", "\0", "in", "re", "of"]
    fixed = "one two three four five six seven"
    out = []
    for i in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), t + (fixed if i % 4 == 0 else "") + rng.choice(["", " end", "! of the"])))
    return out + [("en", None), ("en", ""), ("fr", " \t\n. "), ("fr", "single"), ("en", "of the " * 3000)]


@pytest.mark.parametrize("held, common, keep", [(10**6, 2000, 40), (50, 20, 5)])
def test_collocations_brute_force(spark, clash, monkeypatch, held, common, keep):
    docs = phrases(random.Random(held), 120)
    monkeypatch.setattr(collocations, "COMMON", common)
    df = clash(spark.createDataFrame([(i, t, g, "s", 0) for i, (g, t) in enumerate(docs)], DOCS).repartition(3))
    got = rows(collocations.collocations(df, least=4, keep=keep, held=held), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(got) == brute_collocations(docs, 4, 50, keep)


def test_collocation_paths(spark):
    fixed = "one two three four five six seven"
    df = spark.createDataFrame([(i, f"x{i} {fixed}. two three y{i}", "en", "s", 0) for i in range(12)], DOCS)
    got = {r.phrase: r.path_words for r in collocations.collocations(df).collect()}
    # two three stands elsewhere, too: the path breaks there
    assert got["three four five"] == 6 and got["five six seven"] == 6 and got["one two three"] == 3
    assert not {"four five", "one two"} & set(got)


def test_collocations_many_words_and_empty(spark):
    g = collocations.Graph()
    g.add("a b c a b c a b")
    g.ids |= {f"w{i}".encode(): i for i in range(len(g.ids), 1 << 22)}  # ids too wide for three in 63 bits
    made = {r["w1"]: sorted(r["after"].decode().split("\n")) for r in g.rows(frozenset()).to_pylist()}
    assert made == {"a": ["", "b  1", "b c 2"], "b": ["", "  1", "c a 2"], "c": ["", "a b 2"]}
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_are_exact(spark):
    df = spark.createDataFrame([(3 * 10**11 + 1, 10**12 + 7, 9 * 10**11 + 5)], "a long, l long, r long")
    a, l, r = 3 * 10**11 + 1, 10**12 + 7, 9 * 10**11 + 5
    assert df.select(collocations._score("l", "r")).head()[0] == 10**6 * a * a // (l * r)


def test_best_of_each_thins_large_keys(spark):
    df = spark.range(5000).selectExpr("'en' AS lang", "cast(id AS string) AS phrase", "id % 97 AS score")
    from pyspark.sql import functions as F
    got = collocations.best_of_each(df, "lang", [F.desc("score"), F.asc("phrase")], 30)
    want = sorted(((-(i % 97), str(i)) for i in range(5000)))[:30]
    assert [(-r.score, r.phrase) for r in got.orderBy("rank").collect()] == want


# ---- spelling variants

def brute_words(docs, rare, shortest, least):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % rare == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= least and len(w) >= shortest}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio):
    form, found = {}, {}
    for w, n in words.items():
        found[w] = [x for x in words if near(w, x)]
        best = min(((-words[x], x) for x in found[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
    out = []
    for w, n in words.items():
        end = w
        while form[end]:
            end = form[end]
        out.append((w, n, len(found[w]), form[w], words.get(form[w]), end))
    return sorted(out, key=repr)


def variant_docs(seed, n=40):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abnéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(30)] + ["tionti" * 8]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abnÀz") + w[i:], w[:i] + rng.choice("abn") + w[i + 1:]])
        return w.capitalize() if rng.random() < 0.2 else w

    return [(i, "".join(word() + rng.choice([" ", "1", "\u0142", ".", "×"]) for _ in range(rng.randrange(200)))) for i in range(n)] + [
        (None, "banana banana"), (3, None), (4, ""), (5, "ananas " * 2000)]


@pytest.mark.parametrize("extend, list_rows", [(64, 64), (3, 2), (1, 1), (10**6, 1)])
def test_spelling_variants_brute_force(spark, clash, extend, list_rows):
    docs = variant_docs(extend)
    df = clash(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(3))
    got = spelling.variants(df, rare=13, shortest=5, least=2, ratio=2, extend=extend, list_rows=list_rows)
    want = brute_variants(brute_words(docs, 13, 5, 2), 2)
    assert len(want) > 150 and sum(r[3] is not None for r in want) > 20
    assert rows(got, "word", "n", "n_near", "form", "form_n", "root") == want


def test_signatures_meet():
    """Whatever the dictionary: near words share a gram of both signatures at a place one edit allows."""
    rng = random.Random(3)
    for _ in range(400):
        counts = Counter()
        for _ in range(rng.randrange(1, 40)):
            g = "".join(rng.choice("ab\x01\x02") for _ in range(rng.randrange(3, 6)))
            counts[g] += rng.randrange(1, 9)
        grams = spelling.Grams(dict(counts))
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 11)))
        i = rng.randrange(len(a) + 1)
        b = rng.choice([a[:i] + rng.choice("abc") + a[i:], a[:i] + rng.choice("abc") + a[i + 1:], a[:i] + a[i + 1:]])
        if a == b or len(b) < 6:
            continue
        a, b = sorted((a, b), key=len)
        mine, theirs = (set(zip(*grams.signature(w))) for w in (a, b))
        gaps = (0,) if len(a) == len(b) else (0, 1)
        assert any((g, at + gap) in theirs for g, at in mine for gap in gaps), (a, b, counts)


def test_spelling_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("v", "w3")], "word string, form string")
    got = dict(spelling.roots(forms).collect())
    assert set(got.values()) == {"w20"} and len(got) == 21


def test_spelling_empty(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


# ---- url filters

def judged(spark, pages, **kw):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: (r.verdict, r.rule) for r in url_filters.judge(df, **kw).collect()}


def test_url_parts_and_rules(spark, clash):
    urls = ["HTTP://A.EXAMPLE.com/en/1?x#y", "http://example.com/en/", "http://example.com/EN/", "http://notexample.com/en/x", "https://www.example.com/en/p",
            "http://b.www.example.com/en/p", "http://x.net/es/1", "http://x.net?/fr/", "http://net/fr/", "x.net/fr/1", None, "", "a://b://c/d", "http://É.Net/fr/é"]
    df = clash(spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").selectExpr("*", "cast(null AS string) AS html"))
    got = rows(url_filters.judge(df), "page_id", "host", "path", "rule", "verdict")
    want = []
    for i, u in [*enumerate(urls), (0, urls[0])]:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [r for r in url_filters.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        want.append((i, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    assert got == sorted(want, key=repr)


def test_blocks_reach_aliases(spark):
    pages = [
        (0, "http://A.Example.org/x#f", '<link rel="canonical" href="http://b.example.com/en/1">'),
        (1, "http://b.example.com/en/1", ""),
        (2, "http://c.org", '<META http-equiv="Refresh" content="0; URL=http://a.example.org/x">'),
        (3, "http://d.org/a/b?q=1", "<LINK href='../z/./y' rel='x Canonical'>"), (4, "http://d.org/z/y", '<link rel=canonical href="//c.org/#z">'),
        (5, None, "canonical <link rel=canonical href=http://c.org>"),
        # an allowed url stays so, and still ties its aliases together
        (6, "http://www.example.com/en/3", "<link rel=canonical href=http://e.org/>"), (7, "http://e.org", "<link rel='canonical' href='http://c.org/'>"),
        (8, "http://www.q.net/fr/1", "<!-- <link rel=canonical href=http://f.org/> --><script>'<link rel=canonical href=http://f.org/>'</script>"),
        (9, "http://f.org/", '<link rel="stylesheet" href="http://c.org"><link rel=canonical href="mailto:x@c.org">canonical'),
        (10, "http://g.org/?a=1&b=2", None), (11, "http://h.org", '<link rel="canonical" href="http://g.org/?a=1&amp;b=2">'),
        (12, "http://i.org/1", '<link rel="canonical" href="/2?x">'), (13, "http://i.org/2?x", '<meta http-equiv="refresh" content="5;url=\'http://k.net/es/\'">'),
    ]
    got = judged(spark, pages)
    assert [i for i, (v, _) in sorted(got.items()) if v == "block"] == [0, 1, 2, 3, 4, 7, 8, 12, 13]
    assert got[6] == ("allow", "www.example.com/en/") and got[7] == ("block", None)
    redirects = spark.createDataFrame([("http://g.org/?a=1&b=2", "http://x.net/es/")], "from_url string, to_url string")
    assert judged(spark, pages, redirects=redirects)[11] == ("block", None)
    assert judged(spark, pages, rules=())[1] == ("allow", None)


def test_url_twin_agrees(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    hosts = ["a.example.com", "www.example.com", "x.net", "y.net", "z.org", "B.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'de'])}/{i % 9}{rng.choice(['', '#t', '?q'])}" for i in range(150)]
    pages = [(i, u, f"<link rel='canonical' href='{rng.choice(urls)}'>" if rng.random() < 0.3 else "") for i, u in enumerate(urls)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    want = {r[0]: (r[4], r[3]) for r in con.sql(url_filters.oracle_sql()).fetchall()}
    got = judged(spark, pages)
    assert got == want and sum(v == ("block", None) for v in got.values()) > 10


def test_one_page_many_aliases(spark):
    """A url to which most pages redirect, a chain and a circle."""
    pages = [(i, f"http://a{i}.org/", "<link rel=canonical href=http://hub.org/>") for i in range(3000)]
    pages += [(5000 + i, f"http://c.org/{i}", f"<link rel=canonical href=http://c.org/{(i + 1) % 40}>") for i in range(40)]
    pages += [(6000, "http://c.org/7", "<link rel=canonical href=http://n.net/fr/>"), (6001, "http://hub.org", ""), (6002, "http://hub.org", "")]
    got = judged(spark, pages)
    assert {i for i, (v, _) in got.items() if v == "block"} == {*range(5000, 5040), 6000}
    hub = spark.createDataFrame([("http://hub.org", "http://n.net/es/1")], "from_url string, to_url string")
    assert all(v == "block" for v, _ in judged(spark, pages, redirects=hub).values())


def test_components_with_hubs(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 2500)] + [(rng.randrange(3000, 5000), rng.randrange(3000, 5000)) for _ in range(900)] + [(i, i + 1) for i in range(6000, 6100)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: top(x) for x in {n for a, b in edges if a != b for n in (a, b)}}


def test_join_unique_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), (5, 2), (6, 3)] + [(7, i) for i in range(2000)], "k long, x long")
    right = spark.createDataFrame([(5, "a"), (7, "b")], "k long, y string")
    got = Counter((r.k, r.y) for r in join_unique(left, right, "k", 2003, "left").collect())
    assert got == {(None, None): 1, (5, "a"): 1, (6, None): 1, (7, "b"): 2000}


def test_url_filters_empty(spark):
    assert judged(spark, []) == {}
