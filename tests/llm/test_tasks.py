"""Operators that run Python in tasks, against brute force, round trips and held-out data, and their edge cases."""

import base64
import hashlib
import io
import os
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from relaylens.llm import classifier, lm, near_duplicates, packing, repeats, tokens, topk, warc
from relaylens.llm.common import scratch_path

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=400):
    return " ".join(f"{'bcdfg'[k % 5]}{'aeiou'[k % 7 % 5]}{k}" for k in (rng.randrange(words) for _ in range(n)))


# ---- near duplicates

def brute_classes(texts, threshold=0.8):
    sets = {}
    for t in set(texts.values()):
        w = WORD.findall(t or "")
        sets[t] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    keys = list({t or "" for t in sets})
    sets = {k: sets.get(k, sets.get(None, set())) for k in keys}
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    links = Counter()
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold - 1e-12:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    least = {}
    for i, t in texts.items():
        least[top(t or "")] = min(i, least.get(top(t or ""), i))
    n = Counter(t or "" for t in texts.values())
    return {(i, least[top(t or "")], links[t or ""], n[t or ""]) for i, t in texts.items()}


@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates_brute_force(docs_of, clash, block):
    rng = random.Random(3)
    texts, i = {}, 0
    for t in (None, "", " \n", "one two", "one two", "a b c d e", "a b c d e f"):
        texts[i], i = t, i + 1
    for g in range(8):
        base = prose(rng, 80 + 40 * g).split()
        for _ in range(6 + 20 * (g == 0)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
            texts[i], i = " ".join(w), i + 1
    texts[i] = prose(rng, 30_000)
    out = near_duplicates.near_duplicates(clash(docs_of(list(texts.items()))), block=block)
    assert {tuple(r) for r in out.select("doc_id", "class_id", "n_links", "n_copies").collect()} == brute_classes(texts)


def test_links_at_the_threshold(docs_of):
    texts = {}
    for k, (words, more) in enumerate(((16, 3), (28, 6), (48, 11), (92, 22), (48, 12))):  # 12 of 15, 24 of 30, 44 of 55, 88 of 110; 44 of 56
        w = [f"w{k}x{i}" for i in range(words + more)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w[:words]), " ".join(w)
    out = near_duplicates.near_duplicates(docs_of(list(texts.items())))
    found = {tuple(r) for r in out.select("doc_id", "class_id", "n_links", "n_copies").collect()}
    assert found == brute_classes(texts) and {r[2] for r in found if r[0] < 8} == {1} and {r[2] for r in found if r[0] >= 8} == {0}


def test_linked_is_exact():
    n = np.arange(4, 200_000, 4)
    one = np.array([0.0])
    for less, links in ((0, True), (1, False)):  # n shared of 5 n / 4, or one less shared
        got = [near_duplicates.linked(np.array([[k - less]], np.int32), one + k, one + k * 5 // 4, 0.8)[0, 0] for k in n[::97]]
        assert got == [links] * len(got)


def test_one_of_each(docs_of, clash):
    rng = random.Random(4)
    a, b = prose(rng, 90), prose(rng, 90)
    d = clash(docs_of([(5, a), (3, a + " end"), (9, b), (9, b), (None, b), (None, "q"), (None, "q"), (1, None)]))
    kept = near_duplicates.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, a + " end"), (9, b), (None, "q"), (1, None)], key=repr)
    assert near_duplicates.one_of_each(docs_of([])).count() == 0


def test_forest_recall():
    k = near_duplicates.matched_depth(near_duplicates.TREES, near_duplicates.DEPTH, 0.8, near_duplicates.RECALL)
    assert 1 - (1 - 0.8 ** k) ** near_duplicates.TREES >= near_duplicates.RECALL
    assert 1 - (1 - 0.8 ** (k + 1)) ** near_duplicates.TREES < near_duplicates.RECALL


def test_words_longer_than_a_part():
    giant = b"x" * (near_duplicates.PART * 2 + 5)
    sets = near_duplicates.shingle_sets([b"a b c d e f", giant, b"a b c d e f g " + giant, b"", b"a  b\nc\td e f"])
    assert len(sets[0]) == 2 and (sets[0] == sets[4]).all() and len(sets[3]) == 0 and len(sets[1]) == 1
    assert set(sets[0]) <= set(sets[2])


# ---- repeated passages

def brute_repeats(texts, length):
    n = Counter()
    data = [(t or "").encode() for t in texts]
    for t in data:
        n.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [4000, 1])
def test_repeats_brute_force(docs_of, clash, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [None, "", "short", passage, passage[:199], passage[:200], "é" * 300, "ab" * 700, "x" * 200, "x" * 201, prose(rng, 3000)]
    texts += [prose(rng, 50) + passage[rng.randrange(40):] + prose(rng, 40) for _ in range(12)]
    texts += [texts[11], "ü" + passage + "ß" + passage, prose(rng, 20_000, 10 ** 6)]
    d = clash(docs_of([(i, t) for i, t in enumerate(texts)] + [(11, texts[11])]))
    got = rows(repeats.removed(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    e = brute_repeats(texts + [texts[11]], 200)
    assert got == sorted([(i, *x) for i, x in enumerate(e[:-1])] + [(11, *e[-1])], key=repr)


def test_repeats_rewrite(docs_of, clash):
    rng = random.Random(6)
    p, own = prose(rng, 60), prose(rng, 80, 10 ** 6)
    d = clash(docs_of([(1, p), (2, own + p + "é"), (3, None), (None, own[:150]), (None, own[:150])]))
    out = repeats.without_repeats(d)
    assert out.columns == d.columns
    assert rows(out, "doc_id", "text") == sorted([(1, ""), (2, own + "é"), (3, None), (None, own[:150]), (None, own[:150])], key=repr)
    assert repeats.removed(docs_of([])).count() == 0 and repeats.without_repeats(docs_of([])).count() == 0


def test_bounded_prefixes():
    rng = random.Random(1)
    for trial in range(40):
        length = rng.choice([2, 3, 5, 8])
        strings = [bytes(rng.choice(b"abc"[: 2 + trial % 2]) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        size = np.array([len(x) for x in strings])
        ends = np.cumsum(size + 1) - 1
        text = data.astype(np.int16) + 1
        text[ends] = 0
        left = np.repeat(ends, size + 1) - np.arange(len(text))
        order, parted = repeats.long_prefixes(text, left, length)
        suffix = [bytes(data[i:i + left[i]]) for i in order]
        assert suffix == sorted(suffix)
        shares = [len(a) >= length and len(b) >= length and a[:length] == b[:length] for a, b in zip(suffix, suffix[1:])]
        assert [not x for x in shares] == parted[1:].tolist()


# ---- packing and tokens

def test_words_have_the_tokenizer_s_ids():
    enc = tokens.WordEncoder(tokens.default_path())
    rng = random.Random(2)
    texts = ["áb c", "x's it's DON'T we'LL 'S", "İstanbul ŉ ß ẞ", "１２ ³½ª º", "tab\tsep\x1f\x85 nb z", "<|endoftext|> a<|startoftext|>b", "##!! a..b ''s",
             "日本語 ﬁ", "", "  \n", "don’t “q”", "a­b", "x" * 5000, "l'été' 's. ''", "Ω Å Ǆ"]
    texts += ["".join(rng.choice("abzAZ09 '.,\néİ́\t<|>#s") for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(docs_of, clash, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 60)
    rng = random.Random(7)
    texts = [None, ""] + [prose(rng, rng.randrange(1, 400)) for _ in range(300)] + [prose(rng, 5000)]
    d = clash(docs_of([(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "a b")]))
    out = packing.pack(d).toPandas()
    t = tokens.encoder(tokens.default_path()).tokenizer
    want = []
    for i, x in [*enumerate(texts), (2, texts[2]), (-1, "a b")]:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = out[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64")
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 2048 and (s["length"].cumsum() - s["length"] == s["offset"]).all()
    assert out["sequence_id"].nunique() <= 1.05 * -(-out["length"].sum() // 2048) + 1
    assert packing.pack(docs_of([])).count() == 0


def test_best_fit():
    assert sorted(sorted(x) for x in packing.best_fit(np.array([6, 5, 5, 4]), 10)) == [[0, 3], [1, 2]]
    assert packing.best_fit(np.array([], dtype=int), 10) == []
    assert len(packing.best_fit(np.array([7] * 9), 10)) == 9


# ---- top-k

def test_top_k(spark, clash):
    rng = np.random.default_rng(8)
    v = [(i, (rng.normal(size=12) * 10.0 ** (i % 3 - 1)).tolist()) for i in range(700)]
    v[60] = (60, v[3][1])
    v[61] = (61, v[3][1])
    v += [(100, None), (150, [1.0, None]), (200, [float("nan")] * 12), (250, [float("inf")] * 12), (None, [1.0] * 12), (800, []), (801, [2.0, 1.0]), (50, [3.0] * 12)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    ok = [(i, np.floor(256 * np.pad(np.array(x, dtype=np.float32).astype(float), (0, 12 - len(x)))).astype(int)) for i, x in v
          if i is not None and x and all(y is not None and np.isfinite(y) for y in x)]
    want = []
    for i, x in ok:
        if i % 50 == 0:
            s = sorted(((-int(x @ y), j) for j, y in ok if j != i))[:5]
            want.append((i, s))
    got = topk.top_k(clash(d)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for i in by:
        if i != 50:  # an id that repeats asks twice
            assert by[i] == dict(want)[i]
    assert by.keys() == {i for i, _ in want}
    assert topk.top_k(d.limit(0)).count() == 0
    assert sorted(r["rank"] for r in topk.top_k(d.where("vec_id in (0, 1, 2)")).collect()) == [1, 2]


# ---- archives

def test_archives(spark, clash, scratch):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 300_000, "<p>é</p>", "a\r\n\r\nb", "x" * 300_000]
    d = clash(spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i else None, h) for i, h in enumerate(html)] + [(None, "u", "a\r\n\r\nb")],
                                    "page_id long, url string, html string"))
    listed = warc.write_archives(d.repartition(3), scratch_path(spark, "t"), archive_bytes=200)
    out = {r["page_id"]: r for r in warc.read_archives(listed).collect()}
    first = {}
    for i, h in enumerate(html):
        h = (h or "").encode()
        r = out[i]
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if h in first else ("response", None))
        assert r["payload"] == (None if h in first else h)
        first.setdefault(h, i)
    assert out[None]["record_type"] == "response"
    assert warc.round_trip(spark, d.limit(0)).count() == 0
    small = warc.read_archives(warc.write_archives(d, scratch_path(spark, "t"), min_bytes=100)).collect()
    assert {r["page_id"] for r in small if r["record_type"] == "revisit"} == {7}


def test_zip_directories(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(40):
            z.writestr(f"m/{i}", b"%d" % i * i, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.comment = b"PK and more"
    data = out.getvalue()
    found = warc.members(lambda o, n: data[o:o + n], len(data))
    assert len(found) == 40 and data[found["m/8"][1]:][:8] == b"8" * 8 and found["m/8"][0] == 0 and found["m/9"][0] == 8
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 10)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(40):
            z.writestr(f"m/{i}", b"%02d" % i * 60)
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    found = warc.members(lambda o, n: data[o:o + n], len(data))
    assert all(data[a:a + n] == b"%02d" % i * 60 for i, (_, a, n) in ((int(k[2:]), v) for k, v in found.items()))
    with pytest.raises(ValueError):
        warc.members(lambda o, n: b"no archive"[o:o + n], 10)


# ---- classifier

def test_trees_learn_and_flatten():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    trees = classifier.fit(x[:2000], y[:2000])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    for f, t, v in zip(trees.feature[:3], trees.threshold[:3], trees.leaf[:3]):
        for r in x[:20]:
            n = 0
            while n < len(f):
                n = 2 * n + 1 + (r[f[n]] > t[n])
            one = classifier.Trees(0.0, f[None], t[None], v[None])
            assert abs(one.raw(r[None])[0] - v[n - len(f)]) < 1e-12
    assert classifier.fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]
    assert classifier.fit(x[:9], np.ones(9)).probability(x[:2]).min() > 0.99


def test_classifier(docs_of, clash, spark):
    rng = random.Random(10)
    texts = [prose(rng, 100) if i % 2 else " ".join(w + "###" for w in prose(rng, 100).split()) for i in range(300)]
    d = docs_of([(i, t) for i, t in enumerate(texts)] + [(300, None), (301, ""), (302, "w " * 100_000), (None, texts[1]), (5, texts[5])])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, None), (None, 1)], "doc_id long, quality int")
    out = classifier.score(clash(d), labels).collect()
    assert len(out) == 305
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["doc_id"] >= 300 or r["predicted"] == r["doc_id"] % 2
    assert classifier.score(docs_of([]), labels).count() == 0
    assert {r["score"] for r in classifier.score(docs_of([(1, "a")]), labels.limit(0)).collect()} == {0.5}


# ---- language model

def test_gradient():
    rng = np.random.default_rng(11)
    a = lm.Attention()
    a.flat[:] = a.flat + rng.normal(0, 0.2, len(a.flat)).astype(np.float32)
    x, c = rng.integers(0, 50, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    theta, w = rng.random((3, lm.WINDOW, lm.CLASSES)).astype(np.float32), np.ones((3, lm.WINDOW), np.float32)
    g, _ = a.gradient(x, c, theta, w)
    step = rng.normal(size=len(g)).astype(np.float32) * (g != 0)

    def loss(t):
        b = lm.Attention((a.flat + t * step).astype(np.float32))
        return -np.log((b.forward(x, c)[0].astype(float) * theta).sum(axis=2)).mean()

    near = (loss(1e-3) - loss(-1e-3)) / 2e-3
    assert abs(near - float(g @ step)) < 0.03 * max(1, abs(near))


def test_attention_is_causal_and_windows_score_once():
    rng = np.random.default_rng(12)
    a = lm.Attention()
    x, c = rng.integers(0, 99, (2, lm.WINDOW)), rng.integers(0, lm.CLASSES, (2, lm.WINDOW))
    before = a.forward(x, c)[0][:, :20]
    x[:, 20:], c[:, 20:] = 1, 1
    assert np.allclose(before, a.forward(x, c)[0][:, :20], atol=1e-5)
    model = lm.Model.__new__(lm.Model)
    lengths = np.array([1, 5, 31, 32, 33, 56, 57, 500])
    start, scored, long, doc = model.windows(None, lengths)
    seen = Counter((d, int(s + k)) for s, f, n, d in zip(start, scored, long, doc) for k in range(f, n))
    begin = np.cumsum(lengths) - lengths
    assert seen == Counter((d, int(begin[d] + k)) for d, n in enumerate(lengths) for k in range(n))


def test_scores(docs_of, clash, spark):
    rng = random.Random(13)
    texts = [None, "", "The the THE é"] + [prose(rng, rng.randrange(20, 300), 300) for _ in range(150)] + ["zz " * 20_000]
    d = docs_of([(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, "the")])
    every = [*enumerate(texts), (9, texts[9]), (None, "the")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: WORD.findall((t or "").translate(low)) + [None]
    c = Counter(w for i, t in every if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    for limit in (10, 1 << 18):
        out = lm.scores(clash(d), top_words=limit).collect()
        assert len(out) == len(every)
        for r in out:
            i = r["doc_id"]
            w = words("the" if i is None else texts[i])
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
            assert abs(r["base_score"] - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
            assert np.isfinite(r["score"]) and r["score"] < 0
    assert lm.scores(docs_of([])).count() == 0


def test_probabilities_add_up(docs_of):
    rng = random.Random(14)
    d = docs_of([(i, prose(rng, 100)) for i in range(30)])
    from pyspark.sql import functions as F

    v = 49408
    ids = d.select("text").mapInPandas(lm._encoded(tokens.default_path(), v - 1), "ids binary")
    pairs = ids.mapInPandas(lm._pair_counts(v, v - 1), "lag int, pair long, n long").groupBy("lag", "pair").agg(F.sum("n").alias("n")).cache()
    row, kind = lm.id_classes(pairs, v)
    model = lm.Model(row, kind, lm.class_probabilities(pairs, kind, row, v), lm.Attention.start(row, kind))
    for x in (v - 1, int(pairs.head()["pair"] // v), 17):
        by_class, factor = model.given(np.full(v, x), np.arange(v))
        assert np.allclose((by_class * factor[:, None]).sum(axis=0, dtype=float), 1, atol=2e-3)


def test_fit_takes_all_training_ids(monkeypatch):
    rng, end = np.random.default_rng(15), 999
    docs = [np.append(rng.integers(0, end, n), end).astype("<u2") for n in (0, 1, 31, 32, 400, 5000)]
    took = Counter()

    def record(model, windows, seed):
        for x, t, n in windows:
            inside = np.arange(lm.WINDOW)[None, :] < n[:, None]
            took.update(zip(x[inside].tolist(), t[inside].tolist()))

    monkeypatch.setattr(lm, "fit_share", record)
    monkeypatch.setattr(lm, "SHARE", 7)
    monkeypatch.setattr(lm, "Model", lambda attention: type("M", (), {"attention": attention}))
    batch = pd.DataFrame({"k1": range(len(docs)), "ids": [d.tobytes() for d in docs]})
    weights = [r["weight"][0] for part in range(lm.ROUNDS) for r in lm._fit(type("S", (), {"value": ()}), end, lm.Attention().flat, part)([batch])]
    assert took == Counter(p for d in docs for p in zip([end, *d[:-1].tolist()], d.tolist()))
    assert sum(weights) == sum(map(len, docs))


def test_scores_know_pairs_beyond_the_broadcast(docs_of, monkeypatch):
    rng = random.Random(16)
    d = docs_of([(i, prose(rng, 60, 200)) for i in range(40)] + [(40, None)])
    every = {r["doc_id"]: r["score"] for r in lm.scores(d).collect()}
    monkeypatch.setattr(lm, "PAIRED", 8)
    monkeypatch.setattr(lm, "CHUNK_IDS", 500)
    for r in lm.scores(d).collect():
        assert abs(r["score"] - every[r["doc_id"]]) < 1e-2 * abs(every[r["doc_id"]])


def test_the_driver_gathers_packed_rows(spark, monkeypatch):
    words = [(b"w%d" % i, 1 + i % 90) for i in range(3000)] + [(b"", 5000)]
    df = spark.createDataFrame(words, "word binary, c long").repartition(3)
    for limit in (0, 10, 500, 10_000):
        got, counts = lm._frequent(df, limit)
        found = dict(zip(got.split(b" ") if got else [], counts.tolist()))
        assert len(found) == len(counts) <= limit and found.items() <= dict(words).items()
        assert all(c <= min(found.values(), default=91) for w, c in words if w and w not in found)
    assert len(counts) == 3000
    from pyspark.sql.classic.dataframe import DataFrame

    fetched, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda d: fetched.append(collect(d)) or fetched[-1])
    monkeypatch.setattr(DataFrame, "toPandas", None)
    pairs = spark.range(40_000).selectExpr("cast(if(id < 20000, 1, 4) as int) lag", "id * 7919 % (1000 * 1000) pair", "id % 5 + 1 n").repartition(2)
    row, kind = lm.id_classes(pairs, 1000)
    theta, overall, place, after, spare, sums, one = lm.class_probabilities(pairs, kind, row, 1000)
    assert max(map(len, fetched)) < 100  # rows, not one for each number
    every = [(p // 1000, p % 1000, n) for lag, p, n in collect(pairs) if lag == 1]
    n = Counter()
    for x, _, k in every:
        n[x] += k
    different = Counter(x for x, _ in {(x, t) for x, t, _ in every})
    for x, t, k in every[:200]:
        assert abs(after[place[x], place[t]] - k / (n[x] + different[x])) < 1e-6 and abs(one[x] - 1 / (n[x] + different[x])) < 1e-6


def test_counts_and_texts_pass_in_bounded_batches(spark, docs_of, monkeypatch):
    rng, end = np.random.default_rng(17), 49_407
    ids = [np.append(rng.integers(0, end, n), end).astype("<u2") for n in (0, 3, 150_000, 200_000)]
    out = list(lm._pair_counts(end + 1, end)([pd.DataFrame({"ids": [x.tobytes() for x in ids]})]))
    assert max(map(len, out)) <= 100_000
    got = {(lag, p): n for f in out for lag, p, n in f.itertuples(index=False, name=None)}
    want = Counter((lag, int(a) * (end + 1) + int(b)) for x in ids for lag in (1, lm.LAG) for a, b in zip([end] * lag + x.tolist(), x.tolist()))
    assert got == want

    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", scratch_path(spark, "most")
    before, encoded = spark.conf.get(name), lm._encoded

    def watched(path, end):
        run = encoded(path, end)

        def watch(batches):
            for b in run(batches):
                size = int(b["ids"].map(len).sum())
                os.makedirs(most.removeprefix("file:"), exist_ok=True)
                open(f"{most.removeprefix('file:')}/{size}", "w").close()
                yield b

        return watch

    monkeypatch.setattr(lm, "_encoded", watched)
    d = docs_of([(i, "word " * 1000) for i in range(8000)]).coalesce(1)
    assert lm.scores(d).count() == 8000
    assert max(map(int, os.listdir(most.removeprefix("file:")))) < 4_000_000  # 16 million bytes in one batch otherwise
    assert spark.conf.get(name) == before
