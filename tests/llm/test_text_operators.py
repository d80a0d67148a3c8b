"""Decontamination, repeats, near-duplicates, language, quality and scoring against brute force, and their edges."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparlane.llm import decontaminate, language, near, quality, recurrent, repeats
from sparlane.llm.blocks import Table, hash_runs, text_bytes

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def hits(docs, items):
    win = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                win[tuple(w[k : k + 10])].add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if got := win.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return order(out)


def test_decontamination(spark, edge, nothing, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "seven WIZARDS"), (901, ""), (902, None), (None, "tiny"), (10, "jumps over the lazy dog while seven wizards quietly brew a"), (10, "x")], "item_id long, text string")
    items = bench.select(F.col("item_id").cast("long"), "text").union(extra)
    pairs = [tuple(r) for r in items.collect() if r[1] is not None]
    for df in (edge, documents):
        want = hits([tuple(r) for r in df.select("doc_id", "text").collect()], pairs)
        for size in (32 << 20, 4000):
            h = decontaminate.hits(df, items, block_bytes=size)
            got = h.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
            assert order(map(tuple, got.collect())) == want
            assert h.where("longest < 10 AND n_hit >= 10 AND size(spans) = 1 AND size(items) = 1 OR (longest = 0) <> (n_hit = 0) OR longest > n_hit").count() == 0
    assert decontaminate.report(nothing, items).count() == 0
    assert decontaminate.report(edge, items.where("false")).where("contaminated").count() == 0
    stay = decontaminate.decontaminate(edge, items)
    assert stay.columns == edge.columns
    assert stay.count() == sum(not r[-1] for r in hits([tuple(r) for r in edge.select("doc_id", "text").collect()], pairs))
    m = decontaminate.matches(documents, bench).toPandas()
    assert (m.length >= 10).all() and not m.duplicated(["item_id", "item_word"]).any()
    texts = {r[0]: words(r[1]) for r in documents.select("doc_id", "text").collect()}
    item = {str(r[0]): words(r[1]) for r in bench.collect()}
    for r in m.itertuples():
        assert texts[r.doc_id][r.doc_word : r.doc_word + r.length] == item[r.item_id][r.item_word : r.item_word + r.length]


def longest(docs, items, window=10):
    out = []
    for name, t in items:
        w = words(t)
        for i in range(len(w)):
            need = window if len(w) - i >= window else len(w) if i == 0 else None
            best = (0,)
            for d, text in docs:
                x = words(text)
                for k in range(len(x)):
                    n = 0
                    while i + n < len(w) and k + n < len(x) and w[i + n] == x[k + n]:
                        n += 1
                    best = max(best, (n, d is not None, -(d or 0), -k, d))
            if need and best[0] >= need:
                out.append((str(name), i, best[4], -best[3], best[0]))
    return order(out)


def test_longest_matches(spark):
    """Quotes of many lengths of each item, in all orders, and words that repeat."""
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 24))) for k in range(3)] + [(3, "la " * 14), (4, "two words"), (5, "x y z x y z x y z x y z x y z")]
    docs = []
    for i in range(60):
        w = items[i % 4][1].split()
        a = int(rng.integers(0, len(w) - 9))
        b = int(rng.integers(a + 9, len(w) + 1))
        docs.append((int(rng.integers(0, 40)) if i % 7 else None, " ".join(["before", "two", *w[a:b], "words" if i % 2 else "la", "two words" if i % 9 == 4 else ""])))
    docs += [(50, "la " * 30), (51, items[0][1]), (7, items[0][1] + " " + items[1][1]), (52, "x y z " * 9), (None, None), (53, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = longest(docs, items)
    for parts, size in ((1, 32 << 20), (1, 100), (5, 32 << 20)):
        got = decontaminate.matches(df.coalesce(1).repartition(parts), bench, block_bytes=size)
        assert order(map(tuple, got.select("item_id", "item_word", "doc_id", "doc_word", "length").collect())) == want
        most = {}
        for d, x in docs:
            own = longest([(d, x)], items)
            most[d] = max(most.get(d, 0), max((r[-1] for r in own), default=0))
        got = decontaminate.hits(df, bench, block_bytes=size).groupBy("doc_id").agg(F.max("longest")).collect()
        assert dict(map(tuple, got)) == most


def removed(rows, length=50):
    big = 1 << 63
    first = {}
    body = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in body:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(first.get(s, big), d)
    out = []
    for (d, t), (doc, _) in zip(body, rows, strict=True):
        cut = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                cut[i : i + length] = [True] * length
        runs = sum(c and not p for p, c in zip([False, *cut], cut, strict=False))
        out.append((doc, len(t), sum(cut), runs, hashlib.sha256(bytes(b for b, c in zip(t, cut, strict=True) if not c)).hexdigest()))
    return order(out)


def test_repeats(spark, edge, nothing, documents):
    short = edge.where("doc_id <> 6 OR doc_id IS NULL")
    for df in (short, documents.limit(120)):
        assert order(map(tuple, repeats.digest(df).collect())) == removed([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert repeats.digest(nothing).count() == 0
    out = repeats.without_repeats(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    cut = spark.createDataFrame([(1, "x" * 20 + "é" + "y" * 60), (2, "z" * 9 + "è" + "y" * 60 + "é")], "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in repeats.without_repeats(cut).collect()}
    assert text[2] == "z" * 9 + "è" + "é" or "y" not in text[2]


@pytest.mark.parametrize("shared", [0, repeats.SHARED_IDS])
def test_repeats_of_many_texts_with_one_id(spark, monkeypatch, shared):
    """Thousands of different texts, of many lengths, without an id or with the same one."""
    monkeypatch.setattr(repeats, "SHARED_IDS", shared)
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    passages = ["".join(rng.choice(letters, 70)) for _ in range(40)]
    rows = [(i, p) for i, p in enumerate(passages)]
    for i in range(4000):
        a, b = ("".join(rng.choice(letters, int(n))) for n in rng.integers(1, 60, 2))
        rows.append((None if i % 2 else 500, a + passages[i % 40][: int(rng.integers(40, 71))] + b))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert order(map(tuple, repeats.digest(df).collect())) == removed(rows)


@given(st.lists(st.binary(min_size=24, max_size=24), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_deep_shallow_order(rows):
    rows = [r[:2] * 9 + r[18:] if r[0] % 2 else b"\0" * 20 + r[20:] for r in rows]
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 24)
    got = [rows[i] for i in repeats.deep_shallow(x)]
    assert got == sorted(rows)


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    for m, top in ((0, 2), (1, 2), (2, 1), (500, 3), (3000, 1 << 60), (3000, 1)):
        x = rng.integers(0, top, (m, 3), dtype=np.uint64)
        assert (repeats.multikey_quicksort(x) == np.lexsort(x.T[::-1])).all()


def distance(a, b):
    """Words to insert, delete or replace, by the whole table of prefixes."""
    turn = np.arange(len(b) + 1)
    row = turn.copy()
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(new - turn) + turn
    return int(row[-1])


def alike(a, b, cut=0.8):
    longer = max(len(a), len(b))
    size = max(a.max(), b.max()) + 1
    if np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum() < cut * longer - 1e-9:
        return False  # too few words in common
    return min(len(a), len(b)) >= cut * longer - 1e-9 and 1 - distance(a, b) / longer >= cut - 1e-9


def classes(rows, cut=0.8):
    number = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in words(t)]) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(texts[i]) and len(texts[j]) and find(i) != find(j) and alike(texts[i], texts[j], cut):
                parent[find(i)] = find(j)
    group = collections.defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(i)
    out = []
    for g in group.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None) for i in g]
    return order(out)


def test_near_documents(spark, edge, nothing, documents):
    for df in (edge, documents):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = near.near_documents(df)
        assert order(map(tuple, got.select("doc_id", "class_id").collect())) == classes(rows)
    assert near.near_documents(nothing).count() == 0
    kept = near.one_of_each(edge)
    assert kept.columns == edge.columns
    want = classes([tuple(r) for r in edge.select("doc_id", "text").collect()])
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(9) == 1 and {3, 4, 5} <= set(ids) and want


def test_edits_are_exact():
    rng = np.random.default_rng(3)
    for _ in range(600):
        a = rng.integers(0, 5, rng.integers(1, 40))
        b = a[rng.random(a.size) < 0.9] if rng.random() < 0.6 else rng.integers(0, 5, rng.integers(1, 40))
        b = np.where(rng.random(b.size) < 0.1, 9, b)
        most, d = int(rng.integers(0, 30)), distance(a, b)
        assert near.edits(a.astype(np.uint64), b.astype(np.uint64), most) == min(d, most + 1)


def test_many_edits_are_those_one_by_one(monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 64)
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        a = rng.integers(1, 6, rng.integers(0, 150)).astype(np.uint64)
        texts += [a, a[rng.random(a.size) < 0.9], np.where(rng.random(a.size) < 0.1, np.uint64(9), a)]
    ia, ib = rng.integers(0, 120, 1500), rng.integers(0, 120, 1500)
    ia[:600], ib[:600] = np.arange(600) % 40 * 3, np.arange(600) % 40 * 3 + 1 + np.arange(600) // 300
    most = rng.integers(0, 80, 1500)
    got = near.edits_many(texts, ia, ib, most)
    assert got.tolist() == [near.edits(texts[i], texts[j], int(m)) for i, j, m in zip(ia, ib, most, strict=True)]
    assert (got[:600] <= most[:600]).sum() > 200


def test_near_recall(spark):
    """Pairs with up to a tenth of the words replaced, deleted or inserted, judged by the plain distance."""
    rng = np.random.default_rng(7)
    shapes, rows, want = [(12, 1), (30, 1), (30, 3), (60, 2), (60, 6), (120, 12), (400, 40)], [], collections.Counter()
    for n, changed in shapes:
        for _ in range(60):
            w = [f"w{x}" for x in rng.integers(0, 2000, n)]
            v = list(w)
            for j in sorted(rng.choice(n, changed, replace=False).tolist(), reverse=True):
                kind = rng.integers(0, 3)
                v[j : j + 1] = [] if kind == 0 else ["new" + v[j]] if kind == 1 else [v[j], "more"]
            number = {}
            want[n, changed] += alike(*(np.array([number.setdefault(x, len(number)) for x in t]) for t in (w, v)))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    got = near.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert ((got.class_id == got.doc_id) | ((got.doc_id % 2 == 1) & (got.class_id == got.doc_id - 1))).all()
    found = got[got.class_id < got.doc_id].doc_id // 120
    for i, shape in enumerate(shapes):
        assert want[shape] >= 59 and (found == i).sum() >= 0.95 * want[shape]


def test_near_recall_at_the_limit(spark):
    """Pairs with a fifth of the words replaced: all are links, of 12 to 1,000 words."""
    rng = np.random.default_rng(17)
    shapes, rows = [(12, 2), (20, 4), (40, 8), (63, 12), (64, 12), (80, 16), (100, 20), (150, 30), (300, 60), (1000, 200)], []
    for n, changed in shapes:
        for _ in range(200):
            w = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            v = list(w)
            for j in rng.choice(n, changed, replace=False).tolist():
                v[j] = "new" + v[j]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    got = near.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert ((got.class_id == got.doc_id) | ((got.doc_id % 2 == 1) & (got.class_id == got.doc_id - 1))).all()
    found = np.bincount(got[got.class_id < got.doc_id].doc_id // 400, minlength=len(shapes))
    assert (found >= 190).all(), dict(zip(shapes, found.tolist(), strict=True))


def test_language(edge, nothing, documents):
    out = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.95
    assert ((out.score >= 0) & (out.score <= 1)).all()
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(edge).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und")} <= got and (7, "und") not in got
    assert language.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    both = documents.sparkSession.createDataFrame([(1, " ".join(r["text"] for r in documents.where(F.col("lang") == x).limit(3).collect()), None) for x in ("en",)], "doc_id long, text string, lang string")
    mixed = both.withColumn("text", F.concat("text", F.lit(" " + documents.where("lang = 'de' AND n_chars > 2000").first()["text"])))
    model = language.learn(documents.select("text", "lang"))
    assert len(language.detect(mixed, model).first()["languages"]) >= 2
    kept = language.accepted(edge)
    assert kept.columns == edge.columns and {3, 4, 5, 8}.isdisjoint({r[0] for r in kept.select("doc_id").collect()})


def backward(model, text):
    """The languages that stay when the least goes while that costs under 2 log(1 + n)."""
    data, off = text_bytes(pa.array([text]))
    lp = model.logs[language.grams(data, off)[0]].astype(float)
    p = np.exp(lp - lp.max(1, keepdims=True))

    def em(use):
        pi = np.full(len(use), 1 / len(use))
        for _ in range(language.STEPS):
            r = p[:, use] * pi
            pi = (r / r.sum(1, keepdims=True)).mean(0)
        return pi, float(np.log(p[:, use] @ pi).sum())

    use = list(range(len(model.names)))
    pi, like = em(use)
    while len(use) > 1:
        less = [u for k, u in enumerate(use) if k != pi.argmin()]
        sub, low = em(less)
        if like - low >= 2 * math.log1p(len(lp)):
            break
        use, pi, like = less, sub, low
    return use, pi


def test_minor_second_languages(documents):
    rng = np.random.default_rng(0)
    model = language.learn(documents.select("text", "lang"))
    by = {x: " ".join(r["text"] for r in documents.where(F.col("lang") == x).limit(3).collect()).split() for x in ("en", "de")}
    texts = [" ".join(by["en"][a : a + n] + by["de"][a : a + k]) for n in (20, 60, 150) for k in range(1, 12) for a in rng.integers(0, 60, 2)]
    got = language.infer(model, *text_bytes(pa.array(texts)))
    size = []
    for text, row in zip(texts, got, strict=True):
        use, pi = backward(model, text)
        assert np.flatnonzero(row > 0).tolist() == use
        assert row[use] == pytest.approx(pi, abs=1e-3)
        size.append(len(use))
    assert min(size) == 1 and max(size) > 1


def test_quality(spark, edge, nothing, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert good.size and (not bad.size or (good[:, None] > bad[None]).mean() > 0.85)
    some = quality.quality(edge, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")))
    assert some.count() == edge.count() and some.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.quality(nothing, labels).count() == 0
    assert {r["score"] for r in quality.quality(edge, labels.where("false")).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((quality.N_STATS, quality.BINS - 1), np.float32), 0.3, rng.normal(size=quality.N_FEATURES).astype(np.float32), rng.normal(size=(quality.N_FEATURES, quality.RANK)).astype(np.float32))
    idx, x = np.array([3, 70, 500]), np.array([0.5, 1.5, -1.0], np.float32)
    want = 0.3 + (m.weight[idx] * x).sum() + sum(m.factor[idx[i]] @ m.factor[idx[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert quality._forward(m, idx, x, np.array([0]))[0][0] == pytest.approx(want, rel=1e-4)


def test_scoring_base_and_gain(edge, nothing, documents):
    for df in (edge, documents):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        toks = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), "\0end"] for _, t in rows]
        held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
        c = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
        n, z = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
        want = order((d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / z) for w in t), 4)) for (d, _), t, h in zip(rows, toks, held, strict=True))
        out = recurrent.language_model(df)
        assert order((*r[:5], round(r[5], 4)) for r in out.collect()) == want
    got = out.where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()
    assert recurrent.language_model(nothing).count() == 0


def plain_score(net, vocab, counts, text):
    """log10 probability of a text, one token after the other."""
    p, n, k = net.p, recurrent.UNITS, net.k
    ids = {int(h): i for i, h in enumerate(vocab.head)}
    h, x, total = np.zeros(n), k + 1, 0.0
    for token in recurrent.tokens(pa.array([text]))[0].tolist():
        e = p["emb"][x].astype(float)
        r, z = np.split(1 / (1 + np.exp(-(e[: 2 * n] + h @ p["u"][:, : 2 * n]))), 2)
        c = np.tanh(e[2 * n :] + (r * h) @ p["u"][:, 2 * n :])
        h = (1 - z) * c + z * h
        t = ids.get(token, k)
        a = h @ p["wc"] + p["bc"]
        cls = t // recurrent.CLASS if t < k else net.classes
        total += a[cls] - np.log(np.exp(a).sum())
        if t < k:
            b = (h @ p["wv"][cls] + p["bv"][cls])[: min(recurrent.CLASS, k - cls * recurrent.CLASS)]
            total += b[t % recurrent.CLASS] - np.log(np.exp(b).sum())
        else:
            total += np.log((counts.get(token, 0) + recurrent.SMOOTH) / vocab.rest)
        x = t
    return total / np.log(10)


def test_scores_are_those_of_the_plain_recurrence(edge, documents):
    df = documents.select("doc_id", "text").limit(80).union(edge.select("doc_id", "text"))
    rows = df.withColumn("held_out", language.held_out(10, 0))
    learn = rows.where("NOT held_out")
    counts = recurrent.written(recurrent.count_tokens(learn), "counts")
    vocab = recurrent.vocabulary(counts)
    flat = recurrent.train(learn, vocab)
    net = recurrent.Network(vocab, flat)
    have = {int(np.int64(r["h"]).view(np.uint64)): r["c"] for r in counts.collect()}
    turn = lambda r: (str(r[0]), r[1])
    want = sorted(((r["doc_id"], plain_score(net, vocab, have, r["text"] or "")) for r in df.collect()), key=turn)
    got = sorted(((r["doc_id"], r["score"]) for r in recurrent.score(rows, vocab, flat, counts).collect()), key=turn)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-3, abs=0.02)


def test_network_gradient_and_sum():
    v = recurrent.Vocabulary(np.arange(1, 61, dtype=np.uint64), np.arange(60, 0, -1), np.arange(1, 61, dtype=np.uint64), np.arange(60, 0, -1), 3000, 90)
    net = recurrent.Network(v)
    net.flat += np.random.default_rng(0).normal(0, 0.2, net.flat.size).astype(np.float32)
    s = np.random.default_rng(1).normal(size=(1, recurrent.UNITS)).astype(np.float32)
    p = np.exp(net.outputs(np.repeat(s, 61, 0), np.arange(61), False)[0])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    x, t = np.random.default_rng(2).integers(0, 60, (5, 3)), np.random.default_rng(3).integers(0, 61, 15)
    new = np.zeros((5, 3), bool)
    new[2, 1] = True
    h0 = np.full((3, recurrent.UNITS), 0.1, np.float32)

    def loss():
        st, _, _ = net.steps(x, new, h0, False)
        return -float(net.outputs(st.reshape(-1, recurrent.UNITS), t, False)[0].astype(np.float64).sum())

    st_, _, kept = net.steps(x, new, h0, True)
    _, g, ds = net.outputs(st_.reshape(-1, recurrent.UNITS), t, True)
    net.inputs(x.ravel(), net.back(new, kept, ds.reshape(st_.shape), g), g)
    for name, at in (("u", (3, 7)), ("u", (2, 40)), ("emb", (int(x[0, 0]), 5)), ("wc", (4, 1)), ("wv", (0, 3, 2))):
        p, e = net.p[name], 1e-2
        old = p[at]
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=0.08, abs=0.02)


@pytest.mark.parametrize("batch", [1, recurrent.BATCH])
def test_every_window_teaches(monkeypatch, batch):
    monkeypatch.setattr(recurrent, "BATCH", batch)
    v = recurrent.Vocabulary(np.arange(1, 61, dtype=np.uint64), np.arange(60, 0, -1), np.arange(1, 61, dtype=np.uint64), np.arange(60, 0, -1), 3000, 90)
    steps = 6 * recurrent.WINDOW
    for w in range(6):
        learner = recurrent.Learner(recurrent.Network(v), recurrent.RATE)
        before = learner.net.p["emb"].copy()
        target = np.full(steps, 3)
        target[w * recurrent.WINDOW + 5] = 50  # stands in one window alone, and is the input of its next step
        learner.learn(target, np.array([0, steps]))
        assert learner.n == (6 if batch == 1 else 1)
        assert (learner.net.p["emb"][50] != before[50]).any()


def test_hash_table():
    t, rng = Table(2), np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 62, 5000, dtype=np.uint64))
    for lot in np.array_split(keys, 7):
        t.add(lot, (lot % np.uint64(1000)).astype(np.int32))
    assert (t.find(keys) == (keys % np.uint64(1000)).astype(np.int32)).all()
    assert (t.find(keys + np.uint64(1 << 63)) == -1).all()
    data = np.frombuffer(b"abc" * 50 + b"x" + b"abc" * 50, np.uint8)
    a = hash_runs(data, np.array([0, 151]), np.array([150, 301]))
    assert a[0] == a[1]


def test_near_documents_in_a_large_group(spark):
    """Copies with many edits: most pairs lie near the limit, and buckets are large enough to be tested inside a task."""
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(160)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(160, int(rng.integers(1, 7)), replace=False):
            w[j] = f"new{i}x{j}"
        rows.append((i, " ".join(w)))
    got = near.near_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order(map(tuple, got.select("doc_id", "class_id").collect())) == classes(rows)


def plain_quality(m, text, n_chars):
    """The score by loops: word counts, statistics one by one, and all pairs of features."""
    raw = (text or "").encode()
    found = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))
    count = {}
    for w in found:
        b = int(hash_runs(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) & ((1 << quality.WORD_BITS) - 1)
        count[b] = count.get(b, 0) + 1
    norm = max(sum(count.values()) ** 0.5, 1e-9)
    x = [(b, c**0.5 / norm) for b, c in count.items()]
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    kind = lambda values: sum(c in values for c in raw) / max(len(raw), 1)
    stats = [kind(set(v)) for v in quality._SETS.values()]
    stats += [max(len(raw), 1) / max(len(found), 1) / 20, len(set(found)) / max(len(found), 1), 1 - len(set(lines)) / max(len(lines), 1)]
    stats += [math.log1p(len(raw) / max(len(lines), 1)) / 8, math.log1p(len(found)) / 12, math.log1p(len(raw)) / 14, math.log1p(len(raw) if n_chars is None else max(n_chars, 0)) / 14]
    for i, v in enumerate(np.float32(stats)):
        base = (1 << quality.WORD_BITS) + i * (quality.BINS + 2)
        x += [(base + sum(bool(v > e) for e in m.edges[i]), 1.0), (base + quality.BINS, float(v)), (base + quality.BINS + 1, float(v) ** 2)]
    z = m.bias + sum(float(m.weight[i]) * a for i, a in x)
    z += sum(float(m.factor[i] @ m.factor[j]) * a * b for k, (i, a) in enumerate(x) for j, b in x[:k])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_equals_the_plain_version(spark, edge, documents, sf_dir):
    machine = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    short = documents.where("length(text) < 900").select("doc_id", "text", "n_chars").union(edge.where("text IS NULL OR length(text) < 900").select("doc_id", "text", "n_chars"))
    got = quality.score(short.withColumns({"t": F.col("text"), "m": F.col("n_chars")}), machine, ("t", "m")).collect()
    assert len(got) > 20
    for r in got:
        assert r.score == pytest.approx(plain_quality(machine, r.t, r.m), abs=2e-4)


def test_quality_learns_from_a_bounded_number_of_rows(spark, documents, sf_dir, monkeypatch):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    hot = labels.first().doc_id
    many = documents.where(F.col("doc_id") == hot).crossJoin(spark.range(3000)).withColumn("text", F.concat("text", F.col("id").cast("string"))).drop("id")
    again = labels.where(F.col("doc_id") == hot).crossJoin(spark.range(3000)).drop("id")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda rows, label, **k: sizes.append((len(rows), label.size)))
    for sample in (50, 1 << 20):
        quality.train(documents.unionByName(many), labels.unionByName(again), sample)
    ids = labels.select("doc_id").distinct().count()
    assert 20 <= sizes[0][0] <= 90 and sizes[1] == (ids, ids)
    quality.train(documents.drop("n_chars"), labels)


def test_a_long_text_takes_no_more_than_its_length():
    """A text of 400,000 tokens beside 3,000 short ones: windows are made one by one, and the scores are those of each text alone."""
    v = recurrent.Vocabulary(np.arange(1, 61, dtype=np.uint64), np.arange(60, 0, -1), np.arange(1, 61, dtype=np.uint64), np.arange(60, 0, -1), 3000, 90)
    net = recurrent.Network(v)
    rng = np.random.default_rng(5)
    n = np.concatenate([rng.integers(1, 60, 1500), [400_000], rng.integers(1, 60, 1500)])
    off = np.concatenate([[0], np.cumsum(n)])
    target = rng.integers(0, 61, off[-1]).astype(np.int32)
    tracemalloc.start()
    got = recurrent.score_texts(net, target, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * target.size + 50e6
    for i in (0, 7, 1499, 1501, 2999):
        one = recurrent.score_texts(net, target[off[i] : off[i + 1]], np.array([0, n[i]]))
        assert got[i] == pytest.approx(one[0], rel=1e-4)


def test_lanes_hold_every_token_once():
    rng = np.random.default_rng(8)
    off = np.concatenate([[0], np.cumsum(rng.integers(1, 40, 90))])
    target = rng.integers(0, 50, off[-1]).astype(np.int32)
    lanes = recurrent.Lanes(target, off, 7, 50)
    seen = collections.defaultdict(list)
    for lo, hi, n in recurrent._windows(lanes.active, 5):
        t, x, who, new = lanes.window(lo, hi, n)
        assert ((t >= 0) == (who >= 0)).all() and (x[t < 0] == 51).all() and (x[new] == 51).all()
        for lane in range(n):
            for s in range(hi - lo):
                if t[s, lane] >= 0:
                    seen[who[s, lane]].append((int(t[s, lane]), int(x[s, lane]), bool(new[s, lane])))
    for d in range(90):
        own = target[off[d] : off[d + 1]].tolist()
        assert seen[d] == list(zip(own, [51, *own[:-1]], [True] + [False] * (len(own) - 1), strict=True))


def test_network_equals_the_plain_model():
    """Probabilities and gradients of a window against plain sums, for small weights and for weights whose exponentials overflow."""
    rng = np.random.default_rng(4)
    vocab = recurrent.Vocabulary(np.arange(1, 101, dtype=np.uint64), np.arange(200, 100, -1), np.arange(1, 101, dtype=np.uint64), np.arange(200, 100, -1), 20_000, 150)
    ids, target = rng.integers(0, 102, (5, 7)), rng.integers(0, 101, 35)
    fresh = rng.random((5, 7)) < 0.2
    for scale in (1, 40):
        net = recurrent.Network(vocab)
        net.p["wc"][:] = rng.normal(0, scale, net.p["wc"].shape)
        net.p["wv"][:] = rng.normal(0, scale, net.p["wv"].shape)

        def loss(p, net=net):
            n, h, total = recurrent.UNITS, np.zeros((7, recurrent.UNITS)), []
            for t in range(5):
                h = np.where(fresh[t][:, None], 0, h)
                a = 1 / (1 + np.exp(-(h @ p["u"][:, : 2 * n] + p["emb"][ids[t]][:, : 2 * n])))
                c = np.tanh((a[:, :n] * h) @ p["u"][:, 2 * n :] + p["emb"][ids[t]][:, 2 * n :])
                h = c + a[:, n:] * (h - c)
                for s, g in zip(h, target.reshape(5, 7)[t], strict=True):
                    b = s @ p["wc"] + p["bc"]
                    k = g // recurrent.CLASS if g < 100 else net.classes
                    total.append(b[k] - np.logaddexp.reduce(b))
                    if g < 100:
                        b = s @ p["wv"][k] + p["bv"][k] + net.slots[k]
                        total[-1] += b[g % recurrent.CLASS] - np.logaddexp.reduce(b)
            return np.array(total)

        plain = {k: v.astype(np.float64) for k, v in net.p.items()}
        s, _, kept = net.steps(ids, fresh, np.zeros((7, recurrent.UNITS), np.float32), True)
        logp, g, ds = net.outputs(s.reshape(35, -1), target, True)
        assert np.allclose(logp, loss(plain), rtol=1e-3, atol=1e-3)
        net.inputs(ids.ravel(), net.back(fresh, kept, ds.reshape(5, 7, -1), g), g)
        if scale == 1:
            for name in plain:
                at = np.unravel_index(np.abs(g[name]).argmax(), plain[name].shape)
                moved = [{**plain, name: plain[name].copy()} for _ in range(2)]
                moved[0][name][at] += 1e-5
                moved[1][name][at] -= 1e-5
                assert np.isclose(g[name][at], (loss(moved[1]).sum() - loss(moved[0]).sum()) / 2e-5, rtol=2e-2), name


def test_hashes_of_runs_with_gaps():
    from sparlane.llm import blocks

    data = np.frombuffer(b"one two" + b" " * 99 + b"one " + b"x" * 200 + b" two one", np.uint8)
    st, en = blocks.spans(data, np.array([0, data.size]), blocks.TOKEN_BYTES)
    h = blocks.hash_runs(data, st, en)
    assert h[0] == h[2] == h[5] and h[1] == h[4] and np.unique(h).size == 3
    some = np.array([0, 3, 5])
    assert (blocks.hash_runs(data, st[some], en[some]) == h[some]).all() and (blocks.hash_runs(data, st[[2, 5]], en[[2, 5]]) == h[[2, 5]]).all()
