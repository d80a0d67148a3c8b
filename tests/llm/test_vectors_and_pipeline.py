"""Near-duplicate vectors against brute force, connected components, and the pipeline."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparlane.llm import near, queries, shared, vectors


def brute(rows, cut=0.93):
    v = []
    for i, e, label in rows:
        x = None if e is None or any(c is None for c in e) else np.array(e, float)
        ok = x is not None and label is not None and x.size and np.isfinite(x).all() and np.abs(x).max() > 0
        v.append((i, x / np.abs(x).max() if ok else None, label))
    link = collections.defaultdict(set)
    for a in range(len(v)):
        for b in range(a):
            x, y = v[a][1], v[b][1]
            if x is not None and y is not None and v[a][2] == v[b][2] and x.size == y.size and x @ y >= cut * np.sqrt((x @ x) * (y @ y)):
                link[a].add(b)
                link[b].add(a)
    out = []
    for a in range(len(v)):
        seen, todo = {a}, [a]
        while todo:
            for n in link[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        ids = [v[i][0] for i in seen if v[i][0] is not None]
        c = min(ids) if ids else None
        out.append((v[a][0], len(link[a]), c, v[a][0] == c))
    return sorted(out, key=str)


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for g in range(12):
        base = rng.normal(size=48)
        for _ in range(1 + 3 * g):
            rows.append((n, [float(x) for x in base + rng.normal(size=48) * 0.22], g % 3))
            n += 1
    inf, nan = float("inf"), float("nan")
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 48, 1), (503, [1.0] * 47 + [None], 1), (504, [nan] * 48, 1), (505, [inf] * 48, 1), (506, rows[0][1], None), (507, rows[0][1], 0), (507, rows[0][1], 0), (508, rows[0][1][:40], 0), (None, rows[0][1], 0), (509, [1e200] * 48, 2), (510, [1e-200] * 48, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("rid", "key", "keys", "codes", "component")}).repartition(3)
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.ones(16) + rng.normal(size=16) * 0.05], 1) for i in range(150)]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.near_vectors(df).toPandas()
    assert (got.n_links == 149).all() and (got.component_id == 0).all() and got.kept.sum() == 1


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), 8 * x)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[105] == got[100] == 100
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir):
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
        left.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert left[0] >= left[1] >= left[2] == left[1] and left[3] < left[2]
    assert corpus_pipeline.run(spark, sf_dir).count() == left[4]
    assert docs.select("doc_id").distinct().count() == left[3]


def test_pipeline_on_edges(spark, edge, sf_dir):
    docs, kept = edge, []
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), "edge")
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    language, near, repeats, clean, packed = kept
    assert {3, 4, 5, 8}.isdisjoint(language) and {1, 2, 6, 9, None} <= set(language)  # no letter, null, empty
    assert near.count(1) == 1 and 2 not in near and near.count(9) == 1 and {6, None} <= set(near)  # copies, repeated rows, one near copy
    assert sorted(near, key=str) == sorted(repeats, key=str) == sorted(clean, key=str)
    assert set(packed) == set(clean) and packed.count(1) == 1 and packed.count(6) > 10
    size = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert size.where("n <> end OR n > 2048").count() == 0
    none = edge.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = shared.written(stage(spark, none, sf_dir), "edge")
        assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    key, table = {"op2": ("vec_id", "embeddings"), "op12": ("page_id", "pages")}.get(name.partition("_")[0], ("doc_id", "documents"))
    assert out.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()


def test_labels_of_any_type(spark):
    """Labels that differ only behind the point, or are text, are different labels."""
    rows = [(i, [1.0, 0.0, 0.01 * i]) for i in range(4)]
    for labels, kind in (([1.2, 1.7, 1.2, None], "double"), (["a", "b", "a", None], "string"), ([1, 2, 1, None], "int")):
        df = spark.createDataFrame([(*r, x) for r, x in zip(rows, labels, strict=True)], f"vec_id long, embedding array<double>, label {kind}")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
        assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (0, 3)}


def test_a_round_of_components_deals_its_edges_three_times(spark, monkeypatch):
    """Both ends by node, the large stars' edges by node, the distinct ones: joins and least neighbours need no more exchanges."""
    from sparlane.llm import shared

    plans = []

    def seen(df, name, write=shared.written):
        plans.append(df._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_COL") and df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(shared, "written", seen)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in shared.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    rounds = [p for p in plans if p]
    assert rounds and all(p.count("ENSURE_REQUIREMENTS") <= 1 for p in rounds)


def test_near_documents_write_few_tables(spark, documents, monkeypatch):
    """Two rounds of pairs, the first with two rounds of components: each table written is some stages over all shuffle partitions."""
    names = []
    for module in (near, shared):
        monkeypatch.setattr(module, "written", lambda df, name, write=shared.written: names.append(name) or write(df, name))
    near.near_documents(documents).count()
    assert names.count("pairs") == 2 and names.count("edges") <= 7 and len(names) <= 19


def test_a_large_bucket_tests_few_pairs(monkeypatch):
    """Of 300 near copies and 20 other texts all 51,040 pairs are allowed; joined ones are not tested again, and every link is kept."""
    rng = np.random.default_rng(3)
    base, tried = rng.integers(1, 1 << 60, (21, 100)).astype(np.uint64), []
    text = [base[0].copy() for _ in range(300)] + list(base[1:])
    for t in text[:300]:
        t[rng.choice(100, 6, replace=False)] = rng.integers(1, 1 << 60, 6)
    monkeypatch.setattr(near, "edits_many", lambda t, a, b, most, f=near.edits_many: tried.append(a.size) or f(t, a, b, most))
    ia, ib = np.triu_indices(320, 1)
    bucket = near._Bucket([t.tobytes() for t in text], np.arange(320), 0.8)
    links = bucket.links(ia, ib, np.zeros(ia.size, np.int64))
    assert len(links) == 299 and (bucket.root[:300] == 0).all() and (bucket.root[300:] == np.arange(300, 320)).all()
    assert sum(tried) < 3000
