"""Token output, packing and counts against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlane.llm import counts, packing, repair, tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.default_path())


def plain(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet="ab,.'s\n\t  é　\x1cZ9😀!", max_size=40), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_pieces_give_the_library_ids(texts):
    enc = tokens.encoder(tokens.default_path())
    ids, off = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain(enc, t)


def test_whole_tables_give_the_library_ids(enc, documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    fresh = tokens.Encoder(tokens.default_path())
    ids, off = fresh.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain(enc, t)


@given(st.lists(st.text(alphabet="aZéß×÷ɏʰ.'-\n ", max_size=30), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_give_the_library_ids(texts):
    """Letters of two bytes, the signs among them, and line feeds, alone and in runs, before words; pieces that come again and new ones."""
    enc = tokens.encoder(tokens.default_path())
    ids, off = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain(enc, t)


def test_a_full_store_keeps_what_came_again(enc, monkeypatch):
    monkeypatch.setattr(tokens, "STORE", 1500)
    fresh, asked = tokens.Encoder(tokens.default_path()), []
    keep = fresh._keep
    monkeypatch.setattr(fresh, "_keep", lambda *a: (asked.append(a[-1].size), keep(*a))[1])
    common = " ".join(f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    for k in range(8):
        rare = " ".join(f"r{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
        text = f"{common} {rare}"
        assert fresh.encode(pa.array([text]))[0].tolist() == plain(enc, text)
    assert fresh.n <= 1500 + 900 and sum(asked[1:]) <= 7 * 402


def test_token_file(spark, edge, nothing, enc):
    assert repair.token_file(nothing).count() == 0
    got = repair.token_file(edge, shard_bytes=100_000).collect()
    rows = edge.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for d, t in rows:
        ids = [*plain(enc, t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=60), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_grammar_round_trip(docs):
    ids, ends = np.array([x for d in docs for x in d], np.uint32), np.cumsum([0, *map(len, docs)])
    seq, left, right, places = repair.grammar(ids, ends, 100, least=2)
    for lo, hi in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        assert lo <= hi
    assert repair.expand(seq, left, right, 100).tolist() == ids.tolist()
    s = repair.Shard(repair.dump(ids, ends, np.arange(len(docs)), np.zeros(len(docs)), 100))
    for i, d in enumerate(docs):
        assert s.document(i).tolist() == d and s.ids(i, 1, 4).tolist() == d[1:4]


def pair_counts(seq, places):
    """Places of each pair inside documents that do not overlap, from the left."""
    count, last = {}, {}
    for lo, hi in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        for i in range(lo, hi - 1):
            pair = int(seq[i]), int(seq[i + 1])
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                count[pair] = count.get(pair, 0) + 1
                last[pair] = i
            else:
                last[pair] = None
    return count


@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(2, 5))
@settings(max_examples=80, deadline=None)
def test_grammar_goes_on_until_no_pair_pays(docs, least):
    ids, ends = np.array([x for d in docs for x in d], np.uint32), np.cumsum([0, *map(len, docs)])
    seq, left, right, places = repair.grammar(ids, ends, 100, least=least)
    assert max(pair_counts(seq, places).values(), default=0) < least
    uses = np.bincount(np.concatenate([seq, left, right]), minlength=100 + left.size)[100:]
    assert (uses > 0).all()


@given(st.lists(st.integers(0, 90_000), min_size=1, max_size=70), st.integers(0, 70), st.integers(0, 70))
@settings(max_examples=60, deadline=None)
def test_wide_symbols(values, lo, hi):
    x = np.array(values, np.uint32)
    row = repair._Row(repair._packed(x, 17), 0, x.size, 17)
    assert row[lo:hi].tolist() == values[lo:hi] and row.end == 2 * x.size + -(-x.size // 8)


def test_shards_are_smaller_than_plain_ids(spark, documents, tmp_path, enc):
    repair.write_tokens(documents, f"file://{tmp_path}/ids", shard_bytes=300_000)
    rows = spark.read.parquet(f"file://{tmp_path}/ids").selectExpr("part", "n_tokens", "length(payload) AS size").collect()
    assert len(rows) > 1 and sum(r["size"] for r in rows) < 0.9 * 2 * sum(r["n_tokens"] for r in rows)


def test_token_file_of_null_and_repeated_ids(spark, enc):
    """Thousands of texts without an id, or with the same one, are dealt to several partitions and keep their order."""
    rows = [(None if i % 3 else 5, f"text {i * 7919 % 2000} of many") for i in range(2000)] + [(-1, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, repair.token_file(df, shard_bytes=4000, part_bytes=8000).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*plain(enc, t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_packing(edge, nothing, enc):
    assert packing.pack_documents(nothing).count() == 0
    got = packing.pack_documents(edge, with_ids=True).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    want = sorted((r[0] is None, r[0] or 0, len(plain(enc, r[1])) + 1) for r in edge.select("doc_id", "text").collect())
    sizes = got[got.doc_id == 6].sort_values("piece")
    assert sizes.length.tolist()[1:] == [2048] * (len(sizes) - 1) and sizes.start.tolist() == [0, *np.cumsum(sizes.length)[:-1]]
    assert got.length.sum() == sum(w[2] for w in want)
    assert got.sequence_id.nunique() <= 1.1 * -(-got.length.sum() // 2048) + 1


def squares(lengths, capacity):
    """Places by evaluating the sum of squares of each choice; the gap taken for each length."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for g in sorted({x for x in gaps if x >= s}) + [capacity]:
            new = list(gaps)
            if g < capacity:
                new.remove(g)
            if 0 < g - s < capacity:
                new.append(g - s)
            cost = sum(new.count(x) ** 2 for x in set(new))
            if best is None or cost < best[0]:
                best = cost, g, new
        gaps = best[2]
        out.append(best[1])
    return out


@given(st.lists(st.integers(1, 24), min_size=1, max_size=60))
@settings(max_examples=80, deadline=None)
def test_placement_follows_the_rule(lengths):
    b, o = packing.place(np.array(lengths), 24)
    assert (24 - o).tolist() == squares(lengths, 24)


@given(st.lists(st.integers(1, 32), min_size=1, max_size=80))
@settings(max_examples=80, deadline=None)
def test_placement_is_valid(lengths):
    n = np.sort(np.array(lengths))[::-1]
    first = packing.place(n, 32)[0]
    b, o = packing.settle(n, first, 32)
    for k in set(b.tolist()):
        i = np.flatnonzero(b == k)
        i = i[np.argsort(o[i])]
        assert o[i].tolist() == [0, *np.cumsum(n[i])[:-1]] and n[i].sum() <= 32
    assert len(set(b.tolist())) <= len(set(first.tolist()))
    assert len(set(first[b != first].tolist())) == len(set(first.tolist())) - len(set(b.tolist()))  # only saved bins lose pieces


def test_packing_is_close_to_the_bound():
    n = np.random.default_rng(2).gamma(1.5, 400, 9000).astype(int) % 2048 + 1
    n = np.sort(n)[::-1].copy()
    first = packing.place(n, 2048)[0]
    b, _ = packing.settle(n, first, 2048)
    assert np.unique(b).size <= 1.003 * -(-n.sum() // 2048)
    assert (b != first).mean() < 0.02


def test_packing_of_null_and_repeated_keys(spark):
    """Thousands of pieces without an id, or with the same one, are dealt to all shards."""
    rows = [(None if i % 2 else 7, 0, 0, 1 + i % 90, 5, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _shard string")
    got = packing.pack(df.repartition(3), capacity=100, shard=500).toPandas()
    assert len(got) == 4000 and got.length.sum() == sum(r[3] for r in rows) and set(got._shard) == {"x"}
    assert (got.sequence_id // 2**32).value_counts().between(300, 700).all()
    assert got.groupby("sequence_id").length.sum().max() <= 100


def test_counts_are_the_unigram_library(edge, nothing, documents):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = counts.vocabulary(counts.default_path())
    t = Tokenizer(models.Unigram([(p, float(s)) for p, s in v], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert counts.token_counts(nothing).count() == 0
    for df in (edge, documents.limit(60)):
        want = sorted((r[0] is None, r[0] or 0, len(t.encode(r[1] or "").ids)) for r in df.select("doc_id", "text").collect())
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in counts.token_counts(df).collect()) == want


def test_counts_with_ties():
    vit = counts.Viterbi([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.0), ("aba", -3.0)])
    assert vit.run("▁ab") == (-3.0, 2)
    assert vit.run("▁é")[1] == 2


def test_odd_characters_are_found_in_bytes():
    import re

    import numpy as np

    odd = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    mixed = "".join(np.random.default_rng(0).permutation(list(every)))
    for text in ("", "a", "\xa0", "x\u3000", "\u2028", "é", "\x7f\t\n", every, mixed):
        raw = text.encode()
        assert tokens.odd_places(np.frombuffer(raw, np.uint8)).tolist() == [m.start() for m in odd.finditer(raw)]


def test_a_grammar_scans_all_levels_seldom(monkeypatch):
    """Once for each level that is used up, not in each round."""
    n, scans = 60_000, []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def flatnonzero(self, x):
            scans.append(np.size(x) == n)
            return np.flatnonzero(x)

    ids = np.minimum(np.random.default_rng(1).zipf(1.4, n), 3000).astype(np.uint32)
    monkeypatch.setattr(repair, "np", Counting())
    seq, left, right, _ = repair.grammar(ids, np.array([0, n // 3, n]), 3001)
    assert (repair.expand(seq, left, right, 3001) == ids).all() and left.size > 500
    assert sum(scans) <= 20


def test_token_file_in_small_pieces(spark, tmp_path, monkeypatch):
    """A task gets batches of about one shard's text, and writes payloads in row groups of a few shards."""
    rows = [(i, f"{i} " + "some words of a text " * 45) for i in range(3000)]
    plainly, most = repair.mapped, 2 * 50_000 // 950

    def mapped(df, f, schema):
        def run(batches):
            def small(b):
                assert b.num_rows <= most, b.num_rows
                return b

            return f(map(small, batches))

        return plainly(df, run, schema)

    monkeypatch.setattr(repair, "mapped", mapped)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    repair.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids", shard_bytes=50_000)
    assert spark.conf.get(key) == before
    assert spark.read.parquet(f"file://{tmp_path}/ids").selectExpr("sum(n_docs)").first()[0] == 3000

    payloads = spark.range(12, numPartitions=1).selectExpr("id", "cast(repeat(sha2(cast(id AS string), 512), 16384) AS binary) AS payload")
    payloads.write.options(**repair._PARQUET).parquet(f"file://{tmp_path}/groups")
    (path,) = (tmp_path / "groups").glob("*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) <= 11 << 20
