import html
import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sparlane.llm import extract, importance, markup, middle

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain_resampling(docs, target, longest, buckets, seed, per_cent, least_words):
    words = lambda t: WORD.findall((t or "").translate(LOWER))

    def features(t):
        w = words(t)
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    f = [features(t) for _, t in docs]
    s, t = Counter(b for x in f for b in x), Counter(b for x in target for b in features(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for (i, text), x in zip(docs, f, strict=True):
        w = sum(map(gain, x)) // len(x) if x else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: per_cent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("longest", "buckets", "per_cent", "least"), [(1, 10_000, 10, 20), (3, 64, 50, 1), (2, 7, 100, 0)])
def test_resampling_equals_the_plain_version(spark, edge, sf_dir, longest, buckets, per_cent, least):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = importance.resampled(edge, target, longest, buckets, 2024, per_cent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = plain_resampling([(r.doc_id, r.text) for r in edge.collect()], [r.text for r in target.collect()], longest, buckets, 2024, per_cent, least)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_resampling_of_whole_tables(spark, sf_dir, documents):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain_resampling([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in target.collect()], 1, 10_000, 2024, 10, 20)
    assert sorted(map(tuple, importance.resampled(documents, target).collect()), key=str) == want


def test_resampling_ties_and_empty_tables(spark, edge, nothing):
    target = spark.createDataFrame([("a b c",), (None,)], "text string")
    same = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    ranks = [r.rank for r in importance.resampled(same, target, per_cent=25, least_words=2).collect()]
    assert sorted(x for x in ranks if x is not None) == list(range(1, 101)) and ranks.count(None) == 300
    assert importance.resampled(nothing, target).count() == 0
    assert importance.resampled(edge, target.where("false")).count() == edge.count()


def plain_middle(i, text):
    h = sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in middle.MARKS) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    a, m, z = text[:lo], text[lo:hi], text[hi:]
    return (i, n, "spm", lo, hi - lo, f"<S>{z}<P>{a}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", lo, hi - lo, f"<P>{a}<S>{z}<M>{m}")


def test_fill_in_middle_equals_the_plain_version(spark, edge, nothing, documents):
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<P<S", "é\U0001f600́ß" * 9, "\r\n", "<", ">"] * 4)], "doc_id long, text string")
    for docs in (edge, documents, marked, nothing):
        rows = docs.select("doc_id", "text").collect()
        got = middle.fill_in_middle(docs)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_middle(i, t or "") for i, t in rows), key=str)
        digests = [(r.doc_id, r.restored_sha256) for r in middle.digest(docs).collect()]
        assert sorted(digests, key=str) == sorted(((i, sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize(("unit", "pattern"), [("word", r"[0-9A-Za-z\x80-\U0010ffff]+|[\x09-\x0d ]+|[^0-9A-Za-z\x80-\U0010ffff\x09-\x0d ]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_units_stay_whole(edge, documents, unit, pattern):
    for docs in (edge, documents):
        text = {(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()}
        out = middle.fill_in_middle(docs, seed=5, unit=unit, fim_rate=100, spm_rate=50)
        kinds = Counter()
        for r in out.withColumn("back", middle.restored(F.col("form"), F.col("output"))).collect():
            units = re.findall(pattern, r.back)
            assert (r.doc_id, r.back) in text and r.n == len(units)
            kinds[r.form] += 1
            if r.form != "plain":
                cuts = {0, *accumulate(map(len, units))}
                assert r.prefix_chars in cuts and r.prefix_chars + r.middle_chars in cuts
        assert kinds["psm"] and kinds["spm"]
    with pytest.raises(ValueError, match="unit"):
        middle.classes(middle.np.zeros(1, middle.np.uint32), "page")


PAGE = """<!DOCTYPE html><html><head><title>No &amp; text</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
<nav><ul><li><a href="/">Home<li>About</ul></nav><div class="cookie-notice"><p>We use cookies</div><form action="x"><input value="q">Search here</form>
<main><article><header><h1>The  <em>real</em>&nbsp;title</h1></header><p>First &lt;paragraph&gt; with<br>a break, 3 < 4 &copy;<p>Second <b>bold<div class="ad">Buy now</div>
<script>var t="</p><p>bad</p>";</script><ul><li>one<li>two</ul><span class="share">Share me</span><table><tr><td>a<td>b</table><!-- <p>gone</p> --><p hidden>secret</p>
<section id="comments"><article class="comment"><p>First!</p></article></section><pre>x
 y</pre><p title='a>b' data-x="</article>">quoted</article></main><aside>More stories</aside><footer>&copy; all rights</footer></body></html>"""


def test_blocks_of_a_page():
    main = [t for z, t in markup.blocks(PAGE) if z == markup.MAIN]
    assert main == ["The real title", "First <paragraph> with a break, 3 < 4 ©", "Second bold", "one", "two", "a", "b", "x y", "quoted"]
    chrome = [t for z, t in markup.blocks(PAGE) if z not in (markup.MAIN,)]
    assert chrome == ["Site name", "Home", "About", "We use cookies", "Search here", "Buy now", "Share me", "secret", "First!", "More stories", "© all rights"]
    assert markup.blocks("") == [] and markup.blocks("<") == [(markup.OPEN, "<")] and markup.blocks("a<b") == [(markup.OPEN, "a")]
    assert markup.blocks("x</div>y</b><![CDATA[z]]><?php echo ?></>!") == [(markup.OPEN, "x"), (markup.OPEN, "y!")]
    assert markup.blocks("<script>never ends <p>a</p>") == [] and markup.blocks("a<!-- never ends <p>b") == [(markup.OPEN, "a")]
    assert markup.blocks("<form><article><p>in a form</article>log in</form>") == [(markup.MAIN, "in a form"), (markup.FORM, "log in")]
    assert markup.blocks("<div role='main'>x<div class='widget sidebar'>y</div>z</div>") == [(markup.MAIN, "x"), (markup.CHROME, "y"), (markup.MAIN, "z")]


def plain_main_text(rows, depth, least):
    """All runs of `depth` words by host in one dictionary."""
    pages = []
    for i, url, text in rows:
        found = markup.blocks(text or "")
        main = "\n".join(t for z, t in found if z == markup.MAIN)
        host = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", url or "")
        own = main or "\n".join(t for z, t in found if z == markup.OPEN)
        words = [(w, z == markup.OPEN) for z, t in found if z != markup.MAIN for w in [t.split(" ")]]
        pages.append((i, url, host[1].lower() if host else "", main, own, words))
    seen = defaultdict(set)
    for _, _, host, _, own, words in pages:
        flat = [w.translate(LOWER) for x, _ in words for w in x]
        for k in range(len(flat) - depth + 1):
            seen[host, *flat[k : k + depth]].add(own)
    out = []
    for i, url, host, main, _, words in pages:
        flat = [w.translate(LOWER) for x, _ in words for w in x]
        hit = set()
        for k in range(len(flat) - depth + 1):
            if len(seen[host, *flat[k : k + depth]]) >= least:
                hit.update(range(k, k + depth))
        parts, at = [], 0
        for x, own in words:
            if own:
                parts.append(" ".join(w for k, w in enumerate(x) if at + k not in hit))
            at += len(x)
        text = main or "\n".join(p for p in parts if p)
        out.append((i, url, text, len(text)))
    return sorted(out, key=str)


def _undeclared():
    bar = "Welcome to the daily herald the only paper that you will ever need"
    foot = "All rights reserved by the herald company of the city and its partners worldwide since 1901"
    rows = []
    for i in range(40):
        own = " ".join(f"w{i}x{k}" for k in range(30))
        rows.append((i, f"https://News.example.com:80/{i}", f"<div><p>{bar}</p><p>{own}</p><p>Story {i} ends here. {foot}</p></div>"))
        rows.append((100 + i, f"http://user@other{i}.example.com/", f"<p>{bar}<p>{own}"))
    copy = "<p>" + " ".join(f"c{k}" for k in range(40))
    rows += [(200, "http://copies.example.com/a", copy), (201, "http://copies.example.com/b", copy), (202, "http://copies.example.com/c", copy)]
    rows += [(300, None, copy), (301, "not a url", "<p>x"), (None, "http://e.example.com", None), (None, "http://e.example.com", ""), (302, "http://e.example.com", "&amp;&nbsp;&#x41; &notanentity; " * 9)]
    rows.append((303, "http://news.example.com/long", "<p>" + bar + "<p>" + "<p>".join(f"long {k} text {k % 7}" for k in range(50_000))))
    return rows


def test_repeated_runs_of_a_host(spark):
    rows = _undeclared()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumns({c: F.lit(1) for c in ("key", "host", "sig", "blocks", "gram", "text", "salt")})
    got = extract.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain_main_text(rows, extract.WORDS, extract.PAGES)
    by = {r[0]: r[2] for r in got}
    assert by[3] == " ".join(f"w3x{k}" for k in range(30)) + "\nStory 3" and by[103].startswith("Welcome") and by[200] == by[201] == " ".join(f"c{k}" for k in range(40))
    assert sorted(map(tuple, extract.main_text(pages, 5, 2).collect()), key=str) == plain_main_text(rows, 5, 2)
    assert extract.main_text(pages.where("false")).count() == 0


def test_suffix_groups_are_sorted():
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 500).astype(np.uint64)
    ends = np.array([0, 120, 120, 300, 303, 500])
    for depth in (1, 3, 5, 8):
        order, starts = extract.suffix_groups(tokens, ends, depth)
        grams = [tuple(tokens[i : i + depth]) for i in order]
        assert grams == sorted(grams) and sorted(order) == [i for a, b in zip(ends[:-1], ends[1:], strict=True) for i in range(a, b - depth + 1)]
        assert list(starts) == [k for k in range(len(grams)) if k == 0 or grams[k] != grams[k - 1]]


def test_article_of_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = []
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        text = "\n".join(p for p in parts if p)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, extract.main_text(pages).collect())) == sorted(want)


def test_what_a_host_adds_to_its_articles(spark):
    call = "Subscribe to the herald today and never miss a story from our newsroom again"
    foot = "Reporting by the staff of the herald in the city and abroad since 1901"
    shared = "a passage that some of the articles share word by word is their own text"
    rows, want = [], {}
    for i in range(20):
        own = [" ".join(f"w{i}x{j}y{k}" for k in range(30)) for j in range(2)] + ([shared] if i < 9 else [])
        rows.append((i, f"https://Herald.example.com/{i}", f"<nav>Home</nav><article><p>{own[0]}</p><p>{call.upper() if i % 2 else call}</p>" + "".join(f"<p>{x}" for x in own[2:]) + f"<p>{own[1]} {foot}</p></article>"))
        want[i] = "\n".join([own[0], *own[2:], own[1]])
        rows.append((100 + i, f"https://other{i}.example.com/", f"<article><p>{own[0]}</p><p>{call}</p></article>"))
        want[100 + i] = f"{own[0]}\n{call}"
        rows.append((200 + i, "https://copies.example.com/", f"<article><p>{' '.join(f'c{k}' for k in range(40))} {i}</p></article>"))
        want[200 + i] = " ".join(f"c{k}" for k in range(40)) + f" {i}"
    got = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)


def test_what_one_article_repeats_is_its_own(spark):
    line = "one line that a single article says again and again"
    rows = [(i, "http://few.example.com/", "<article>" + "".join(f"<p>{' '.join(f'v{i}x{j}y{k}' for k in range(20))}" for j in range(3)) + (f"<p>{line}" * 9 if i < 2 else "") + "</article>") for i in range(8)]
    rows += [(9 + i, "http://few.example.com/copy", rows[0][2]) for i in range(9)]
    table = extract.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))
    totals = spark.createDataFrame([(8,)], "total long").join(table.select(extract.F.xxhash64(extract.host(extract.F.col("url"))).alias("host")).distinct())
    assert extract.site_blocks(table, totals, extract.WORDS, extract.ARTICLES) is None
