"""Operators 4, 5 and 10."""

import base64
import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from meterlens.llm import html_template, packing, warc_zst

SF_DIR = "/root/testdata/sf0.001"


def _expected(rows):
    largest = {}
    for page_id, _, html in rows:
        key = html or ""
        largest[key] = max((x for x in (largest.get(key), page_id) if x is not None), default=None)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        top = largest[html or ""]
        response = top is None or page_id == top
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


def test_archives_give_back_every_record(spark, odd_pages, no_pages):
    rows = [(r.page_id, r.url, r.html) for r in odd_pages.collect()]
    got = warc_zst.records(warc_zst.archives(spark, odd_pages.repartition(3)))
    assert sorted(map(tuple, got.collect()), key=str) == _expected(rows)
    assert warc_zst.archives(spark, no_pages).count() == 0
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html")
    got = warc_zst.records(warc_zst.archives(spark, pages, most=20_000))
    assert sorted(map(tuple, got.collect()), key=str) == _expected([tuple(r) for r in pages.collect()])


def test_archive_layout(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    (row,) = warc_zst.archives(spark, pages.coalesce(1)).collect()
    data = bytes(row.data)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec"  # a trained dictionary
    # each record alone, by its offset, and smaller than without the dictionary
    held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    at, n = 8 + size, 0
    while at < len(data):
        frame = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
        record = frame.decompress(data[at:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at, n = len(data) - len(frame.unused_data), n + 1
    assert n == row.n_records == pages.count()


def test_small_payloads_can_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "x" * 99), (4, "u", "x" * 99)], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc_zst.records(warc_zst.archives(spark, df, min_bytes=10)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_dictionary_samples_reach_into_records(monkeypatch):
    seen = []
    monkeypatch.setattr(warc_zst.zstandard, "train_dictionary", lambda size, samples, level: seen.extend(samples) or warc_zst.zstandard.ZstdCompressionDict(b" " * 8))
    records = [b"h" * 1000 + bytes([65 + k % 26]) * 7000 for k in range(1000)]
    warc_zst._dictionary(records, 1 << 20)
    assert sum(map(len, seen)) <= 1 << 20 and len(seen) == 1000
    assert sum(s.count(b"h") for s in seen) < 0.25 * sum(map(len, seen))
    ends = sum(r.endswith(s) or s in r[4000:] for r, s in zip(records, seen, strict=True))
    assert ends > 300
    seen.clear()
    warc_zst._dictionary([b"%d" % k * 300 for k in range(10000)], 1 << 20)
    assert 4000 <= len(seen) and sum(map(len, seen)) <= 1 << 20


def test_damage_is_noticed():
    good = warc_zst.write_archive([b"WARC/1.1\r\n" + bytes([k]) * 50 for k in range(20)])
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc_zst.read_archive(b"\0" + good[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist()
    rows = packing.best_fit_decreasing(lengths, capacity)
    expected = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [(capacity - sum(lengths[x] for x in row), r) for r, row in enumerate(expected) if capacity - sum(lengths[x] for x in row) >= lengths[k]]
        if fits:
            expected[min(fits)[1]].append(k)
        else:
            expected.append([k])
    assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
    assert len(rows) == len(expected) and all(sum(lengths[k] for k in row) <= capacity for row in rows)
    # room sizes agree row for row; which of several equally full rows is taken is free
    assert sorted(sum(lengths[k] for k in row) for row in rows) == sorted(sum(lengths[k] for k in row) for row in expected)


@pytest.mark.parametrize("options", [{}, {"seq_len": 64, "block_tokens": 5000}])
def test_texts_come_back_whole(spark, options):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").repartition(3)
    extra = [(-1, "<|endoftext|> <|endoftext|>"), (-2, " \n "), (-3, "\U0001f600 漢字\x00\r\n"), (-4, "word " * 9000)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.packed(docs, **options)
    seq_len = options.get("seq_len", packing.SEQ_LEN)
    for r in rows.collect():
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        edges = r.cu_seqlens
        assert len(ids) == len(positions) == seq_len and edges[0] == 0 and edges[-1] == r.n_tokens <= seq_len
        assert len(edges) == len(r.seg_docs) + 1 == len(r.seg_offsets) + 1
        for lo, hi in zip(edges, edges[1:], strict=False):
            assert positions[lo:hi].tolist() == list(range(hi - lo)) and hi > lo
        assert (ids[r.n_tokens :] == packing.END_OF_TEXT).all() and not positions[r.n_tokens :].any()
    assert {(r.doc_id, r.text) for r in packing.unpacked(rows).collect()} == {(r.doc_id, r.text) for r in docs.collect() if r.text}


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    segments = [d for r in packing.packed(odd_docs.coalesce(1), seq_len=1 << 20).collect() for d in r.seg_docs]
    assert sorted(map(str, segments)) == sorted("1 2 2 2 5 None None 6 7 8".split())
    assert packing.packed(no_docs).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<aside>Also read</aside><div id="sidebar-left"><p>tags</p></div><!-- <p>no</p> -->
<article class=post><h2>A &amp; B</h2><p>One <b>two</b>
 three&nbsp;four<br>five<p>Six &eacute;&#x1F600; &lt;p&gt;<ul><li>x<li>y</ul><script>var s = "</p><p>no";</script>
<form><input value=q><button>Go</button></form><table><tr><td>c1<td>c2</table>
<div class="ad">Buy</div><div class="share-buttons">Share</div><pre>k  l</pre></article>
<section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    assert html_template.text_alone(ARTICLE).split("\n") == ["A & B", "One two three four five", "Six é😀 <p>", "x", "y", "c1", "c2", "k l"]
    assert html_template.text_alone("text < 3 and <b>bold</b> &amp") == "text < 3 and bold &"
    assert html_template.text_alone("<p title='a>b'>x</p><p class=\"y>z</p>").startswith("x")


@pytest.mark.parametrize("html,text", [
    ("<html><head><title>t</title><body><p>Text</p>", "Text"),
    ("<html><head><title>t</title><p>Text</p>", "Text"),
    ('<div class="content has-sidebar"><p>The text of the article</p><div class=sidebar>side</div></div>', "The text of the article"),
    ('<div class="no-comments header-fixed"><article><p>The article</p></article><footer>f</footer></div>', "The article"),
    ("<p>intro</p><article>card</article><p>main body of the page</p>", "intro\ncard\nmain body of the page"),
    ("<article><h1>T</h1><section id=social-history><p>A long section on the history of social things</p></section><p>more of it</p></article>",
     "T\nA long section on the history of social things\nmore of it"),
    ("<p>a</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul>", "a\none\ntwo"),
    ("<form id=page><div><p>All of a page in one form</p></div><button>Go</button></form>", "All of a page in one form"),
])
def test_nothing_but_outside_parts_is_dropped(html, text):
    assert html_template.text_alone(html) == text


def _extracted(spark, rows, n=5):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").repartition(n)
    return {r.page_id: r.text for r in html_template.extracted(spark, df).collect()}


def test_the_template_decides_where_no_name_tells(spark):
    """Neither elements nor classes name a menu or a footer; the host's slots do."""
    def page(k):
        links = "".join(f"<a href=/{k}{i}>topic {k} {i}</a> " for i in range(k % 3 + 2))
        body = "".join(f"<p>Sentence {i} of page {k}, with <a href=x>a link</a> in it</p>" for i in range(k % 4 + 1))
        return f"<body><div class=k1>{links}</div><div class=k2><h2>Head {k}</h2>{body}</div><div class=k3>All rights kept</div></body>"

    rows = [("http://plain.example/", page(k)) for k in range(24)]
    got = _extracted(spark, rows)
    for k, (_, html) in enumerate(rows):
        want = [f"Head {k}", *(f"Sentence {i} of page {k}, with a link in it" for i in range(k % 4 + 1))]
        assert got[k].split("\n") == want
        alone = html_template.text_alone(html).split("\n")
        assert alone[0].startswith("topic") and alone[1:-1] == want and alone[-1] == "All rights kept", "without a template all of it stays"


def test_an_article_on_most_pages_is_the_region_of_its_host(spark):
    """A short article, between longer texts that nothing names, is known from the host's other pages."""
    page = lambda k, n: f"<body><p>Intro of {k}</p><article><p>{f'Text {k} ' * n}</p></article><p>Outro {k}, which is rather long</p></body>"
    rows = [("http://h.example/", page(k, 40 if k else 1)) for k in range(12)]
    got = _extracted(spark, rows)
    assert got[0] == "Text 0" and got[3] == " ".join(["Text 3"] * 40)
    assert html_template.text_alone(rows[0][1]).split("\n") == ["Intro of 0", "Text 0", "Outro 0, which is rather long"]


def test_templates_are_the_gathered_occurrence_vectors(spark):
    """Classes from vectors written out, against those of the fingerprints."""
    import random
    from collections import defaultdict

    rng = random.Random(2)
    def page(k, host):  # noqa: E306
        part = "".join(f"<div class=r{rng.randrange(3)}><p>x{k}{i}</p></div>" for i in range(rng.randrange(4)))
        odd = "<section><em>e</em></section>" if rng.random() < 0.6 else ""
        return f"<html><body class=b{host}><div id=top><ul><li>a<li>b</ul></div>{odd}{part}<div id=p{k}><h1>t{k}</h1></div><footer>f</footer></body></html>"

    rows = [(k, f"http://h{k % 3}.example/", page(k, k % 3)) for k in range(24)] + [(99, "http://one.example/", page(99, 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = html_template.parsed_pages(spark, df)
    got = {r.host: (set(r.tags), r.shared) for r in html_template.templates(spark, seen).collect()}
    by_host = defaultdict(list)
    for _, url, html in rows:
        by_host[url.split("/")[2]].append(html_template.parsed(html))
    for host, pages in by_host.items():
        vectors, parents = defaultdict(lambda: [0] * len(pages)), {}
        for k, p in enumerate(pages):
            for path, parent in zip(p.paths[1:], p.parents[1:], strict=True):
                vectors[path][k] += 1
                parents[path] = p.paths[parent]
        support = {path: sum(x > 0 for x in v) for path, v in vectors.items()}
        alive = {path: tuple(v) for path, v in vectors.items() if support[path] >= html_template.TAG_SHARE * len(pages)}
        over = defaultdict(set)
        for path, v in alive.items():
            above = alive.get(parents[path])
            over[v] |= {above} - {v}
        want = {html_template._signed(path) for path, v in alive.items() if len(over[v]) <= 1 and max(v) == 1}
        assert got[host] == (want, len(pages) > 1) and len(want) >= 4


def test_parts_of_a_paragraph_that_are_outside_go_alone():
    page = """<article><p><span class="ad">Ad</span> The article goes on <a class=share href=/s>Share</a>and on.</p>
<p><a class="share">Share</a> text</p><p><span hidden>no</span>yes</p><p>One<span class=ad> ad</span> <b>two</b></p>
<p class=ad>Buy <b>now</b></p><p><i class=ad>Only this</i></p></article>"""
    assert html_template.text_alone(page).split("\n") == ["The article goes on and on.", "text", "yes", "One two"]


def test_template_text_is_deduced_from_the_pages_of_a_host(spark):
    def page(k, extra=""):
        replies = "".join(f"<li><p>reader {k}{i}</p><p>Reply to this</p></li>" for i in range(k % 4 + 1))
        return f"<html><body><div class=x><p>Welcome to the site</p><h1>Title {k}</h1><p>Body {k} words</p>{extra}<p>Same on some</p></div><ol>{replies}</ol><p>Made with care</p></body></html>"

    rows = [(k, "http://one.example/p", page(k)) for k in range(20)]
    rows += [(100 + k, "http://few.example/p", page(k)) for k in range(3)]
    rows += [(200 + k, "http://copies.example/p", page(1)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_template.extracted(spark, df).collect()}
    assert got[1].text.split("\n") == ["Title 1", "Body 1 words", "reader 10", "reader 11"]
    assert "Welcome to the site" in got[100].text and "Made with care" in got[200].text
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_an_article_make_no_template(spark):
    def page(k, mark, *paragraphs):
        inner = "".join(f"<p>{x}</p>" for x in paragraphs)
        return f"<body><div class=top>Welcome to the site</div><div id=post-{mark}>{inner}</div><div class=end>Made with care {k % 1}</div></body>"

    story = [f"Paragraph {i} of one story, told at some length on all copies" for i in range(9)]
    other = [page(k, k, f"Title {k}", f"Body {k} of a text that no other page has") for k in range(20)]
    hosts = {
        "plain": [page(0, 99, *story)] * 15,
        "markup": [page(0, 99, *story).replace("<body", f"<body data-n={k}") for k in range(15)],
        "near": [page(0, 99, *story, f"Seen {k} times") for k in range(15)],
    }
    rows = [(f"http://{h}.example/", x) for h, copies in hosts.items() for x in other + copies]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text.split("\n") for r in html_template.extracted(spark, df).collect()}
    for i, (url, html) in enumerate(rows):
        if "post-99" in html:
            assert got[i][:9] == story and len(got[i]) == 9 + ("near" in url)
        else:
            assert len(got[i]) == 2 and got[i][0].startswith("Title")


def test_pages_of_the_fixture(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = html_template.op10_html_template(spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x)


def test_odd_pages(spark, odd_pages, no_pages):
    rows = html_template.extracted(spark, odd_pages).collect()
    text = {r.page_id: r.text for r in rows}
    assert len(rows) == 9 and text[1] == "same" and text[3] == text[4] == "" and text[6] == "deep\nx"
    assert text[7].count("word é") == 20_000
    assert [r.url for r in rows if r.page_id == 2] == ["http://a.example/y"] * 2 and [text[2]] == ["same"]
    assert {len(r.text) == r.n_chars for r in rows} == {True} and rows[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert html_template.extracted(spark, no_pages).count() == 0


def test_first_pages_of_contents_need_no_shuffle_of_pages(spark):
    # pages numbered over several splits, some with more than one row of bits
    rows = spark.range(0, 70_000, 1, 2).select(
        F.monotonically_increasing_id().alias("page"), F.concat(F.lit("h"), F.col("id") % 3).alias("host"), (F.xxhash64("id") % 20_000).alias("content")
    )
    least = {}
    for r in rows.collect():
        least[r.host, r.content] = min(r.page, least.get((r.host, r.content), r.page))
    first = html_template.first_of(rows, html_template.firsts(rows))
    assert first.columns == ["page", "host", "content"]
    got = [r.page for r in first.collect()]
    assert len(got) > 10_000 and sorted(got) == sorted(least.values())


def test_deduction_reads_no_texts(spark, monkeypatch):
    html = "<html><body><article><p>{}</p></article><div class='menu'><a href='/'>Home</a></div></body></html>"
    pages = spark.createDataFrame([(k, f"http://h/{k}", html.format(f"Text {k % 15}")) for k in range(20)], "page_id long, url string, html string")
    seen = html_template.parsed_pages(spark, pages)
    without = seen.drop("block_texts", "block_tokens")
    got, want = (sorted(map(str, html_template.templates(spark, s).collect())) for s in (without, seen))
    assert got == want and len(got) == 1
    assert html_template.first_of(without, html_template.firsts(seen)).count() == 15
