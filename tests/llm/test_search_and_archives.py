"""Top-k search, WARC archives and text extraction."""

import gzip
import random
import tempfile
import time

import pytest

from spendloom.llm import checks, extraction, registry, topk, warc

VECTORS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"


def compare(df, sql, **tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    assert rows == sorted(map(repr, cursor.fetchall()))


def test_top_k_equals_sql_with_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(300)]
    rows += [(i, [0.5] * 8, 0) for i in range(300, 420)]  # one vector over and over
    rows += [(500, None, 0), (550, [], 0), (600, [float("nan")] * 8, 0), (650, [None] * 8, 0), (700, [float("inf")] * 8, 0), (750, [0.1] * 3, 0), (None, [0.5] * 8, 0)]
    rows += [(50, [0.25] * 8, 1), (7, [0.5] * 8, 1), rows[100], rows[100], rows[22], rows[22]]  # an id with two vectors, and rows again
    vectors = spark.createDataFrame(rows, VECTORS)
    found = topk.search(vectors)
    compare(found, checks.top_k_sql("vectors"), vectors=vectors)
    assert found.filter("query_id = 100").count() == 5 and found.filter("query_id = 50").count() == 10
    odd = vectors.selectExpr("*", "'x' AS id", "1 AS key", "2 AS block", "3 AS low")
    assert sorted(map(tuple, topk.search(odd).collect())) == sorted(map(tuple, found.collect()))


def test_top_k_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = random.Random(6)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(201)], VECTORS)
    compare(topk.search(vectors), checks.top_k_sql("vectors"), vectors=vectors)


def test_top_k_of_few(spark):
    vectors = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [2.0], 0)], VECTORS)
    assert [tuple(r) for r in topk.search(vectors).orderBy("rank").collect()] == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert topk.search(spark.createDataFrame([], VECTORS)).count() == 0


ODD_PAGES = [
    (1, "http://a/x y\r\nz", "<p>same\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>same\r\n\r\nWARC/1.1\r\n</p>"), (3, "http://b", None), (4, "", ""),
    (5, "http://c", "é " * 1000), (9, "http://d", "x" * 500_000), (8, "http://d", "<p>same\r\n\r\nWARC/1.1\r\n</p>"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(ODD_PAGES, PAGES)
    folder = tempfile.mkdtemp() + "/warc"
    compare(warc.round_trip(pages, folder), checks.warc_sql("pages"), pages=pages)


def test_archives_are_warc_files_with_all_payloads(spark, tmp_path):
    pages = spark.createDataFrame(ODD_PAGES, PAGES)
    folder = str(tmp_path / "warc")
    warc.write(pages, folder)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "warc").glob("*.gz")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    got = warc.assemble(warc.records(spark, folder, with_payload=True)).collect()
    assert len(got) == len(ODD_PAGES)
    html = {i: (h or "").encode() for i, _, h in ODD_PAGES}
    for r in got:
        page = int(r["metadata"]["fields"]["page-id"])
        assert r["request"]["warc_type"] == "request" and r["request"]["record_id"] == r["response"]["concurrent_to"]
        if r["response"]["warc_type"] == "response":
            assert bytes(r["response"]["payload"]) == html[page]
        else:
            heads = [x for x in got if x["response"]["record_id"] == r["response"]["refers_to"]]
            assert [bytes(x["response"]["payload"]) for x in heads] == [html[page]]


def test_archives_of_odd_rows(spark):
    """Repeated rows are captures of their own; a null id is smaller than all others."""
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "v", "x"), (None, None, None)], PAGES)
    rows = warc.round_trip(pages, tempfile.mkdtemp() + "/warc").collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in rows)
    assert got == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]
    small = warc.round_trip(pages, tempfile.mkdtemp() + "/warc", smallest=2).collect()
    assert {r["record_type"] for r in small} == {"response"}
    empty = spark.createDataFrame([], PAGES)
    assert warc.round_trip(empty, tempfile.mkdtemp() + "/warc").count() == 0


def test_foreign_archives_are_read():
    """Several gzip members, records without partners, bare line feeds between records."""
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab"
    rows = list(warc.parse(gzip.compress(record + b"\r\n\r\n") + gzip.compress(b"\r\n" + record)))
    assert [(r[0], r[1], r[6], r[8]) for r in rows] == [("<urn:x>", "response", 2, b"ab")] * 2
    assert list(warc.parse(b"")) == []


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><div class="ad">Buy this. Now.</div>
<article><h1>A &amp; B</h1><p><b>Bold<br>start <p>Second&nbsp;<a href=x>link</a>\n text.<!-- no --><script>var t="</p>";</script>
<aside>Side</aside><ul><li>One<li>Two</ul><div class="comments"><p>A reader wrote.</p></div></article><form>Name <input></form><footer>&copy; End</footer>"""


def test_article_is_taken_whole():
    assert extraction.main_text(PAGE) == "A & B\n\nBold start\n\nSecond link text.\n\nOne\n\nTwo"


def test_without_article_long_running_text_wins():
    page = """<div id=top><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id=c><p>A long sentence, with a comma, and a stop.
    And more.</p><p>Another long sentence, with commas, in the same place.</p></div><div><span>Tags</span></div><div class="cookie-notice">We use cookies, as you know, for this.</div>"""
    assert extraction.main_text(page).split("\n\n") == ["A long sentence, with a comma, and a stop. And more.", "Another long sentence, with commas, in the same place."]


BODY = [f"Paragraph {k} of the story has a comma, a verb and an end, and it runs on for a while." for k in range(6)]


@pytest.mark.parametrize("teaser", ["<article><p>Read this teaser.</p></article>", "<main>Short.</main>", "<div id=main><p>Short.</p></div>"])
def test_body_beside_a_teaser_is_kept(teaser):
    page = f"<body>{teaser}<div class=story>{''.join(f'<p>{b}</p>' for b in BODY)}</div><div><a href=1>One</a> <a href=2>Two</a></div>"
    assert [b for b in BODY if b not in extraction.main_text(page).split("\n\n")] == []
    assert "One" not in extraction.main_text(page)


def test_link_lists_in_an_article_are_judged():
    links = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(8))
    page = f"<article><h1><a href=/self>The headline</a></h1>{''.join(f'<p>{b}</p>' for b in BODY)}<ul class=tags>{links}</ul><ol><li>Point</ol></article><div>By the staff</div>"
    assert extraction.main_text(page).split("\n\n") == ["The headline", *BODY, "Point"]


STORY = f"<p>{BODY[0]}</p><p>{BODY[1]}</p>"


@pytest.mark.parametrize(("page", "text"), [
    (f'<div class="layout has-sidebar"><article>{STORY}</article></div>', BODY[:2]), (f'<div class="no-sidebar">{STORY}</div>', BODY[:2]),
    (f'<div class="sidebar"><main>{STORY}</main></div>', BODY[:2]), (f'<div class="comments"><article>{STORY}</article></div>', []), (f'<div hidden><article>{STORY}</article></div>', []),
    (f'<article><div class="entry-header"><h1>Title</h1></div>{STORY}</article>', ["Title", *BODY[:2]]), (f'<article aria-hidden="false" title="Hidden gems">{STORY}</article>', BODY[:2]),
    (f'<article>{STORY}<div aria-hidden="true">{STORY}</div></article>', BODY[:2]), (f'<article><p><a class="share" href=x>Share</a>{BODY[0]}<span hidden>no</span></p></article>', BODY[:1]),
    (f'<article>{STORY}</article><div class="site-footer">{STORY}</div><div class="ad ad-1">{STORY}</div><div id="comments">{STORY}</div><div class="promotion_box">{STORY}</div>', BODY[:2]),
])
def test_names_mark_as_a_whole(page, text):
    assert extraction.main_text(page) == "\n\n".join(text)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>open <b>bold", "open bold"), ("a < b and c", "a < b and c"), ("<p>x</p><!-- never closed <p>y</p>", "x"),
    ("</p></div>stray", "stray"), ("<script>alone()", ""), ("<article><p title=\"it's\">t</article>", "t"), ("<article></article>", ""),
])
def test_broken_pages(page, text):
    assert extraction.main_text(page) == text


def test_extraction_of_given_pages(spark):
    """Brute force for the given pages: everything between the article tags, cut at block tags."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in registry.op8_extract_html(spark, "/root/testdata/sf0.01").collect():
        article = re.search("<article>(.*)</article>", sources[r["page_id"]], re.S)[1]
        parts = re.split("</?p>|</?h1>", article.replace("<br>", " "))
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", p))).strip() for p in parts]
        assert r["text"] == "\n\n".join(p for p in plain if p)
        assert r["n_chars"] == len(r["text"])


def test_extraction_of_odd_rows(spark):
    rows = extraction.extract(spark.createDataFrame([(None, None, None), (1, "u", PAGE), (1, "u", PAGE)], PAGES)).collect()
    assert sorted(r["n_chars"] for r in rows)[0] == 0 and len(rows) == 3
    assert extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(("page", "length"), [
    ("<a " * 333_000, 998_999),
    ("<div>" * 50_000 + "deep text, yes.", 15),
    ("".join(f"<div class=c{i}>" for i in range(50_000)) + "deep text, yes.", 15),
    ("<p>text</p>" + '<a "' * 200_000, 6 + 799_999 - 1),
    ("x<!--" * 200_000, 1),
])
def test_long_broken_pages_take_no_longer_than_their_length(page, length):
    began = time.perf_counter()
    found = extraction.main_text(page)
    assert time.perf_counter() - began < 10
    assert abs(len(found) - length) <= 10
