"""Archives and main text of pages."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from apilens.llm import extraction, oracles, warc
from compare import connect, differences

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert not differences(spark, connect(sf), contract.queries()[name], oracles.oracle_sql()[name], sf)


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>same</p>" * 20
    rows = [
        (5, "http://a/\r\nX: é%20", long),
        (3, None, long),
        (3, None, long),
        (9, "http://a", long + " "),
        (1, "http://b", "short"),
        (2, "http://b", "short"),
        (7, "", None),
        (8, None, ""),
        (None, "http://n", long),
        (None, "http://n", "ü" * 60),
        (None, "http://n", "ü" * 60),
        (4, "http://big", "<p>" + "word " * 300_000),
    ]
    return spark.createDataFrame(rows, PAGE).repartition(3).withColumn("digest", F.lit("x"))


def test_archives(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, roll_bytes=1500, pages_per_shard=4)
    got = warc.read_archives(spark, path).collect()
    counts = defaultdict(list)
    for r in got:
        counts[r.page_id].append((r.record_type, r.refers_to, r.payload_bytes))
    same = hashlib.sha256(("<p>same</p>" * 20).encode()).hexdigest()
    assert len(got) == 12
    assert sorted(counts[3], key=str) == [("response", None, 220), ("revisit", 3, 220)]
    assert counts[5] == [("revisit", 3, 220)] and counts[9] == [("response", None, 221)]
    assert counts[1] + counts[2] == [("response", None, 5)] * 2
    assert counts[7] + counts[8] == [("response", None, 0)] * 2
    assert sorted(counts[None], key=str) == [("response", None, 120)] * 2 + [("revisit", 3, 220)]
    assert counts[4] == [("response", None, 1_500_003)]
    assert {r.payload_digest for r in got if r.page_id in (3, 5)} == {same}
    texts = defaultdict(list)
    for r in pages.collect():
        texts[r.page_id].append((r.html or "").encode())
    for r in got:
        if r.record_type == "response":
            assert r.payload in texts[r.page_id]
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert len(manifest) > 2 and sum(r.n_records for r in manifest) == 12
    for r in manifest:
        assert hashlib.sha256((tmp_path / "w" / r.name).read_bytes()).hexdigest() == r.sha256
    assert not list((tmp_path / "w" / "_temporary").glob("*.warc*"))


def test_archives_are_deterministic(spark, pages, tmp_path):
    names = ("a", "b")
    for name, df in zip(names, (pages, pages.repartition(5))):
        warc.write_archives(df, str(tmp_path / name), roll_bytes=1500, pages_per_shard=4)
    one, two = (sorted((r.name, r.sha256) for r in spark.read.parquet(str(tmp_path / n / "manifest")).collect()) for n in names)
    assert one == two


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], PAGE)
    warc.write_archives(empty, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    assert extraction.extract(empty).count() == 0


def test_damage_is_found():
    good = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest())
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))


ARTICLE = "<p>First part, with <b>bold</b> words &amp; marks.</p><p>Second\n  part&#33;</p>"
TEXT = "First part, with bold words & marks. Second part!"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title></head><body></body></html>", ""),
        (f"<body><nav><a href='/'>Home</a></nav><article><h1>Head</h1>{ARTICLE}</article><footer>f</footer></body>", f"Head {TEXT}"),
        (f"<body><header><h1>Site</h1></header><div class='post'>{ARTICLE}</div><aside><p>More, much more.</p></aside></body>", TEXT),
        (f"<main>{ARTICLE}<section id='comments'><p>I like it, really.</p></section></main>", TEXT),
        (f"<div class='cookie-notice'><p>We use cookies, sorry.</p></div>{ARTICLE}", TEXT),
        (f"<article>{ARTICLE}<div class='adBox'>Buy, now.</div><form><p>Your name, please.</p></form></article>", TEXT),
        (f"<article>{ARTICLE}<ul><li><a href='1'>One link</a></li><li><a href='2'>Two links</a></li></ul></article>", TEXT),
        (f"<article><script>var x = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> -->{ARTICLE}", TEXT),
        ("<p>un<b>closed <i>tags<p>and more", "unclosed tags and more"),
        ("a < b <br> c", "a < b c"),
        ("<" * 3000, "<" * 3000),
    ],
)
def test_main_text(page, text):
    assert extraction.main_text(page or "") == text


def test_extract_rows(spark, pages):
    got = extraction.extract(pages).collect()
    assert len(got) == 12
    assert {(r.text, r.n_chars) for r in got if r.page_id in (1, 2)} == {("short", 5)}
    assert {r.n_chars for r in got if r.page_id == 4} == {300_000 * 5 - 1}


LONG = "<p>" + "One long sentence of the article, with marks. " * 40 + "</p>"
PARTS = (
    "<header><h1>Head</h1></header><p>Short one.</p><ul><li>An item of it</li></ul><dl><dt>term</dt><dd>sense</dd></dl>"
    "<table><tr><td>7</td><td>cell</td></tr></table><pre>x = 1</pre>"
)


@pytest.mark.parametrize(
    ("start", "end", "head"),
    [
        ("<article>", "</article>", "Head "),
        ("<main class='has-sidebar'>", "</main>", "Head "),
        ("<body><div class='layout with-sidebar'><div class='post'>", "</div></div></body>", ""),
    ],
)
def test_short_parts_of_the_article_stay(start, end, head):
    body = f"<blockquote>{LONG}</blockquote>{LONG * 3}"
    got = extraction.main_text(f"<div class='sidebar'><p>Aside, not this.</p></div>{start}{PARTS}{body}{end}")
    assert got.startswith(head + "Short one. An item of it term sense 7 cell x = 1 One long")
    assert "Aside" not in got
