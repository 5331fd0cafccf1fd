"""Operators 2 and 10."""

import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import main_text, warc_index
from millrace.llm.common import work_path

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/a">One</a></li></ul></nav></header><div id="cookie-notice">We use them</div>
<div class="sidebar"><p>The news of the day and all that is in it for you and for me to see here at last, with more to come.</p></div>
<article><h1>The title</h1><p>First &amp; foremost, the text <b>of</b> the page is <a href="/x">here</a>.&nbsp;Then
more.</p><div class="ad">Buy the thing</div><script>if (a < b) { "</p>" }</script><p>Short.</p><!-- no <p>comment</p> -->
<form><p>Sign up for it</p></form><div class="comments"><p>I liked it, and it was of use to me and to the others who read it.</p></div></article>
<aside>More of the same</aside><footer>&copy; all of us</footer></body></html>"""
TEXT = "The title First & foremost, the text of the page is here. Then more. Short."


def test_an_article_among_boilerplate():
    assert main_text.main_text(PAGE) == TEXT


def test_density_decides_where_structure_does_not():
    prose = "It was the best of the times and it was the worst of the times, and all that we had was in the hands of those who were with us. " * 2
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><h2>On it</h2><p>{prose}</p><p>And so on.</p><p>{prose}</p><div>zzq qqz zqz {'zqx ' * 60}</div></body>"
    assert main_text.main_text(page) == " ".join(f"On it {prose}And so on. {prose}".split())


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<nav>a</nav>", "<p title=\"a>b"])
def test_pages_without_text(page):
    assert main_text.main_text(page) == ""


PROSE = "It was the best of the times and it was the worst of the times, and all that we had was in the hands of those who were with us."
POLISH = "Było to najlepsze ze wszystkich lat, a zarazem najgorsze, gdyż każdy miał przed sobą wszystko i każdy miał przed sobą pustkę."


@pytest.mark.parametrize("page", [
    "<div class='content-sidebar-wrap'><article><p>{}</p></article><div class=sidebar><p>{side}</p></div></div>",
    "<div class='has-sidebar'><article><p>{}</p></article></div>",
    "<article class='post has-comments'><p>{}</p></article><div class=comments><article>{side} {side} {side}</article></div>",
    "<article class='post comments-open'><p>{}</p></article>",
    "<main class='sidebar-left'><p>{}</p></main><div>{side}</div>",
    "<div id=sidebar-layout><div class=nav-wrap><p>{}</p></div></div>",
    "<p>{}</p><div class=comments><p>{side}</p><p>{side}</p></div><div class=cookie-notice>{side} {side}</div>",
    "<article><p>{}</p></article><div class=sidebar><p>{side} {side} {side}</p></div>",
    "<form id=aspnetForm><ul><li><a href=x>News</a></ul><div id=content><p>{}</p></div><input name=q></form>",
    "<form id=aspnetForm><article><p>{}</p></article><div class=sidebar>{side}</div></form>",
    "<article><p>{}</p><form><p>{side}</p></form></article>",
    "<div class=share-price-story><p>{}</p></div><div>Copyright of all of us, with all rights</div>",
    "<article class=legal-analysis><p>{}</p></article>",
    "<div class=hidden-gems><p>{}</p></div>",
])
def test_marks_do_not_hide_the_text(page):
    text = f"{PROSE} {PROSE}"
    assert main_text.main_text("<div><a href=a>Home</a></div>" + page.format(text, side=PROSE.replace("times", "days"))) == text
    assert main_text.main_text(f"<div style='display:none'><article>{text}</article></div>") == ""


def test_prose_of_other_languages():
    nav = "<ul><li><a href=a>Start</a><li><a href=b>Kontakt</a></ul>"
    for text in (POLISH, f"{POLISH} {POLISH}", "今天天气很好，我们一起去公园散步，看见许多人在湖边唱歌跳舞。" * 8):
        assert main_text.main_text(f"<body>{nav}<div><p>{text}</p><p>{text}</p></div>{nav}") == f"{text} {text}"


def test_pages_of_short_paragraphs():
    nav = "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul>"
    for around in ("", nav):
        assert main_text.main_text(f"{around}<p>The first line.</p><p>And the second one.</p><p><a href=x>More of it</a></p>") == "The first line. And the second one."


def test_unclosed_tags_and_references():
    assert main_text.main_text("<article><p>a<b>b<p>c &eacute;&#233;&#xe9; &lt;p&gt;<br>d") == "ab c ééé <p> d"


def test_rows_of_any_kind(spark):
    long = PROSE + " " + "And so it was with all of those who were in it. " * 20_000
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (None, "x", f"<p>{long}</p>")]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text.extract(pages).collect()), key=repr)
    texts = {PAGE: TEXT, None: "", "": "", f"<p>{long}</p>": long.strip()}
    assert got == sorted([(i, u, texts[h], len(texts[h])) for i, u, h in rows], key=repr)
    assert main_text.extract(pages.limit(0)).count() == 0 and main_text.extract(pages).columns == ["page_id", "url", "text", "n_chars"]


def test_all_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def want(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>|<br>", re.sub(r"</?b>", "", inner))]
        return " ".join(b for b in blocks if b)

    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extract(pages).collect()}
    assert got == {r.page_id: (want(r.html), len(want(r.html))) for r in pages.collect()}


PAGES = "page_id bigint, url string, html string, digest string, offset int"
BIG, SMALL = "<p>" + "x" * 1200, "<p>small"


def test_archive_round_trip(spark):
    rows = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, SMALL), (4, "http://c/", SMALL), (5, "u", None), (6, "é", "é" * 500), (7, "é", "é" * 499), (8, "ü", "é" * 500), (None, "n", BIG), (9, "z", "")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_index.archive_round_trip(pages).collect()}
    groups = {}
    for page, _, body in rows:
        groups.setdefault(body or "", []).append(page)
    want = set()
    for page, _, body in rows:
        raw = (body or "").encode()
        owner = max(p for p in groups[body or ""] if p is not None)
        again = len(raw) >= 1000 and page != owner
        want.add((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", owner if again else None))
    assert got == want
    assert warc_index.archive_round_trip(pages.limit(0)).count() == 0


def test_selected_records_come_back_whole(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i} " + "y" * i, "", 0) for i in range(50)], PAGES)
    folder = work_path(spark, "warc")
    index = warc_index.write_archives(pages, folder)
    assert index.count() == 50
    got = warc_index.read_records(index.where("page_id % 7 = 0"), folder, with_payload=True, range_bytes=512, gap=16)
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect()} == {i: f"<p>{i} " + "y" * i for i in range(0, 50, 7)}


def test_many_tasks_read_the_archives(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    folder = work_path(spark, "warc")
    index = warc_index.write_archives(pages, folder)
    records = warc_index.read_records(index, folder, range_bytes=1000)
    assert records.count() == 400 and records.select(F.spark_partition_id()).distinct().count() > 1


def test_ids_of_other_types_and_repeated_rows(spark):
    long = "<p>" + "word after word " * 200_000
    rows = [("a>b\r\nX: y", BIG), ("é:7", BIG), ("é:7", BIG), ("z", SMALL), (None, SMALL), ("l", long), ("l", long)]
    got = warc_index.archive_round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string")).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr)
    owner = {BIG: "é:7", long: "l"}
    assert got == sorted([(i, len(h), "revisit" if owner.get(h, i) != i else "response", o if (o := owner.get(h, i)) != i else None) for i, h in rows], key=repr)


def test_ranges_coalesce_over_small_gaps():
    assert warc_index.coalesce([(30, 5), (0, 10), (12, 8)], gap=2) == [(0, 20, [(0, 10), (12, 8)]), (30, 35, [(30, 5)])]


def test_records_are_standard_members():
    packed, digest = warc_index.page_record("3", "http://x/", b"body", None, "2020-01-01T00:00:00Z")
    fields, http, payload = warc_index.parse_record(packed)
    assert packed[:2] == b"\x1f\x8b" and payload == b"body" and digest == hashlib.sha1(b"body").hexdigest()
    assert fields["warc-type"] == "response" and http.startswith(b"HTTP/1.1 200")


LINES = "It was the best of the times and it was the worst of the times, and all that we had was in the hands of those who were with us. "


@pytest.mark.parametrize("inner,text", [
    (f'<h1><a href="/t">The title of it</a></h1><p>{LINES * 2}</p>', f"The title of it {LINES * 2}"),
    (f"<h1>Title</h1><p>{LINES * 2}</p><ul><li><a href=1>First of the references, by an author</a></li><li><a href=2>Second one</a></li></ul>", f"Title {LINES * 2}First of the references, by an author Second one"),
    (f'<p>{LINES * 2}</p><p>See <a href="/x">{LINES}</a></p>', f"{LINES * 2}See {LINES}"),
    (f'<p><a href="/x">{LINES * 2}</a></p>', LINES * 2),
    (f"<p>{LINES * 2}</p><p>Copyright law protects the authors of all works.</p>", f"{LINES * 2}Copyright law protects the authors of all works."),
    (f"<p>{LINES * 2}</p><p>Copyright 2024 the owners of the page</p><p>&copy; them</p><p>Copyright (c) of us</p>", LINES * 2),
    (f'<div class="notice-of-award"><p>{LINES * 2}</p></div><p>{LINES}</p>', f"{LINES * 2}{LINES}"),
    (f'<p>{LINES * 2}</p><div class="cookie-notice"><p>{LINES * 2}</p></div><div class="notice-bar">{LINES}</div><div class="comments"><p>{LINES * 2}</p></div>', LINES * 2),
])
def test_links_rights_and_names_within_an_article(inner, text):
    assert main_text.main_text(f"<body><nav><a href=/>Home</a></nav><article>{inner}</article><footer>Copyright us</footer></body>") == text.strip()


def test_an_unmarked_notice_beside_the_text():
    notice = "We and our partners use cookies to keep the site running and to show what you like; by going on you accept the use of them, and you can change your mind about it at any time in the settings of this page."
    assert main_text.main_text(f"<body><div>{notice}</div><h2>On it</h2><p>{LINES * 2}</p><p>{LINES * 2}</p></body>") == f"On it {LINES * 2}{LINES * 2}".strip()
    about = "The cookies of the bakery are made of butter and flour, and all that we ate of them was good for us and for those who were with us."
    assert about in main_text.main_text(f"<body><p>{LINES * 2}</p><p>{about}</p><p>{LINES * 2}</p></body>")
