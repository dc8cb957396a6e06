import base64
import hashlib
import io
import os
import re
import struct
import zipfile

import numpy as np
import pyarrow.parquet as pq
import pytest

from claimgrid.llm import html_text, warc

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "'x' as refers_to", "'x' as text", "'x' as _page")


ARTICLE = """<!DOCTYPE html><html lang="en"><head><title>Site &amp; title</title><style>p{margin:0}</style><script>var t="</p>";x(0);</script>
</head><body><header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> -->
<div id="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy&nbsp;now</div><main><article><header><h1>Real &lt;title&gt;</h1></header>
<p><b>First  para
graph.<br><p>Second &amp; third.<div class="ad-box"><p>Buy</p></div><p>x<aside>side</aside><form><p>mail</p><input></form>
<ul><li>one<li>two</ul><p style="display: none">hidden</p><section id="comments"><p>great post</p><div><p>me too</div></section>
<p>Last.</p><footer>by me</footer></article></main><div class="sidebar"><p>Other</p></div><footer>&copy; 2020</footer></body></html>"""


def test_article_without_furniture():
    assert html_text.main_text(ARTICLE) == ["Real <title>", "First para graph.", "Second & third.", "x", "one", "two", "Last."]


def test_page_without_a_frame_keeps_the_dense_stretch():
    long = "A sentence of some length stands here. " * 6
    page = (f"<div><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>More</a></div><div><a href=3>More</a></div>"
            f"<div><p>{long}</p><p>short.</p><p>{long}</p></div><div><a href=1>x</a></div><div><a href=1>y</a></div><div><a>z</a></div><div>tail</div>")
    assert html_text.main_text(page) == [long.strip(), "short.", long.strip()]


def test_page_without_a_frame_keeps_what_furniture_and_links_split():
    long = "A sentence of some length stands here. " * 6
    links, advert = "<div><a href=1>x</a> | <a href=2>y</a></div>" * 3, "<div class=ad><p>Buy</p><p>this</p><p>now</p></div>"
    page = f"{links}<p>{long}</p>{advert}<p>caption</p>{links}<h2>Short section</h2>{links}<p>{long}</p>{advert}<p>Close.</p>{links}<p>tail</p>"
    assert html_text.main_text(page) == [long.strip(), "caption", "Short section", long.strip(), "Close."]
    linked = "<p>See <a href=1>a rather long title of some page</a> and <a href=2>one more of them</a></p>"
    got = html_text.main_text(f"{links}{linked}<p>{long}</p><p><a href=3>inside</a></p><p>{long}</p>{linked}{links}")
    see = "See a rather long title of some page and one more of them"
    assert got == [see, long.strip(), "inside", long.strip(), see]


def test_wrappers_are_no_furniture_whatever_their_name():
    body = "<p>One paragraph of the article.</p><p>Another one.</p>"
    want = ["One paragraph of the article.", "Another one."]
    for page in (
        f'<div class="layout with-sidebar"><article>{body}</article></div>',
        f'<div class="page has-sidebar"><div class="content">{body}</div></div>',
        f'<article class="post has-comments">{body}</article>',
        f'<div class="widget"><main>{body}</main></div><div class="sidebar"><article class="teaser"><p>Teaser</p></article></div>',
        f'<form id="aspnet"><div>{body}</div><nav>x</nav></form>',
        f'<article>{body}<div id="comments"><article class="comment-body"><p>{"so true " * 90}</p></article></div></article>',
    ):
        assert html_text.main_text(page) == want, page
    inside = "".join(f'<section id="{i}"><p>{i}</p></section>' for i in ("social-history", "share-price", "related-work", "ad-hoc", "no-comment"))
    assert html_text.main_text(f"<article>{inside}</article>") == ["social-history", "share-price", "related-work", "ad-hoc", "no-comment"]
    for name in ("comments-list", "sidebar", "ad-box", "l-sidebar", "widget__title", "cookie-notice", "related-posts", "newsletter-signup-form"):
        assert html_text.main_text(f'<article>{body}<div class="x {name}"><p>furniture</p></div></article>') == want, name
    assert html_text.main_text(f'<article>{body}<div hidden><p>{"x " * 500}</p></div></article>') == want


def test_stretches_equal_a_plain_version():
    def plain(weights, window):
        out, start = [], None
        blocks = [sum(weights[max(0, k - window + 1) : k + 1]) for k in range(len(weights) + window - 1)]
        for k, b in enumerate([*blocks, 0]):
            if b and start is None:
                start = k
            if not b and start is not None:
                out.append((start, k - window + 1, max(blocks[start:k])))
                start = None
        return out

    rng = np.random.default_rng(3)
    for _ in range(400):
        weights = rng.integers(0, 50, size=rng.integers(1, 30)) * (rng.random(1) < rng.random(1))
        weights = weights * (rng.random(len(weights)) < 0.4)
        for window in (1, 2, 3, 5):
            assert html_text.stretches(weights, window) == plain(weights.tolist(), window)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_frames_and_plain_wrappers_give_the_same_text():
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist():
        renamed = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page or "")
        assert html_text.main_text(renamed) == html_text.main_text(page or "") != []


def test_very_long_pages_and_clashing_names(spark):
    long = "<article>" + "<p>word word</p>" * 60_000 + "<nav>x</nav></article>"
    got = {r.page_id: r for r in html_text.extracted(pages(spark, [(1, "u", long), (2, None, None), (3, "u", "")])).collect()}
    assert got[1].n_chars == 60_000 * 9 + 59_999 * 2 and got[2].text == got[3].text == "" and got[2].url is None
    assert html_text.extracted(pages(spark, [])).count() == 0


def test_broken_and_small_pages():
    assert html_text.main_text("") == [] and html_text.main_text("   ") == []
    assert html_text.main_text("<p>x") == ["x"] and html_text.main_text("a < b &amp c") == ["a < b & c"]
    assert html_text.main_text("<div " * 50) == [] and html_text.main_text("<!-- open") == []
    assert html_text.main_text("<article><p>one<p>two &am") == ["one", "two &am"]
    assert html_text.main_text("<article></article><p>outside</p>") == ["outside"]
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert html_text.main_text(deep) == ["text"]
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000


def test_elements_without_an_end_tag_take_nothing_with_them():
    def article(inner):
        return html_text.main_text(f"<article>{inner}</article><p>outside</p>")

    rest = "<p>Two.</p>"
    for icon in ('<svg class="i"/>', "<math/>", "<svg />", "<object data=x>", "<select name=a>", "<iframe src='x'/>", "<svg><title/></svg>",
                 "<svg><svg><text>a</text></svg>b</svg>", "<svg><title>t</title><text>a</text></svg>", "<object><p>a</p><p>b</p></object>",
                 "<select><option>a<option>b</select>", "<script src=/x/>var t;</script>", "<style>p</style >", "<script>x</script\n>"):
        assert article(f"<p>Icon {icon} and the rest.</p>{rest}") == ["Icon and the rest.", "Two."], icon
    for name in ("select-box", "title-bar", "svg-icon", "object-view", "script-note"):
        assert article(f"<p>A <{name}>x</{name}> b.</p>{rest}") == ["A x b.", "Two."], name
    assert article(f"<svg><path d='1'/><p>One.</p>{rest}<svg><text>a</text></svg><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert html_text.main_text("<article><object><p>One.</p></article><p>x</p></object>") == ["One."]
    assert len(article("<p>word <object> <select></p>" * 20_000)) == 20_000
    assert article(f"<p>One.</p>{rest}<script>never closed <p>code</p>") == ["One.", "Two."]


def test_stretches():
    w = np.array([0, 0, 5, 0, 0, 7, 0, 0, 0, 9, 1])
    assert html_text.stretches(w, 3) == [(2, 6, 7), (9, 11, 10)]
    assert html_text.stretches(np.zeros(4, dtype=int)) == []


def test_extraction_of_a_table(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (None, "u", ""), (1, "u", ARTICLE)]
    got = sorted((str(r.page_id), r.n_chars, len(r.text)) for r in html_text.extracted(pages(spark, rows)).collect())
    n = len("\n\n".join(html_text.main_text(ARTICLE)))
    assert got == [("1", n, n), ("1", n, n), ("2", 0, 0), ("None", 0, 0)]
    assert html_text.extracted(pages(spark, rows).limit(0)).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_records_come_back(spark):
    rows = [(5, "http://a.example/x?q=1", "<p>é</p>"), (3, "http://b.example", "<p>é</p>"), (9, None, None), (8, "u", ""), (2, "u\r\nX: 1", "lone"),
            (7, "u", "x" * 300_000), (6, "u", "x" * 300_000), (None, "u", "lone"), (None, "u", "none")]
    got = {(r.page_id, r.payload_digest): (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect()}
    assert got == {
        (5, digest("<p>é</p>")): (9, "revisit", 3), (3, digest("<p>é</p>")): (9, "response", None),
        (9, digest("")): (0, "revisit", 8), (8, digest("")): (0, "response", None), (2, digest("lone")): (4, "response", None),
        (7, digest("x" * 300_000)): (300_000, "revisit", 6), (6, digest("x" * 300_000)): (300_000, "response", None),
        (None, digest("lone")): (4, "revisit", 2), (None, digest("none")): (4, "response", None),
    }
    small = warc.round_trip(pages(spark, rows), min_bytes=10).collect()
    assert sorted(r.record_type for r in small).count("revisit") == 1
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_archives_roll_and_give_single_records(tmp_path):
    packer = warc.Packer(str(tmp_path), 0, 2000)
    texts = [hashlib.sha256(str(k).encode()).hexdigest() * 8 for k in range(30)]
    for k, t in enumerate(texts):
        packer.add(k, f"http://x.example/{k}", t.encode(), digest(t), None, False)
    packer.close()
    assert len(packer.made) > 3 and sum(n for _, n in packer.made) == 30
    seen = []
    for uri, n in packer.made:
        archive = warc.Archive(uri)
        entries = archive.index()
        assert len(entries) == n
        seen += [r.payload.decode() for r in archive.records(entries, most=700)]
        (one,) = archive.records(entries[-1:])
        assert one.headers["warc-target-uri"] == entries[-1]["url"]
        assert zipfile.ZipFile(uri).read(warc.DATA) == archive.read(warc.DATA)
    assert seen == texts


def test_zip64_fields_and_comments(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("m"), "w", force_zip64=True) as member:
            member.write(b"payload")
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    assert warc.Archive(str(path)).read("m", 3, 2) == b"lo"

    # The same archive with every size and offset moved to ZIP64 records.
    name, data = b"m", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), 1, 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, 1, len(extra), 0, 0, 0, 0, 2**32 - 1)
    body = local + data
    directory = entry + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(directory), len(body))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(directory), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    path.write_bytes(body + directory + end64 + locator + end)
    archive = warc.Archive(str(path))
    assert archive.members["m"]["size"] == 7 and archive.read("m") == b"payload"
    with pytest.raises(ValueError):
        archive.read("m", 5, 5)

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"payload" * 50)
    path.write_bytes(buffer.getvalue())
    with pytest.raises(ValueError, match="not stored"):
        warc.Archive(str(path)).read("m")
    path.write_bytes(b"not a zip")
    with pytest.raises(ValueError):
        warc.Archive(str(path))
