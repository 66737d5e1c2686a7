"""Main text of pages, and WARC archives."""

import base64
import gzip
import html as html_library
import hashlib
import re
import time

import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import html_text, warc
from tallyspark.llm.entries import REGISTRY, table

LONG = "This sentence, long enough, belongs to the article; it has marks, and words. "


def page(body):
    return f"<html><head><title>T, t.</title></head><body>{body}</body></html>"


CASES = [
    (None, ""), ("", ""), ("<", "<"), ("plain  words\n here", "plain words here"),
    (page(""), ""), (page("<nav><a href=x>one</a></nav><footer>end.</footer>"), ""),
    (page(f"<nav><ul><li><a>x</a></ul></nav><article><h1>Head</h1><p>{LONG}<p>{LONG}</article><footer>(c) me.</footer>"),
     f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    (page(f"<div class='ad-box'>{LONG}</div><div id=content><h1>A &amp; B</h1><p>x&nbsp;<b>y</b> &lt;z&gt; {LONG}</p></div>"),
     f"A & B\n\nx y <z> {LONG.strip()}"),
    (page(f"<header>Site, name.</header><main><p>{LONG}</p><aside>{LONG}</aside><p>short</p></main>"
          f"<section class=comments><p>{LONG}</p></section>"), f"{LONG.strip()}\n\nshort"),
    (page(f"<div class='page with-sidebar'><div class=sidebar>{LONG}</div><article><h1>t</h1><p>{LONG}</p></article></div>"),
     f"t\n\n{LONG.strip()}"),
    (page(f"<form><p>{LONG}</p></form><article><p>{LONG}<script>var a = '<p>no</p>';</script></p><!-- <p>no</p> --></article>"),
     LONG.strip()),
    (page(f"<div class=cookie-notice><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div><div><a>{LONG}</a></div>"),
     f"{LONG.strip()}\n\n{LONG.strip()}"),
    (page(f"<div class='post overflow-hidden'><h1>t</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>"
          f"<div id=readerComments><p>{LONG}</p></div>"), f"t\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    (page(f"<div class=logo><h1>Site</h1></div><div><p>{LONG}</p><p>{LONG}</p></div><div hidden><p>{LONG}</p></div>"),
     f"{LONG.strip()}\n\n{LONG.strip()}"),
    (page(f"<main><h1>t</h1><div class=adsbygoogle><p>{LONG}</p></div><article><p>{LONG}</p></article></main>"),
     f"t\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}<p>cut &am", f"{LONG.strip()}\n\ncut &am"),
    (f"<article><p>{LONG}</p><p>cut <a hre", f"{LONG.strip()}\n\ncut"),
    (f"<article><p>{LONG}</p><div style='display:none'>{LONG}</div></article>", LONG.strip()),
]


@pytest.mark.parametrize("html, text", CASES)
def test_pages(html, text):
    assert html_text.main_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/\"'=! -apdivscriptnav&;", max_size=200))
def test_any_text_has_a_result(html):
    assert isinstance(html_text.main_text(html), str)


@pytest.mark.parametrize("piece", [
    "<p", "<p a='", "<!-- ", "<script>", "<a href=\"", "</", "<div><p>x ", "&amp;<b>", "<div>word, ", "<ul><li>x", "</x>",
    "<div><h1>x</h1>", "<article>word, ", "<div class=menu>word, ", "<article><div class=share>x ", "<main><form>x, ",
    "<td><li>x", "<div></b></x>"])
def test_long_and_unclosed_markup_takes_linear_time(piece):
    def seconds(n):
        best = 9e9
        for _ in range(2):
            started = time.perf_counter()
            html_text.main_text(piece * n)
            best = min(best, time.perf_counter() - started)
        return best

    html_text.main_text(piece * 100)
    assert seconds(16_000) < 6 * seconds(4_000) + 0.1


def test_extract_keeps_columns_and_empty_tables(spark):
    rows = [(1, "u", f"<article><p>{LONG}é</p></article>", "old", 3), (None, None, None, "old", 3), (2, "u", "", "old", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, len(LONG) + 1), (2, 0)]
    assert html_text.extract(frame.limit(0)).count() == 0


def blocks_of_article(page):
    """The contract by hand for the provided pages: their article holds headings and paragraphs, some not closed, with
    inline tags, breaks and character references."""
    inside = page[page.index("<article>") + 9:].partition("</article>")[0]
    blocks = []
    for piece in re.split(r"</?(?:h1|h2|h3|p|div|ul|ol|li|blockquote|pre|section|figure|table|tr|td)\b[^>]*>", inside):
        piece = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", piece, flags=re.S)
        text = " ".join(html_library.unescape(re.sub(r"</?[a-z][^>]*>", "", re.sub(r"<br\s*/?>", " ", piece))).split())
        if text:
            blocks.append(text)
    return "\n\n".join(blocks)


def test_page_query_equals_the_contract_by_hand(spark, sf_dir):
    want = {r.page_id: blocks_of_article(r.html) for r in table(spark, sf_dir, "pages").collect()}
    rows = REGISTRY["op3_main_text"](spark, sf_dir).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(want[r.page_id]) for r in rows)
    assert sum("\n\n" in t for t in want.values()) > len(want) / 2


def without_names(page):
    """The page without article, main or any telling element, class or id."""
    page = re.sub(r"<(/?)(?:article|main|nav|footer|aside|header|section|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|\S+?(?=[\s>]))", "", page)


def test_ratios_decide_and_names_do_not(monkeypatch):
    """Without telling names the ratios still find the article; without ratios nothing does; word lists add little."""
    pages = [r["html"] for r in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["html"]).to_pylist()]
    want = [blocks_of_article(p) for p in pages]
    renamed = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    nameless = [without_names(p) for p in pages]

    def changed(some):
        return sum(html_text.main_text(p) != w for p, w in zip(some, want))

    assert changed(pages) == changed(renamed) == 0
    assert changed(nameless) <= 0.1 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "BESIDE", frozenset())
        m.setattr(html_text, "BESIDE_WORDS", frozenset())
        m.setattr(html_text, "BESIDE_STEMS", re.compile("(?!)"))
        assert changed(renamed) <= 0.1 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
        assert changed(nameless) >= 0.9 * len(pages)


LINKS = "<ul>" + "<li><a href=x>Some other page</a>" * 8 + "</ul>"


@pytest.mark.parametrize("html, text", [
    (page(f"<div class=c1>{LINKS}</div><div class=c2><p>{LONG}</p><p>{LONG}</p></div><div class=c5><p>Copyright 2026 by us</p></div>"),
     f"{LONG.strip()}\n\n{LONG.strip()}"),
    (page(f"<div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><div><h3>You may also like</h3>{LINKS}</div></div>"),
     f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    (page(f"<div><h1>Head</h1><p>{LONG}</p><h2>Part</h2><p>Short.</p><ul><li>one<li>two</ul><p>{LONG}</p></div><div>2026</div>"),
     f"Head\n\n{LONG.strip()}\n\nPart\n\nShort.\n\none\n\ntwo\n\n{LONG.strip()}"),
    (page(f"<table><tr><td>{LINKS}<td><p>{LONG}<p>{LONG}<p>End.</table>"),
     f"{LONG.strip()}\n\n{LONG.strip()}\n\nEnd."),
])
def test_ratios_leave_out_menus_and_ends_without_names(html, text):
    assert html_text.main_text(html) == text


# --- WARC ----------------------------------------------------------------------------

TRICKY = ["", "x", "\r\n", "\r\n\r\n", "a\r\n\r\nb", "a\r\n", "\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc",
          "é" * 1000, "\n\n\r\r\n\r\n\r", "HTTP/1.1 200 OK\r\n\r\nx", "long " * 60_000]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="\r\nab", max_size=12), max_size=6), st.integers(1, 7))
def test_cutter_takes_pieces_of_any_size(payloads, size):
    stream = b"".join(
        b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p.encode()) for p in payloads)
    cutter, found = warc.RecordCutter(), []
    for at in range(0, len(stream), size):
        found += [block.decode() for _, block in cutter.feed(stream[at:at + size])]
    assert found == payloads


def sha1_base32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    first = {}
    for i, _, html in rows:
        first[html or ""] = max(first.get(html or "", i), i)
    return sorted(
        (i, len((h or "").encode()), sha1_base32(h), "response" if first[h or ""] == i else "revisit",
         None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)


def test_archives_give_back_every_payload(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}\r\nX: y" if i % 2 else None, t) for i, t in enumerate(TRICKY + [None, "x", "x"])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int")
    path = str(tmp_path / "archive")
    warc.write_captures(frame.repartition(2), path)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to_page_id) for r in captures)
    assert got == brute(rows)
    payloads = {r.page_id: bytes(r.payload).decode() for r in captures if r.type == "response"}
    assert all(payloads[i] == (h or "") for i, _, h in rows if i in payloads)
    assert all(len(r.requests) == len(r.metadata) == 1 for r in captures)
    files = [f for f in (tmp_path / "archive").iterdir() if f.suffix == ".gz"]
    assert files and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: request") for f in files)


def test_null_ids_repeated_pages_and_no_pages(spark, tmp_path):
    schema = "page_id long, url string, html string"
    frame = spark.createDataFrame([(None, "u", "p"), (4, "u", "p"), (4, "u", "p"), (None, "u", "q")], schema)
    warc.write_captures(frame, str(tmp_path / "a"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert sorted((r.page_id or 0, r.type, r.refers_to_page_id or 0) for r in captures) == [
        (0, "response", 0), (0, "revisit", 4), (4, "response", 0), (4, "revisit", 4)]
    warc.write_captures(frame.limit(0), str(tmp_path / "b"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "b"))).count() == 0


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"no archive\r\n\r\n"))
    with pytest.raises(Exception, match="not a WARC record"):
        warc.read_records(spark, str(tmp_path / "x.gz")).count()


def test_equal_rows_all_come_back(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(7, "u", "same")] * 5 + [(7, None, "same"), (3, "u", "same"), (None, None, None), (None, None, None), (8, "u", None)]
    path = str(tmp_path / "a")
    warc.write_captures(spark.createDataFrame(rows, schema), path)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert sorted((r.page_id or 0, r.type, r.refers_to_page_id or 0) for r in captures) == [
        (0, "revisit", 8), (0, "revisit", 8), (3, "revisit", 7)] + [
        (7, "response", 0)] + [(7, "revisit", 7)] * 5 + [(8, "response", 0)]
    assert len({r.record_id for r in captures}) == len(rows) and all(len(r.requests) == 1 for r in captures)


def archive(*records):
    """Bytes of an archive of (header lines, block)."""
    return b"".join(
        b"WARC/1.1\r\n" + "".join(f"{line}\r\n" for line in lines).encode()
        + b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block) for lines, block in records)


def test_repeated_fields_and_records_are_all_kept(spark, tmp_path):
    """Two requests and two metadata records of a capture, one named by the response, and one that is of two captures."""
    data = archive(
        (["WARC-Type: response", "WARC-Record-ID: <a>", "WARC-Concurrent-To: <r2>", "WARC-Concurrent-To: <none>"],
         b"HTTP/1.1 200 OK\r\nSet-Cookie: x=1\r\nSet-Cookie: y=2\r\n\r\nbody"),
        (["WARC-Type: response", "WARC-Record-ID: <b>"], b"HTTP/1.1 200 OK\r\n\r\nother"),
        (["WARC-Type: request", "WARC-Record-ID: <r1>", "WARC-Concurrent-To: <a>"], b"GET / HTTP/1.1\r\n\r\n"),
        (["WARC-Type: request", "WARC-Record-ID: <r2>"], b"GET / HTTP/1.1\r\n\r\n"),
        (["WARC-Type: metadata", "WARC-Record-ID: <m1>", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"],
         b"via: here\r\nvia: there\r\n"),
        (["WARC-Type: metadata", "WARC-Record-ID: <m2>", "WARC-Concurrent-To: <a>"], b"page-id: 5\r\n"))
    (tmp_path / "x.gz").write_bytes(gzip.compress(data))
    rows = {r.record_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "x.gz"))).collect()}
    assert [x.record_id for x in rows["<a>"].requests] == ["<r1>", "<r2>"]
    assert [x.record_id for x in rows["<a>"].metadata] == ["<m1>", "<m2>"] and rows["<a>"].page_id == 5
    assert [(f.name, f.value) for f in rows["<a>"].metadata[0].fields] == [("via", "here"), ("via", "there")]
    assert rows["<b>"].requests == [] and [x.record_id for x in rows["<b>"].metadata] == ["<m1>"]
    response, = warc.read_records(spark, str(tmp_path / "x.gz")).filter("record_id = '<a>'").collect()
    assert [(f.name, f.value) for f in response.fields] == [("set-cookie", "x=1"), ("set-cookie", "y=2")]
    assert response.concurrent_to == ["<r2>", "<none>"]


@pytest.mark.parametrize("lost", [1, 2, 3, 4, 5, 9, 40])
def test_cut_off_archives_are_refused(spark, tmp_path, lost):
    data = archive((["WARC-Type: response", "WARC-Record-ID: <a>"], b"HTTP/1.1 200 OK\r\n\r\nbody of some bytes"),
                   (["WARC-Type: response", "WARC-Record-ID: <b>"], b"HTTP/1.1 200 OK\r\n\r\nother"))
    # The empty line after the last record may be missing, nothing before it.
    (tmp_path / "x.gz").write_bytes(gzip.compress(data[:-4 - lost]))
    with pytest.raises(Exception, match="x.gz ends within a record|not a WARC record"):
        warc.read_records(spark, str(tmp_path / "x.gz")).count()


def test_warc_query(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, sf_dir, "pages").collect()]
    assert sorted(tuple(r) for r in REGISTRY["op6_warc"](spark, sf_dir).collect()) == brute(rows)


# --- whole articles --------------------------------------------------------------------

P = LONG.strip()


@pytest.mark.parametrize("html, text", [
    (f"<html><head><title>x</title><body><article><p>{LONG}</article>", P),
    (f"<html><head><title>x</title><article><p>{LONG}</p></article>", P),
    (f"<html><head><meta charset=utf-8><title>x</title>{LONG}<p>{LONG}", f"{P}\n\n{P}"),
    (page(f"<form id=aspnetForm><nav>a</nav><article><p>{LONG}</p></article></form>"), P),
    (page(f"<form><div><h1>t</h1><p>{LONG}</p></div></form>"), f"t\n\n{P}"),
    (page(f"<form><main><p>{LONG}</p><form><p>{LONG}</p></form></main></form>"), P),
    (page(f"<article><p>{LONG}</p><svg class='a>b' viewBox=\"0 0\"/><p>{LONG}</p><IFRAME src=a /><p>{LONG}</p></article>"),
     f"{P}\n\n{P}\n\n{P}"),
    (page(f"<article><p>{LONG}</p><svg><path d='m'/><text>no</text></svg><p>{LONG}</p></article>"), f"{P}\n\n{P}"),
])
def test_open_heads_forms_around_pages_and_empty_elements(html, text):
    assert html_text.main_text(html) == text


SHARE = "<div class=share><a href=x>Tweet this</a> <a href=y>Mail it</a></div>"


@pytest.mark.parametrize("html, text", [
    (page(f"<article><h2 id=how-to-search>How</h2><p>{LONG}</p><p class=notice>Short.</p>{SHARE}</article>"),
     f"How\n\n{P}\n\nShort."),
    (page(f"<article><p>{LONG}</p><section id=related-work><h2>Related work</h2><p>{LONG}</p></section>"
          f"<section id='discussion'><h2>Discussion</h2><p>Short.</p></section></article>"),
     f"{P}\n\nRelated work\n\n{P}\n\nDiscussion\n\nShort."),
    (page(f"<main><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section>{SHARE}</main>"),
     f"{P}\n\nDiscussion\n\n{P}"),
    (page(f"<article class='post comments-open'><p>{LONG}</p><p>{LONG}</p></article>"), f"{P}\n\n{P}"),
    (page(f"<main><article class=category-search><p>{LONG}</p></article></main>"), P),
    (page(f"<article class='post comments-open'><p>{LONG}</p><p>{LONG}</p></article>"
          f"<div id=comments><article class=comment><p>{LONG}</p></article></div>"), f"{P}\n\n{P}"),
    (page(f"<article><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article>"), P),
    (page(f"<article><p>{LONG}</p><div class=related><ul><li><a href=x>{LONG}</a></ul></div><div class=ad>Buy.</div></article>"), P),
    (page(f"<div class='page search'><p>{LONG}</p><p>{LONG}</p></div><div class=menu>a</div>"), f"{P}\n\n{P}"),
    (page(f"<div id=content><h2 id=related>R</h2><p id=comment-1>{LONG}</p><p>{LONG}</p></div>"), f"R\n\n{P}\n\n{P}"),
])
def test_names_within_the_article_leave_no_text_out(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (page(f"<article><p>{LONG}</p><p>See <a href=x>R&amp;D &mdash; Q&amp;A</a>.</p></article>"), f"{P}\n\nSee R&D — Q&A."),
    (page(f"<article><p>{LONG}</p><p>At <a href=x>\n              the\n              end\n          </a></p></article>"),
     f"{P}\n\nAt the end"),
    (page(f"<article><h2><a href=x>Title</a></h2><p>{LONG}</p><ul><li><a href=y>A source</a></ul></article>"),
     f"Title\n\n{P}\n\nA source"),
    (page(f"<article><p><a name=top>{LONG}<p><a id=b>{LONG}</article>"), f"{P}\n\n{P}"),
    (page(f"<div><p><a name=top>{LONG}</p><p>{LONG}</p></div><ul><li><a class=x href=y>{LONG}</a></ul>"), f"{P}\n\n{P}"),
])
def test_linked_blocks_of_the_article_stay(html, text):
    assert html_text.main_text(html) == text


def test_links_count_decoded_characters():
    blocks = html_text.blocks_of("<p>a <a href=x>b&amp;\n  c</a> <a name=y>d</a><a href='z'>e</a></p>")
    assert [(b.text, b.linked) for b in blocks] == [("a b& c de", 5)]


@pytest.mark.parametrize("html, text", [
    (page(f"<div id=content><section>{LONG * 20}</section><section>{LONG}</section></div>"), f"{(LONG * 20).strip()}\n\n{P}"),
    (page(f"<div><div><p>{LONG * 20}</p></div><h2>Two</h2><div><p>{LONG}</p></div></div>"),
     f"{(LONG * 20).strip()}\n\nTwo\n\n{P}"),
    (page(f"<article><p>{LONG * 12}</p></article><article><p>{LONG}</p></article>"), f"{(LONG * 12).strip()}\n\n{P}"),
    (page(f"<article><p>{LONG}</p></article><div class=menu>a</div><p>b</p><article><h2>Two</h2><p>{LONG}</p></article>"),
     f"{P}\n\nTwo\n\n{P}"),
    (page(f"<main><p>{LONG}</p></main><div><ul><li><a href=x>{LONG}</a></ul></div>"), P),
    (page(f"<article><p>{LONG}</p><p>{LONG}</p></article><div class=related-posts><article><p>{LONG}</p></article></div>"),
     f"{P}\n\n{P}"),
    (page(f"<form><article><p>{LONG}</p></article></form><form><article><p>{LONG * 9}</p></article></form>"),
     f"{P}\n\n{(LONG * 9).strip()}"),
])
def test_all_parts_of_an_article_stay(html, text):
    assert html_text.main_text(html) == text
