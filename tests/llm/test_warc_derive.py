import base64
import gzip
import hashlib
import zlib
from urllib.parse import urljoin

import llm_cases as cases  # noqa: F401  (the folder's shared path)
from febrile.llm import warc_derive
from febrile.llm.warc_derive import _tag_end as tag_end, as_responses, derive, derive_record, read_page, record_bytes, sha1_label

PAGES = "page_id long, url string, html string, record_id string, kind string"


def fields(record: bytes) -> tuple[dict, bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    named = dict(x.split(": ", 1) for x in lines[1:])
    body = block[:int(named["Content-Length"])]
    assert block == body + b"\r\n\r\n"
    return named, body


def test_text_title_and_links():
    page = ('<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head><body>'
            '<!-- no > comment --><p>One<br>two &lt;3 < 4<p>a<b>b</b> c</p><a href="/x?y=1">X</a> <A HREF=\'#top\'>t</A>'
            '<a title="a > b" href=z.html>Z</a><a href="mailto:a@b">m</a><td>cell</td></body>')
    text, title, links = read_page(page, "http://h.example/d/e")
    assert title == "A & B" and links == ["http://h.example/x?y=1", "http://h.example/d/z.html"]
    assert text == "A & B\nOne\ntwo <3 < 4\nab c\nX tZm\ncell"
    for odd in ("", "<", "a<b", "<a", "<!--", "<script>x", "<p", "a < b > c", "<a href='x", "&#0; &bogus;", "</title>", "<title>"):
        read_page(odd, "")


def test_long_broken_pages_are_linear():
    for t in ("<" * 200_000, "<!--" * 60_000, "<a " * 60_000, "<a href='" * 20_000, "<script>" * 30_000):
        read_page(t, "")


def test_records_are_linked_and_keep_digests(spark):
    rows = [(1, "http://a.example/x", "<p>Hallo <a href='y'>W</a>elt", "q", "r"), (2, None, None, None, None), (3, "http://b.example/", "", None, None),
            (1, "http://a.example/x", "<p>Hallo <a href='y'>W</a>elt", "q", "r")]
    out = derive(as_responses(spark.createDataFrame(rows, PAGES))).collect()
    assert len(out) == 8 and {r["kind"] for r in out} == {"metadata", "conversion"}
    for r in out:
        named, body = fields(bytes(r["record"]))
        assert named["WARC-Type"] == r["kind"] and named["WARC-Refers-To"] == r["refers_to"] and named["WARC-Record-ID"] == r["record_id"]
        assert named["WARC-Block-Digest"] == r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["digest_ok"] and named["WARC-Refers-To-Payload-Digest"] == r["source_digest"] and r["content_length"] == len(body)
    one = {r["kind"]: fields(bytes(r["record"]))[1].decode() for r in out if r["page_id"] == 1}
    assert one["conversion"] == "Hallo Welt" and "outlink: http://a.example/y\r\n" in one["metadata"]
    assert "http-header-content-type: text/html; charset=utf-8\r\n" in one["metadata"]
    assert len({r["record_id"] for r in out if r["page_id"] == 1}) == 2     # repeated rows repeat their records


def test_foreign_records():
    http = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html;\r\n charset=iso-8859-1\r\nX: y\r\n\r\n".encode() + "<p>é".encode("latin-1")
    good = record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Payload-Digest", "sha1:WRONG")], http)
    meta, text = derive_record(good)
    assert fields(text[-1])[1].decode() == "é" and text[6] is False and text[5] == "sha1:WRONG" and text[3] is None
    assert b"http-status: HTTP/1.1 404 Not Found" in meta[-1] and b"charset: iso-8859-1" in meta[-1]
    for bad in (None, b"", b"junk", b"WARC/1.0\r\nX: y", good[:-30], good.replace(b"response", b"request"), good.replace(b"Content-Length", b"Other")):
        assert [r[0] for r in derive_record(bad)] == ["skipped"] and derive_record(bad)[0][10]


def test_empty_and_extra_columns(spark):
    assert derive(as_responses(spark.createDataFrame([], PAGES))).count() == 0
    extra = spark.createDataFrame([(b"x", 5, "old")], "record binary, keep int, reason string")
    r = derive(extra).first()
    assert r["keep"] == 5 and r["kind"] == "skipped" and r["reason"] == "not a WARC record"


def test_every_page_has_both_records(spark):
    from febrile.llm.warc_derive import op7_warc_derive
    out = op7_warc_derive(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()} == {"metadata": n, "conversion": n}
    assert out.filter("not digest_ok or record like '%<script%'").count() == 0


def test_unclosed_and_capital_end_tags():
    assert read_page("<p>before</p><svg width=1><p>after", "")[0] == "before\nafter"
    assert read_page("<p>\u0130</p><script>x</SCRIPT><p>seen</p><STYLE>y</style >more", "")[0] == "\u0130\nseen\nmore"
    assert read_page("a<svg>hidden</SVG>b<svg>open<object>c<script>d", "")[0] == "abopenc"
    assert read_page("<script>a</scripted></script>b", "")[0] == "b"
    for name in ("svg", "object", "math"):
        assert len(read_page(f"<{name}>x" * 30_000, "")[0]) == 30_000


def response(body: bytes, *headers: str, **digests: str) -> bytes:
    http = "".join(f"{h}\r\n" for h in ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *headers)).encode() + b"\r\n" + body
    own = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-IP-Address", "192.0.2.7"), ("WARC-Truncated", "length"),
           ("WARC-Block-Digest", digests.get("block", sha1_label(http)))]
    return record_bytes([*own, ("WARC-Payload-Digest", digests.get("payload"))], http)


def chunked(data: bytes, n: int) -> bytes:
    return b"".join(f"{len(data[k:k + n]):x};q=1\r\n".encode() + data[k:k + n] + b"\r\n" for k in range(0, len(data), n)) + b"0\r\n\r\n"


def test_bodies_are_joined_and_unpacked():
    page = "<p>Grüße</p>".encode() * 50
    want = "\n".join(["Grüße"] * 50)
    for body, headers in ((chunked(page, 7), ["Transfer-Encoding: chunked"]), (gzip.compress(page), ["Content-Encoding: gzip"]),
                          (gzip.compress(page[:60]) + gzip.compress(page[60:]), ["Content-Encoding: x-gzip"]), (zlib.compress(page), ["content-encoding: deflate"]),
                          (chunked(gzip.compress(page), 11), ["Transfer-Encoding: chunked", "Content-Encoding: gzip"])):
        meta, text = derive_record(response(body, *headers, payload=sha1_label(body)))
        assert fields(text[-1])[1].decode() == want and text[6] is True and text[11] is True and text[10] is None, headers
    joined = gzip.compress(page)
    assert derive_record(response(chunked(joined, 9), "Transfer-Encoding: chunked", "Content-Encoding: gzip", payload=sha1_label(joined)))[0][6] is True
    for body, header, why in ((page, "Transfer-Encoding: chunked", "broken chunks"), (joined[:-9], "Content-Encoding: gzip", "content coding gzip not read"),
                              (page, "Content-Encoding: br", "content coding br not read")):
        meta, text = derive_record(response(body, header))
        assert fields(text[-1])[1] == b"" and text[10] == meta[10] == why


def test_source_headers_and_digests_are_kept():
    page = b"<p>x"
    sha256 = "sha256:" + hashlib.sha256(page).hexdigest()
    meta, _ = derive_record(response(page, payload=sha256))
    body = fields(meta[-1])[1].decode()
    assert "source-warc-ip-address: 192.0.2.7\r\n" in body and "source-warc-truncated: length\r\n" in body and f"source-warc-payload-digest: {sha256}\r\n" in body
    assert meta[6] is True and meta[11] is True
    meta, _ = derive_record(response(page, block="sha1:WRONG", payload="crc32:0"))
    assert meta[6] is None and meta[11] is False


def test_charset_far_into_the_page():
    far = b"<html><!--" + b"-" * 5000 + b"--><meta http-equiv=x content='text/html; charset=iso-8859-1'><p>" + "é".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + far
    _, text = derive_record(record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")], http))
    assert fields(text[-1])[1].decode() == "é"


def test_plain_tags_and_rooted_links_cost_little(monkeypatch):
    joins, ends = [], []
    monkeypatch.setattr(warc_derive, "urljoin", lambda *a: joins.append(a) or urljoin(*a))
    monkeypatch.setattr(warc_derive, "_tag_end", lambda page, at: ends.append(at) or tag_end(page, at))
    page = "".join(f"<p class='a > b'><b>w{k}</b><A HREF=\"/é/x-{k}.html\">l</A><BR>" for k in range(50))
    text, _, links = read_page(page, "http://h.example/d/e?q")
    assert text == "\n".join(f"w{k}l" for k in range(50)) and links == [f"http://h.example/é/x-{k}.html" for k in range(50)]
    assert len(joins) == 1 and not ends
    assert read_page("<p title='open>x", "")[0] == "x" and ends


def test_links_join_like_the_library():
    links = ("/", "/x", "/x/", "/x//y", "//o/x", "/./x", "/x/..", "/.x", "/x.y/~z", "/x;p", "/x?q", "/x#f", "/%20", "/a:b", "/é", "/x y", "/a\tb", "x", "?q")
    for base in ("", "http://h/d/e", "http://h", "//h/x", "/p/q", "file:///a/b", "mailto:x@y", "http:/x", "svn+ssh://h/x", "HTTP://u:p@H:1/x;t?q#f"):
        for link in links:
            assert read_page(f'<a href="{link}">', base)[2] == [urljoin(base, link)], (base, link)
    assert read_page("<a href='/x'><a href='/y'>", "http://[bad")[2] == ["/x", "/y"]


def test_blanks_and_lines_of_the_text():
    for gap, want in ((" \t 　", "a b"), (" \n\x1c\n ", "a\nb"), ("\r", "a\nb"), ("<br><BR/> <p>", "a\nb"), ("&#13;&#10;", "a\nb"), ("\x85 ", "a b"), ("​", "a​b")):
        assert read_page(f" \n<title>{gap}a{gap}b{gap}</title>", "")[0].strip("​") == want, gap
    assert read_page("<title> a\r\n\t&nbsp;b </title>", "")[1] == "a b"
