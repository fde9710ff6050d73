"""WARC derivative builder: responses into linked metadata and plain-text conversion records.

A response record (bytes of WARC/1.0 or 1.1) is parsed into its WARC headers, its
HTTP headers and its payload.  Two records come out of each: a ``metadata``
record (application/warc-fields: all WARC headers of the source, status, HTTP headers, charset, title, outlinks)
and a ``conversion`` record (text/plain).  Both name the response in
WARC-Refers-To and carry its target, date and payload digest; the two ids follow
from the response's id alone, so a task that runs again writes the same records.

Chunked bodies are joined and gzip or deflate bodies unpacked before they are read.

Defined results: null or unreadable bytes, and records of other types, give one
row of kind ``skipped`` with the reason and no record; an empty payload gives an
empty conversion; a missing or wrong source digest is kept as found and reported in
``digest_ok`` and ``block_ok`` (null: none given, or by an unknown function); a body
that cannot be joined or unpacked keeps its records, with an empty conversion and the cause in ``reason``; a
hidden element without an end hides nothing, but for script and style, which run to the end of the page;
pages of any length are read whole, in one pass; of several charsets the header's, then the first named counts; repeated rows give repeated records; an empty
table gives an empty table; other columns pass through and an input column with
the name of a result column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from febrile.llm.common import read_table

CRLF = b"\r\n"
#: Elements whose content is not text, and elements that end a line.
HIDDEN = ("script", "style", "template", "noscript", "svg", "math", "iframe", "object")
BREAKING = frozenset(
    "address article aside blockquote br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Tags without attributes that neither hide, link nor name the page -> what they leave in the text.
PLAIN = {f"{sign}{spelled}": "\n" if name in BREAKING else "" for name in (BREAKING - {"title"}) | frozenset(
    "a abbr b body center cite code del em font head html i ins kbd mark q s samp small span strong sub sup tbody tfoot thead u var".split())
    for spelled in (name, name.upper()) for sign in ("", "/")}
PLAIN_MOST = max(map(len, PLAIN)) + 2
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag to its ">", every quoted value in it closed; group 1 ends with the name.
TAG = re.compile(r"""<(/?([a-zA-Z][a-zA-Z0-9:-]*+))[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
#: A path from the root that joins to any base as it stands: no empty, "." or ".." segment, no query, no fragment.
ROOTED = re.compile(r"(?:/[\w%~-][\w%~.-]*+)++/?")
HREF = re.compile(r"""[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN_END = {name: re.compile(rf"</{name}(?![a-z0-9:-])", re.I) for name in HIDDEN}
META_CHARSET = re.compile(rb"<meta[^<>]*?charset\s*=\s*[\"']?\s*([a-zA-Z0-9_.:-]+)", re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([a-zA-Z0-9_.:-]+)", re.I)
BREAKS = re.compile(r"[\r\n]+")
RESULT = [
    ("kind", "string"), ("record_id", "string"), ("refers_to", "string"), ("target_uri", "string"), ("warc_date", "string"),
    ("source_digest", "string"), ("digest_ok", "boolean"), ("block_digest", "string"), ("content_length", "long"),
    ("n_outlinks", "long"), ("reason", "string"), ("block_ok", "boolean"), ("record", "binary"),
]


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and named fields; a line that starts with white space continues the one before."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0], fields


def record_bytes(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def read_page(page: str, base: str) -> tuple[str, str, list[str]]:
    """Plain text, title and outlinks of a page, in one pass over its tags."""
    parts: list[str] = []
    links: dict[str, None] = {}
    title: list[str] | None = None
    titles: list[str] = []
    unclosed: set[str] = set()
    root: str | None = None
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            if title is not None:
                title.append(page[at:lt])
        if lt == n:
            break
        gt = page.find(">", lt, lt + PLAIN_MOST)
        if gt > 0 and (left := PLAIN.get(page[lt + 1:gt])) is not None:
            if left:
                parts.append(left)
            at = gt + 1
            continue
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if m := TAG.match(page, lt):
            name, named, end = m.group(2).lower(), m.end(1), m.end()
        elif m := NAME.match(page, lt + 1):
            name, named, end = m.group(1).lower(), m.end(), _tag_end(page, m.end())
        else:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):  # doctype and the like
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a lone sign is text
                parts.append("<")
                at = lt + 1
            continue
        closing = page[lt + 1] == "/"
        at = end
        if name in HIDDEN and not closing and name not in unclosed and not page.endswith("/>", lt, end):
            if close := HIDDEN_END[name].search(page, end):
                at = _tag_end(page, close.end())
            elif name in ("script", "style"):
                at = n
            else:
                unclosed.add(name)
            continue
        if name == "a" and not closing and (found := HREF.search(page, named, end)):
            link = html.unescape(found.group(found.lastindex)).strip()
            if link and not link.startswith(("#", "javascript:", "mailto:", "data:")):
                try:
                    if ROOTED.fullmatch(link):
                        if root is None:
                            root = urljoin(base, "/")[:-1]
                        links.setdefault(root + link, None)
                    else:
                        links.setdefault(urljoin(base, link), None)
                except ValueError:  # not a readable address
                    links.setdefault(link, None)
        if name == "title":
            if closing:
                titles, title = titles or title or [], None
            else:
                title = []
        if name in BREAKING:
            parts.append("\n")
    lines = html.unescape("".join(parts)).replace("\r", "\n").split("\n")
    text = "\n".join(filter(None, [" ".join(x.split()) for x in lines if x]))
    return text, " ".join(html.unescape("".join(titles)).split()), list(links)


def _tag_end(page: str, at: int) -> int:
    """Place after the tag's ">", which may stand inside a quoted value before that."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = min((q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end + 1
        close = page.find(page[quote], quote + 1)
        if close < 0:
            return end + 1
        at = close + 1


def _decoded(payload: bytes, http: list[tuple[str, str]]) -> tuple[str, str]:
    named = next((v for k, v in http if k.lower() == "content-type"), "").encode()
    found = CHARSET.search(named) or META_CHARSET.search(payload)
    charset = found.group(1).decode().lower() if found else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def _joined(payload: bytes) -> bytes | None:
    """The body of a chunked payload; None if its chunks do not add up."""
    parts, at = [], 0
    while True:
        end = payload.find(CRLF, at)
        size = payload[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        at = end + 2
        if payload[at + n:at + n + 2] != CRLF:
            return None
        parts.append(payload[at:at + n])
        at += n + 2


def _unpacked(body: bytes, coding: str) -> bytes | None:
    """The body without one content coding; None if that is unknown or the data is broken or cut."""
    windows = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
    for bits in windows:
        try:
            out, rest = [], body
            while rest:  # gzip data may have several members
                unpack = zlib.decompressobj(bits)
                out.append(unpack.decompress(rest))
                if not unpack.eof:
                    raise zlib.error("cut")
                rest = unpack.unused_data if coding != "deflate" else b""
            return b"".join(out)
        except zlib.error:
            continue
    return body if coding == "identity" else None


def _body(payload: bytes, http: list[tuple[str, str]]) -> tuple[bytes, bytes, str | None]:
    """The joined payload, the body to read, and why the latter is empty if it could not be read."""
    named = lambda name: [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",") if x.strip()]
    if "chunked" in named("transfer-encoding"):
        whole = _joined(payload)
        if whole is None:
            return payload, b"", "broken chunks"
        payload = whole
    body = payload
    for coding in reversed(named("content-encoding")):
        unpacked = _unpacked(body, coding)
        if unpacked is None:
            return payload, b"", f"content coding {coding} not read"
        body = unpacked
    return payload, body, None


def digest_matches(label: str | None, *data: bytes) -> bool | None:
    """Whether a labelled digest (base 32 or hexadecimal) is that of one of ``data``; None without one or for an unknown function."""
    function, _, value = (label or "").partition(":")
    function = function.strip().lower().replace("-", "")
    if function not in ("md5", "sha1", "sha256", "sha512") or not value:
        return None
    value = value.strip().lower()
    made = (hashlib.new(function, d) for d in data)
    return any(value == m.hexdigest() or value == base64.b32encode(m.digest()).decode().lower() for m in made)


def derive_record(raw: bytes | None) -> list[tuple]:
    """Result rows of one response record, in the order of RESULT."""
    skipped = lambda why: [("skipped", *[None] * 9, why, None, None)]
    if not raw or not raw.startswith(b"WARC/"):
        return skipped("not a WARC record")
    head, found, rest = raw.partition(CRLF + CRLF)
    if not found:
        return skipped("no end of the WARC headers")
    fields = _headers(head)[1]
    own = {k.lower(): v for k, v in reversed(fields)}
    if own.get("warc-type", "").lower() != "response":
        return skipped(f"type {own.get('warc-type', 'missing')}")
    if not own.get("content-length", "").isdigit() or not own.get("warc-record-id"):
        return skipped("no length or no id")
    block = rest[:int(own["content-length"])]
    if len(block) < int(own["content-length"]):
        return skipped("shorter than its length")
    http_head, found, payload = block.partition(CRLF + CRLF)
    status, http = _headers(http_head) if found else ("", [])
    if not found:
        payload = block
    source, target, date = own["warc-record-id"], own.get("warc-target-uri"), own.get("warc-date")
    digest = own.get("warc-payload-digest")
    joined, body, why = _body(payload, http)
    ok = digest_matches(digest, payload) if joined is payload else digest_matches(digest, payload, joined)
    block_ok = digest_matches(own.get("warc-block-digest"), block)
    page, charset = _decoded(body, http)
    text, title, links = read_page(page, target or "")
    lines = [("refers-to-type", "response"), *[(f"source-{k.lower()}", v) for k, v in fields], ("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in http],
             ("charset", charset), ("title", title), *[("outlink", x) for x in links]]
    clean = lambda v: BREAKS.sub(" ", v) if "\n" in v or "\r" in v else v
    blocks = (("metadata", "application/warc-fields", "".join(f"{k}: {clean(v)}\r\n" for k, v in lines).encode("utf-8", "replace")),
              ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    out = []
    for kind, content, body in blocks:
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"
        block_digest = sha1_label(body)
        made = record_bytes(
            [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", target),
             ("WARC-Date", date), ("WARC-Refers-To-Payload-Digest", digest), ("WARC-Block-Digest", block_digest),
             ("Content-Type", content)], body)
        out.append((kind, name, source, target, date, digest, ok, block_digest, len(body), len(links), why, block_ok, made))
    return out


def derive(responses: DataFrame, column: str = "record") -> DataFrame:
    """Rows of RESULT for every row of ``responses``, whose ``column`` holds a record's bytes; other columns are repeated."""
    added = [k for k, _ in RESULT]
    carried = [c for c in responses.columns if c != column and c not in added]
    rows = responses.select(*carried, F.col(column).cast("binary").alias(column))
    schema = T.StructType([rows.schema[c] for c in carried] + [T.StructField(k, T._parse_datatype_string(t)) for k, t in RESULT])
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                rows, owner = [], []
                for i, raw in enumerate(piece.column(len(carried)).to_pylist()):
                    made = derive_record(raw)
                    rows += made
                    owner += [i] * len(made)
                own = piece.select(list(range(len(carried)))).take(pa.array(owner, pa.int64())) if carried else None
                columns = [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays([*(own.columns if own else []), *columns], names=[*carried, *added])

    return rows.mapInArrow(build, schema)


def as_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and the response record of every row of ``pages`` (page_id, url, html); a null page has an empty payload."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                payload = (page or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                digest = sha1_label(payload)
                made.append(record_bytes(
                    [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}')}>"),
                     ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest),
                     ("WARC-Block-Digest", sha1_label(block)), ("Content-Type", "application/http; msgtype=response")], block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\r\n]+", " ").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(build, "page_id long, record binary")


def op7_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(as_responses(read_table(spark, sf_dir, "pages")))
    return out.withColumn("record", F.decode("record", "UTF-8"))
