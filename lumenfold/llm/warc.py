"""WARC derivatives: from response records to metadata and conversion records.

Each response gives a ``metadata`` record (title, language, outlinks) and a
``conversion`` record (plain text).  Both refer to the response by WARC-Refers-To,
keep the source's target, date and other headers, name its digests as
WARC-Source-Payload-Digest and WARC-Source-Block-Digest, and carry a digest of their own.
A record depends on its response alone, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Ids of records made here are name-based in this space.
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Headers that say what a record itself is; its derivatives have their own and keep all others as they are.
OWN_HEADERS = frozenset("warc-type warc-record-id warc-refers-to content-type content-length warc-block-digest warc-payload-digest warc-source-payload-digest warc-source-block-digest warc-segment-number warc-segment-origin-id warc-segment-total-length".split())

#: Elements whose text is not shown, those of them whose content is no markup, and elements that begin a line.
HIDDEN = frozenset("head noscript script style template".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table td th tr ul".split())
_OPEN = re.compile(r"<(?:!--|[/!?a-zA-Z])")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_LANG = re.compile(r"""(?is)\blang\s*=\s*["']?([\w-]+)""")
_HREF = re.compile(r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


@dataclass
class Page:
    """What one pass over a page's tags gives."""

    shown: list[str] = field(default_factory=list)
    title: str | None = None
    lang: str | None = None
    links: dict[str, None] = field(default_factory=dict)


def scan_page(page: str) -> Page:
    """Title, language, links and visible pieces, in one pass from left to right.

    Every search goes on where the last one ended, and a closing tag that was not
    found once isn't looked for again, so the work is in proportion to the page
    whatever it holds.  A tag without an end takes the rest of the page, as does an
    element whose content isn't shown and that is never closed.
    """
    out, low, at, hidden = Page(), page.lower(), 0, ""
    if len(low) != len(page):  # letters whose lower case is longer would shift the places
        low = "".join(c.lower() if c.isascii() else c for c in page)
    title_from = -1
    absent: set[str] = set()
    while m := _OPEN.search(page, at):
        start = m.start()
        if not hidden:
            out.shown.append(page[at:start])
        if m[0] == "<!--":
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            out.shown.append("" if hidden else " ")
            continue
        end = page.find(">", start)
        tag, at = page[start + 1 : len(page) if end < 0 else end], len(page) if end < 0 else end + 1
        if not (n := _NAME.match(tag)):
            continue
        name, closing = n[1].lower(), tag[0] == "/"
        if name == "title":
            if closing and title_from >= 0 and out.title is None:
                out.title = _one_line(page[title_from:start])
            title_from = -1 if closing else at
        elif not closing and name == "html" and out.lang is None and (found := _LANG.search(tag)):
            out.lang = found[1].lower()
        elif not closing and name == "a" and (found := _HREF.search(tag)):
            out.links.setdefault(_one_line(next(g for g in found.groups() if g is not None)))
        if not closing and name in RAW:
            close = -1 if name in absent else low.find("</" + name, at)
            if close < 0:
                absent.add(name)
            at = len(page) if close < 0 else close
        if hidden:
            if (closing and name == hidden) or (hidden == "head" and name == "body"):
                hidden = ""
                out.shown.append("\n" if name in BLOCKS else " ")
        elif not closing and name in HIDDEN:
            hidden = name
        elif name in BLOCKS:
            out.shown.append("\n")
    if not hidden:
        out.shown.append(page[at:])
    return out


def plain_text(page: Page) -> str:
    """The visible text: a line for each block, white space joined, entities decoded."""
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape("".join(page.shown)).split("\n")) if x)


def _one_line(value: str) -> str:
    return " ".join(html.unescape(value).split())


def page_facts(page: Page) -> list[tuple[str, str]]:
    """(field, value) of a metadata record's body."""
    out = [] if page.title is None else [("title", page.title)]
    if page.lang:
        out.append(("languages-declared", page.lang))
    return out + [("outlink", u) for u in page.links if u]


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record as it stands in a file; ``error`` says why it can't be read whole."""

    headers: list[tuple[str, str]]
    block: bytes
    error: str | None = None


def inflated(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of a gzip file, member by member, and what is wrong with it; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error as e:
            return b"".join(out), f"gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip: the file ends inside a member"
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out), "gzip: no member after the last one" if data else None


_HEAD_END = re.compile(rb"\r?\n\r?\n")
_RECORD_START = re.compile(rb"(?:\A|(?<=\n))WARC/\d")


def _headers(head: bytes) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(data: bytes) -> Iterator[Record]:
    """Each record of a WARC file.  Where a record can't be read, what there is of it
    comes with an error, and reading goes on at the next line that begins a record."""
    data, wrong = inflated(data)
    at = 0
    while at < len(data):
        found = _RECORD_START.search(data, at)
        if (junk := data[at : found.start() if found else len(data)]).strip():
            yield Record([], junk, f"no record at byte {at}")
        if not found:
            break
        at = found.start()
        head = _HEAD_END.search(data, at)
        if not head:
            yield Record(_headers(data[at:]), b"", "the file ends inside a record's head")
            break
        headers = _headers(data[at : head.start()])
        named = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not named.isascii() or not named.isdigit():
            after = _RECORD_START.search(data, head.end())
            at = after.start() if after else len(data)
            yield Record(headers, data[head.end() : at], f"Content-Length is {named!r}")
            continue
        at = head.end() + int(named)
        if at > len(data):
            yield Record(headers, data[head.end() :], "the file ends inside a record's block")
            break
        yield Record(headers, data[head.end() : at])
    if wrong:
        yield Record([], b"", wrong)


_CHARSET = re.compile(rb"""(?i)charset\s*=\s*["']?([\w.:-]+)""")


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(head, payload) of an HTTP message; without a head the block is the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(end)) for end in (b"\r\n\r\n", b"\n\n") if (at := block.find(end)) >= 0]
    if not ends:
        return block, b""
    at, size = min(ends)
    return block[:at], block[at + size :]


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data  # stored without its chunks
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) or data


def decoded(head: bytes, payload: bytes) -> str:
    """The payload as text: its transfer and content coding undone, in the charset that
    the head or the page names, else UTF-8."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.splitlines()[1:])}
    if b"chunked" in fields.get(b"transfer-encoding", b"").lower():
        payload = _dechunked(payload)
    if (coding := fields.get(b"content-encoding", b"").lower()) in (b"gzip", b"x-gzip", b"deflate"):
        for bits in (47, -15):
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:  # stored decoded already, or raw deflate
                continue
    named = _CHARSET.search(fields.get(b"content-type", b"")) or (_CHARSET.search(payload[:2048]) if head else None)
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: ``key``, ``record_id``, ``headers`` (map) and
    ``payload``.  The id is made of key and url; a null payload is empty."""
    k, u = F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    # A name-based id: the digest's first 128 bits, with the version and variant bits of such ids.
    d = F.sha1(F.concat_ws("\x1f", F.lit("response"), k, u).cast("binary"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(d, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    uid = F.concat(F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12), F.lit(">"))
    headers = F.create_map(F.lit("WARC-Target-URI"), u, F.lit("WARC-Date"), F.lit(date), F.lit("WARC-Page-ID"), k)
    return pages.select(F.col(key).alias("_key"), uid.alias("record_id"), headers.alias("headers"), F.coalesce(F.col(page), F.lit("")).alias("payload")).withColumnRenamed("_key", key)


_RECORD = "warc_type string, record_id string, refers_to string, target_uri string, content_type string, block string, block_digest string, source_digest string, n_links int, record binary"


def derive(source: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows, metadata and conversion, for each response (``record_id``,
    ``headers``, ``payload``): ``keep`` with the record's type, id, the id it refers to,
    its block and digests, and ``record``, the bytes to write.  The source's digests
    stand as its headers give them; only where there is none, one of the payload is
    made: of ``payload_bytes`` if there is such a column, else of the text.

    Ids are made of the response's id, so a repeated run gives the same records and
    repeated rows repeat theirs.  A null payload is an empty page: its conversion has
    an empty block, its metadata no fields.  A response without id has refers_to ''.
    An empty table gives no rows.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    df = source.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.coalesce("record_id", F.lit("")).alias("i"), F.map_entries("headers").alias("h"), F.coalesce("payload", F.lit("")).alias("p"), (F.col("payload_bytes") if "payload_bytes" in source.columns else F.lit(None).cast("binary")).alias("r"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, rows = len(names), [], []
            for j, (i, h, p, r) in enumerate(zip(*(b.column(c).to_pylist() for c in (n, n + 1, n + 2, n + 3)))):
                rows += _derivatives(i, {e["key"]: e["value"] for e in h or ()}, p, r)
                at += [j, j]
            fields = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.string()] * 8 + [pa.int32(), pa.binary()]
            taken = b.select(range(n)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(f, t) for f, t in zip(fields, kinds))], names=[*names, *(x.split()[0] for x in _RECORD.split(", "))])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[: len(names)])
    out = df.mapInArrow(build, kinds + _RECORD)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, names)], *out.columns[len(names) :])


def _derivatives(source_id: str, source: dict[str, str], page: str, payload: bytes | None) -> list[tuple]:
    scanned = scan_page(page)
    facts = page_facts(scanned)
    named = {k.lower(): v for k, v in source.items()}
    paid = named.get("warc-payload-digest") or digest(page.encode("utf-8", "replace") if payload is None else payload)
    whole = named.get("warc-block-digest")
    made = []
    for kind, mime, block in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts)),
        ("conversion", "text/plain; charset=utf-8", plain_text(scanned)),
    ):
        raw = block.encode("utf-8", "replace")
        own, sum_ = record_id(kind, source_id), digest(raw)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id)]
        headers += [(k, v) for k, v in source.items() if v and k.lower() not in OWN_HEADERS]
        headers += [("WARC-Source-Payload-Digest", paid), *([("WARC-Source-Block-Digest", whole)] if whole else []), ("WARC-Block-Digest", sum_), ("Content-Type", mime), ("Content-Length", str(len(raw)))]
        links = sum(k == "outlink" for k, _ in facts)
        made.append((kind, own, source_id, named.get("warc-target-uri") or "", mime, block, sum_, paid, links, serialize([(k, _header(v)) for k, v in headers], raw)))
    return made


def _header(value: str) -> str:
    """A header's value stays on its line."""
    return re.sub(r"[\r\n]+", " ", value)


#: Bytes of payloads that leave a task at once.
_FLUSH_BYTES = 8 << 20
_READ = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.string()), ("payload_bytes", pa.binary()), ("error", pa.string())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: ``record_id``, ``warc_type``, ``headers``,
    ``payload`` (the text, without an HTTP head), ``payload_bytes`` (as they stand) and
    ``error`` (null for a whole record; see ``parse``).

    Header names keep their spelling, and of repeated names the last one stays.  A file
    is a row of Spark's binary source, so it is held whole by one task and has at most
    2 GB; its records leave in small batches.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for r in parse(data.as_py()):
                    low = {k.lower(): v for k, v in r.headers}
                    head, payload = http_parts(r.block) if low.get("content-type", "").lower().startswith("application/http") else (b"", r.block)
                    rows.append((low.get("warc-record-id"), low.get("warc-type"), list(dict(r.headers).items()), decoded(head, payload), payload, r.error))
                    size += len(payload)
                    if size > _FLUSH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(split, "record_id string, warc_type string, headers map<string,string>, payload string, payload_bytes binary, error string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
