"""WARC derivatives: of each response record a metadata record and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import textnum
from tessella.llm.cluster import lean, ship

VERSION = "WARC/1.1"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
_MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)[^>]*>|[/!?][^>]*>)")
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "head", "template", "noscript")}
_BREAKS = frozenset("p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 nav header footer section article main aside blockquote pre hr body html form dl dt dd".split())
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"']+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)
_TITLE_END = re.compile(r"</title\s*>", re.I)
_SPECIAL = frozenset(["a", "title", "html", *_HIDDEN])
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    """An identifier that depends on the names alone, so that a task run again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(names))}>"


class Scan:
    """A page's visible text (`shown`, with \n where blocks begin and end), its links' href as written, its title and language.

    One pass, whatever the page: a comment goes to its -->, a hidden element to its end tag, any other tag to the next >.
    What has no end is looked for once: a comment or hidden element without one is an ordinary tag, and after the last >
    all is text. Linear in the page's length. title: of the first title tag, if it ends; language: lang of the first html tag.
    """

    def __init__(self, page: str):
        self.links: list[str] = []
        self.title = self.language = None
        out: list[str] = []
        done, last, met, endless = 0, page.rfind(">") + 1, set(), set()
        for tag in _MARKUP.finditer(page, 0, last):  # up to last every tag ends; none reaches over the end of what is skipped
            at, name, stop = tag.start(), tag[3], tag.end()
            kind = name.lower() if name else ""
            if kind in _SPECIAL and not tag[2]:
                if kind == "title" and kind not in met:
                    end = _TITLE_END.search(page, stop)
                    if end:
                        self.title = _BLANKS.sub(" ", html.unescape(Scan(page[stop : end.start()]).shown)).strip()
                elif kind == "html" and kind not in met:
                    told = _LANG.search(page, tag.end(3), stop - 1)
                    self.language = told[1] if told else None
                elif at >= done and kind == "a":
                    link = _HREF.search(page, tag.end(3), stop - 1)
                    if link:
                        self.links.append(next(x for x in link.groups() if x is not None))
                elif at >= done and kind in _HIDDEN and kind not in endless:
                    end = _HIDDEN[kind].search(page, stop)
                    if end:
                        stop = end.end()
                    else:
                        endless.add(kind)
                met.add(kind)
            if at < done:
                continue
            if tag[1]:
                stop = page.find("-->", at + 4) + 3 if "--" not in endless else 2
                if stop < 3:
                    endless.add("--")
                    stop = page.find(">", at) + 1
            out.append(page[done:at])
            if kind in _BREAKS:
                out.append("\n")
            done = stop
        out.append(page[done:])
        self.shown = "".join(out)


def plain_text(shown: str) -> str:
    """Scanned text, a line for each block: entities resolved, blanks and blank lines folded."""
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(shown).split("\n"))
    return "\n".join(line for line in lines if line)


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+\s*", " ", value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {one_line(value)}" for name, value in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file's bytes: headers and block."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages: the key, record_id, target_uri, date, status, http_headers and payload.

    A page without a body (null) has an empty payload, one without a url an empty target, one without a key the key null.
    The identifier comes of key and url. Repeated rows give repeated records. Other columns are left out, whatever their
    names. An empty table gives an empty result. The table tells neither when nor how a page was fetched: the date is a
    parameter, status and headers are those of a plain answer.
    """
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    names = ["record_id", "target_uri", "date", "status", "http_headers", "payload"]

    def run(parts):
        for part in textnum.slices(parts, body):
            rows = []
            for k, u, h in zip(part.column(key).to_pylist(), part.column(url).to_pylist(), part.column(body).to_pylist(), strict=True):
                payload = (h or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
                rows.append((record_id("response", str(k), u or ""), u or "", date, 200, head, payload))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True))], [key, *names])

    return pages.select(key, url, body).mapInArrow(lean(run), f"`{key}` {kind}, record_id string, target_uri string, date string, status int, http_headers string, payload binary")


def charset(http_headers: str) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", http_headers, re.I)
    try:
        return "".encode(found[1]) is not None and found[1] if found else "utf-8"
    except LookupError:
        return "utf-8"


def derive(key: object, source: str, uri: str, date: str, http_headers: str, payload: bytes) -> list[tuple]:
    """The two records of one response: (type, record id, content type, headers, block)."""
    page = payload.decode(charset(http_headers), "replace")
    http = http_headers.encode() + b"\r\n\r\n" + payload
    common = [("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To-Block-Digest", digest(http)), ("WARC-Refers-To-Payload-Digest", digest(payload))]
    seen = Scan(page)
    status, *fields = http_headers.split("\r\n")
    told = [("http-status", status), *((f"http-header-{f.split(':', 1)[0].strip().lower()}", f.split(":", 1)[1].strip()) for f in fields if ":" in f)]
    if seen.title is not None:
        told.append(("title", seen.title))
    if seen.language:
        told.append(("languages-html", seen.language))
    told += [("outlink", f"{html.unescape(link)} L a/@href") for link in seen.links]
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in told).encode()), ("conversion", "text/plain; charset=utf-8", plain_text(seen.shown).encode())):
        own = record_id(kind, source)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("Content-Type", content), ("WARC-Block-Digest", digest(block))]
        out.append((kind, own, content, headers, block))
    return out


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response: the key, kind (metadata, conversion), record_id, refers_to, target_uri, source_payload_digest, block_digest and record (the bytes of the WARC record).

    The metadata block lists the source's HTTP status and headers, title, language and links; the conversion block is
    the page's plain text. Null payloads, headers and targets count as empty; responses with equal identifiers (repeated
    rows) give equal records, and a null key stays null. Very long pages are read in one pass. Other columns of records
    are left out, whatever their names. An empty table gives an empty result. No shuffle: records are made where the
    response is read.
    """
    ship(records.sparkSession)
    kind = records.schema[key].dataType.simpleString()
    names = [key, "kind", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "block_bytes", "record"]

    def run(parts):
        for part in textnum.slices(parts, "payload", 1 << 21):
            owner, rows = [], []
            for i, r in enumerate(part.select(["record_id", "target_uri", "date", "http_headers", "payload"]).to_pylist()):
                for what, own, _, headers, block in derive(None, r["record_id"] or "", r["target_uri"] or "", r["date"] or "", r["http_headers"] or "", r["payload"] or b""):
                    owner.append(i)
                    said = dict(headers)
                    rows.append((what, own, r["record_id"], r["target_uri"], said["WARC-Refers-To-Payload-Digest"], said["WARC-Block-Digest"], len(block), record(headers, block)))
            columns = zip(*rows, strict=True)
            types = (*[pa.string()] * 6, pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(np.array(owner))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    chosen = records.select(key, "record_id", "target_uri", "date", "http_headers", "payload")
    return chosen.mapInArrow(lean(run), f"`{key}` {kind}, kind string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, block_bytes bigint, record binary")


def write_warc(made: DataFrame, folder: str) -> DataFrame:
    """Writes the record column, one gzip member a record, a file a partition, to a folder that all machines share; gives a row (file, records) for each.

    A task writes under a name of its own and renames at the end, so a lost or repeated task leaves whole files only.
    """
    ship(made.sparkSession)

    def run(parts):
        import gzip

        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        own, n = f"{name}.{TaskContext.get().taskAttemptId()}", 0
        with store.open_output_stream(own, compression=None) as out:
            for part in parts:
                for x in part.column("record"):
                    out.write(gzip.compress(x.as_py(), mtime=0))
                    n += 1
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return made.select("record").mapInArrow(lean(run), "file string, records bigint")
