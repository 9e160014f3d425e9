"""Operator 3: WARC archives, one gzip member a record, written and read sequentially.

Writing.  A payload's digest is a native column.  Digests of payloads of at least
``REVISIT_BYTES`` are counted before anything is shuffled whole; only the groups of two or more
are joined back to the pages (adaptive execution splits a hot digest), and each task writes its
records to one archive in the shared folder.  A revisit record has the HTTP header of its page
but no payload, and refers to the response's record.

Reading.  Archives are read in blocks of ``BLOCK`` bytes through an incremental zlib inflater, a
member's end starts the next record.  The header is parsed as soon as it is complete; from then
on Content-Length frames the record's block, whose bytes go through the digests as they
come and are kept only if the payload is asked for.  Whatever is malformed is a WarcError.

Defined results: page ids are whole numbers (cast to long; ids that are none fail the job).  A
null html is an empty payload.  A null page_id is always a response with a record id of its own,
from the archive and its place in it; pages are sorted, so a repeated task writes the same file.
A URL comes back as it was, null too: what no header can hold is percent-encoded there and kept
whole in a field of its own.  Rows that repeat both page_id and payload of a response are
responses too; other repeated ids are judged by their payloads.  An empty table gives no archive
and no row.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage

REVISIT_BYTES = 100
BLOCK = 1 << 16
#: WARC-Date of every record: the tables have no crawl time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_ROWS = 500
#: The longest header that is read.
HEAD_BYTES = 1 << 20


class WarcError(ValueError):
    """An archive that is cut off, mis-framed or fails its digest."""


def record_id(page_id: int | None, place: str = "") -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none-{place}>"


def page_of(identifier: str | None) -> int | None:
    tail = (identifier or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?[0-9]+", tail) else None


#: A field for URLs that the standard's can't hold, as a JSON value.
SOURCE = "WARC-X-Source-URI"


def _target(url: str | None) -> list[str]:
    """The header lines of a URL: spaces and control characters can't stand in one."""
    plain = "urn:none" if url is None else re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    return [f"WARC-Target-URI: {plain}", *([f"{SOURCE}: {json.dumps(url)}"] if plain != url else [])]


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, place: str = "") -> bytes:
    """One record as a gzip member: a response, or a revisit of page ``refers_to``; ``place`` names
    a page that has no id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, place)}",
        f"WARC-Date: {DATE}",
        *_target(url),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + press.flush()


class Member:
    """One gzip member, inflated as it is read; ``rest`` holds what follows it in the file."""

    def __init__(self, handle, rest: bytes, block: int):
        self.handle, self.rest, self.block = handle, rest, block
        self.inflate, self.ready = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate up to ``block`` more bytes; False at the member's end."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.rest or self.handle.read(self.block)
            self.rest = b""
            if not data:
                raise WarcError("cut-off gzip member")
            try:
                got = self.inflate.decompress(data, self.block)
            except zlib.error as error:
                raise WarcError(f"bad gzip member: {error}") from error
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            if got:
                self.ready += got
                return True
        return False

    def head(self, limit: int) -> bytes:
        """The bytes up to an empty line."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > limit or not self.more():
                raise WarcError("record without a header end")
        head, self.ready = self.ready[:at], self.ready[at + 4 :]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in parts."""
        while size:
            if not self.ready and not self.more():
                raise WarcError("block is shorter than Content-Length")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part

    def tail(self) -> bytes:
        """What is left; a few bytes in a sound record."""
        while len(self.ready) <= 4 and self.more():
            pass
        return self.ready


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    try:
        first, *lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as error:
        raise WarcError(f"header is no UTF-8: {error}") from error
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def _need(fields: dict[str, str], name: str) -> str:
    if name not in fields:
        raise WarcError(f"record without {name}")
    return fields[name]


def _length(fields: dict[str, str]) -> int:
    value = _need(fields, "content-length")
    if not re.fullmatch("[0-9]+", value):
        raise WarcError(f"bad content-length {value!r}")
    return int(value)


def _url(fields: dict[str, str]) -> str | None:
    if SOURCE.lower() not in fields:
        return _need(fields, "warc-target-uri")
    try:
        return json.loads(fields[SOURCE.lower()])
    except ValueError as error:
        raise WarcError(f"bad {SOURCE}") from error


def read_record(member: Member, with_payload: bool = True) -> dict:
    """Headers, payload and its length of one record; digests are verified on the way."""
    version, fields = _fields(member.head(HEAD_BYTES))
    if not version.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {version!r}")
    size, kind = _length(fields), _need(fields, "warc-type")
    block, payload, head, n, kept = hashlib.sha256(), hashlib.sha256(), b"", 0, []
    length = None
    for part in member.take(size):
        block.update(part)
        if length is None:
            head += part
            http, gap, part = head.partition(b"\r\n\r\n")
            if not gap:
                if len(head) > HEAD_BYTES:
                    raise WarcError("HTTP header without an end")
                continue
            length = _length(_fields(http)[1])
        payload.update(part)
        n += len(part)
        if with_payload:
            kept.append(part)
    if length is None:
        raise WarcError("block without an HTTP header")
    if member.tail() != b"\r\n\r\n":
        raise WarcError("block is longer than Content-Length")
    if _need(fields, "warc-block-digest") != f"sha256:{block.hexdigest()}":
        raise WarcError("block digest differs")
    digest = _need(fields, "warc-payload-digest").removeprefix("sha256:")
    if kind == "response" and (n != length or payload.hexdigest() != digest):
        raise WarcError("payload digest or length differs")
    return {"page_id": page_of(_need(fields, "warc-record-id")), "url": _url(fields), "type": kind, "payload": b"".join(kept), "payload_bytes": length, "payload_digest": digest, "refers_to": page_of(fields.get("warc-refers-to"))}


def read_archive(handle, with_payload: bool = True, block: int = BLOCK) -> Iterator[dict]:
    """The records of an archive, one after the other."""
    rest = b""
    while rest := rest or handle.read(block):
        member = Member(handle, rest, block)
        yield read_record(member, with_payload)
        rest = member.rest


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages to archives under ``out``; the manifest has path and n_records of each, one
    row a partition at most."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where((F.length("payload") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    # In one order, so that a task which is run again writes the same file.
    joined = joined.sortWithinPartitions("page_id", "url", "refers_to", F.xxhash64("payload"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, n, file, handle = f"{out}/pages-{part:06d}.warc.gz", 0, None, None
        try:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if file is None:
                        file = storage.AtomicFile(path)
                        handle = file.__enter__()
                    handle.write(encode_record(page_id, url, payload, refers_to, f"{part}-{n}"))
                    n += 1
        except BaseException as error:
            if file is not None:
                file.__exit__(type(error), error, None)
            raise
        if file is not None:
            file.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return storage.gathered(joined.mapInArrow(save, "path string, n_records long"))


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row a record of the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url (and payload, empty for revisits).  One archive a task."""
    spark = manifest.sparkSession
    paths = [r.path for r in manifest.select("path").orderBy("path").collect()]
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    names = ["page_id", "payload_bytes", "payload_digest", "type", "refers_to", "url", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=["record_type" if n == "type" else n for n in names])

        for batch in batches:
            for k in batch.column(0).to_pylist():
                with storage.open_input(paths[k]) as handle:
                    rows = []
                    for record in read_archive(handle, with_payload):
                        rows.append(record)
                        if len(rows) == READ_ROWS:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    if not paths:
        return spark.createDataFrame([], columns)
    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(load, columns)
