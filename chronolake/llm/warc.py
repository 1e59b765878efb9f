"""WARC archives: write them as whole-file gzip streams, normalise those to a member per record, read back by offset.

A whole-file stream can only be read from its start. The normaliser inflates it once, in pieces of
bounded size, writes each record as a gzip member of its own, and writes a sidecar index with each
record's offset and length, so that a record can then be read alone.

Files lie in the shared folder and are reached through pyarrow's file systems, so an address may
name any store that those reach. Each attempt of a task writes files of its own name; only the rows
that a finished task returns name files, so an attempt that is lost or repeated leaves no trace.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm.common import materialize, remove, shared_dir

#: Raw bytes after which a writer begins another archive.
ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 20
#: A header longer than this isn't one; an address may be nearly as long.
HEADER_BYTES = 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SUFFIX = ".index.jsonl"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+://?", uri) else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    """A header's value on one line: control characters as percent escapes."""
    return "" if value is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _id(value: object) -> str:
    """An id of any kind in a header; numbers stay as they are."""
    return quote(str(value), safe="")


def record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """A response with its payload, or a revisit (``refers_to`` not null) with the HTTP header only."""
    digest = payload_digest(payload)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>"), ("X-Refers-To-Page", _id(refers_to))] if revisit else []),
        *([("X-Page", _id(page_id))] if page_id is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_header(raw: bytes) -> dict[str, str]:
    """Fields of a record's header, names in lower case."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class _Inflater:
    """The bytes of a gzip file, whether of one member or many, in order."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.z, self.raw, self.buffer, self.over = f, zlib.decompressobj(31), b"", bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            if self.z.eof:
                self.raw = self.z.unused_data or self.f.read(CHUNK)
                if not self.raw:
                    self.over = True
                    break
                self.z = zlib.decompressobj(31)
            elif not self.raw:
                self.raw = self.f.read(CHUNK)
                if not self.raw:
                    raise ValueError("the stream ends inside a member")
            out = self.z.decompress(self.raw, CHUNK)
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        at = self.buffer.find(mark)
        while at < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if len(self.buffer) > most or not self._more():
                if self.buffer:
                    raise ValueError("a header has no end")
                return None
            at = self.buffer.find(mark, seen)
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the file ends inside a record")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def normalise_stream(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Rewrite each record of ``source`` as a member of ``target``; one JSON line for each goes to ``index``. Returns the number of records."""
    stream, at, n = _Inflater(source), 0, 0
    while (head := stream.until(b"\r\n\r\n", HEADER_BYTES)) is not None:
        fields = parse_header(head)
        z, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        size += target.write(z.compress(head))
        for part in stream.exactly(int(fields["content-length"]) + 4):
            size += target.write(z.compress(part))
        size += target.write(z.flush())
        entry = {"offset": at, "length": size, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "page": fields.get("x-page")}
        index.write(json.dumps(entry).encode() + b"\n")
        at += size
        n += 1
    return n


def read_record(archive: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the one record whose member lies at ``offset``."""
    archive.seek(offset)
    raw = zlib.decompress(archive.read(length), 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = parse_header(head)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the record at {offset} has another length than its header says")
    return fields, rest[:size]


# ---------------------------------------------------------------- on DataFrames


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``id``, ``url``, ``payload`` (binary, null as empty) and ``refers_to``: the least id of the records with an equal payload, null if that's the row's own.

    Only payloads of at least ``min_bytes`` refer. Groups are found by digest and length; what is
    joined back is the written table of payloads that occur twice or more, so Spark knows its size
    and broadcasts it only below its threshold; above, AQE splits groups that hold many rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).alias("id"), *([F.col("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]), payload.alias("payload"))
    keyed = keyed.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = materialize(groups.select("sha", "size", "least"), "again")
    found = keyed.join(again, ["sha", "size"], "left")
    # As strings, ids beside nulls keep all their digits in pandas.
    return found.select(F.col("id").cast("string"), "url", "payload", F.when(F.col("id") != F.col("least"), F.col("least")).cast("string").alias("refers_to"))


def write_archives(rows: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of :func:`with_revisits` as whole-file gzip streams below ``root``. One row per archive: ``archive``, ``records``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        done, out, z = [], None, None
        raw = records = 0

        def close() -> None:
            nonlocal out
            if out:
                out.write(z.flush())
                out.close()
                done.append((name, records))
                out = None

        for b in batches:
            for row in b.itertuples(index=False):
                if not out:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(done)}.warc.gz"
                    out, z, raw, records = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(row.id, row.url, row.payload, row.refers_to)
                out.write(z.compress(data))
                raw, records = raw + len(data), records + 1
                if raw >= archive_bytes:
                    close()
        close()
        if done:
            yield pd.DataFrame({"archive": [f"{root}/{n}" for n, _ in done], "records": [r for _, r in done]})

    return rows.mapInPandas(run, "archive string, records long")


def normalise(archives: DataFrame, root: str, level: int = 6) -> DataFrame:
    """Normalise each file of the column ``archive`` into ``root``. One row per file: ``archive`` (the new one), ``index``, ``records``.

    A file that ends early or isn't made of records ends the job with an error that names it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        for b in batches:
            for uri in b["archive"]:
                source_store, path = open_store(uri)
                name = f"{base}/{attempt}-{path.rsplit('/', 1)[-1]}"
                try:
                    with source_store.open_input_stream(path, compression=None) as source, store.open_output_stream(name, compression=None) as target, store.open_output_stream(name + INDEX_SUFFIX, compression=None) as index:
                        n = normalise_stream(source, target, index, level)
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{uri}: {e}") from e
                new = f"{root}/{name.rsplit('/', 1)[-1]}"
                yield pd.DataFrame({"archive": [new], "index": [new + INDEX_SUFFIX], "records": [n]})

    return archives.select("archive").mapInPandas(run, "archive string, index string, records long")


RECORDS = "page_id string, uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True, id_type: str = "long") -> DataFrame:
    """One row per record, each read alone at the offset that the sidecar index gives. ``id_type`` is the type of the page ids.

    The length and digest of a response are those of the payload that was read; a digest other than
    the header's is an error. A revisit has no payload, its length and digest are its headers'.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, index in zip(b["archive"], b["index"], strict=True):
                store, path = open_store(uri)
                rows, held = [], 0
                with store.open_input_file(path) as archive, store.open_input_stream(open_store(index)[1], compression=None) as lines:
                    for entry in _json_lines(lines):
                        fields, block = read_record(archive, entry["offset"], entry["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        refers = fields.get("x-refers-to-page")
                        if fields["warc-type"] == "revisit":
                            size, payload = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1]), None
                        else:
                            size = len(payload)
                            if payload_digest(payload) != digest:
                                raise ValueError(f"{uri}: the payload at {entry['offset']} has another digest than its header says")
                        page = fields.get("x-page")
                        rows.append((page and unquote(page), fields.get("warc-target-uri"), fields["warc-type"], size, digest, refers and unquote(refers), payload if with_payload else None))
                        held += size if with_payload else 100
                        if held > 16_000_000 or len(rows) >= 10_000:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    read = archives.select("archive", "index").mapInPandas(run, RECORDS)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"], dtype=object)
    return out.astype({"payload_bytes": "Int64"})


def _json_lines(f: BinaryIO) -> Iterator[dict]:
    rest = b""
    while chunk := f.read(CHUNK):
        *lines, rest = (rest + chunk).split(b"\n")
        yield from map(json.loads, lines)
    if rest:
        raise ValueError("the index ends inside a line")


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as archives, normalise them, and return the table of :func:`normalise`.

    Ids are numbers or text. Null payloads count as empty, null ids stay null and are never referred to. Of rows with equal
    payloads, all with the least id are responses, the others revisit it. The whole-file streams are deleted once all are normalised.
    """
    spark: SparkSession = pages.sparkSession
    root = shared_dir(spark)
    whole = materialize(write_archives(with_revisits(pages, id_col, payload_col, min_bytes), f"{root}/whole", archive_bytes), "whole")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    normal = materialize(normalise(whole.repartition(n, "archive"), f"{root}/records"), "normal")
    remove(spark, f"{root}/whole")
    return normal
