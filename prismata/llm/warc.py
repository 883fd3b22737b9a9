"""WARC archives: a writer of one gzip member per record, and a sequential reader that verifies what it reads.

Writer. A page becomes a response record (HTTP head and payload) or, where an equal payload of ``least`` bytes or
more has a smaller page_id, a revisit record that names it and carries the head alone. The page that is kept per
payload is a map-side combined minimum per digest, joined back by digest; adaptive execution can split that join, so a
payload in a third of all pages is not gathered. Each task streams its records into one archive under a name of its
own and gives the name back; a repeated task writes another file, and only the names that came back are read.

Reader. An archive is read front to back in blocks: incremental decompression member by member, the WARC head up to
its blank line, then exactly Content-Length bytes of block, then the two closing line ends. Block and payload digests
are recomputed while the bytes pass; a difference, a short block or a cut-off member is an error. No more than one
block of input and one record is held.

Archives go to the shared folder through a file-system API that takes its URI, so any store that Arrow opens works.

Defined results: a null page is an empty payload; empty and short payloads are all response records; rows without a
page_id keep a null page_id, are always response and are never referred to; rows that repeat a page_id and payload
are each written, the repeats as revisits of that id only if another row's id is smaller; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.shared import materialize, new_path

LEAST, BLOCK, MAX_HEAD = 100, 1 << 16, 1 << 20
_EOL = b"\r\n"


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1" + _EOL + b"".join(f"{k}: {v}".encode() + _EOL for k, v in fields) + _EOL


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member that holds one record."""
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK" + _EOL + b"Content-Type: text/html; charset=utf-8" + _EOL + f"Content-Length: {len(payload)}".encode() + _EOL + _EOL
    block = http if refers_to is not None else http + payload
    uri = "".join((url or "").split())
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", uri)] if uri else []
    fields += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(_head(fields) + block + _EOL + _EOL) + z.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        out, name, n = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, html, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                if out is None:
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/{name}")
                out.write(record(page_id, url, (html or "").encode(), refers))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], names=["archive", "n_records"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """``(archive, n_records)``: the archives of ``pages(page_id, url, html)``, written once."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.when((F.octet_length("html") >= least) & F.col("page_id").isNotNull(), F.sha2("html", 256)))
    kept = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = rows.join(kept, "digest", "left").select("page_id", "url", "html", F.when(F.col("kept") < F.col("page_id"), F.col("kept")).alias("refers_to"))
    return materialize(told.mapInArrow(_write(folder), "archive string, n_records long"), "archives")


class Broken(ValueError):
    """An archive that does not hold what it says."""


def _members(stream) -> Iterator[Iterator[bytes]]:
    """Per gzip member an iterator of its decompressed pieces."""
    rest = stream.read(BLOCK)
    while rest:
        z = zlib.decompressobj(31)

        def pieces(z=z) -> Iterator[bytes]:
            nonlocal rest
            while not z.eof:
                if not rest:
                    raise Broken("cut-off gzip member")
                piece = z.decompress(rest, BLOCK)
                rest = z.unconsumed_tail or z.unused_data
                if piece:
                    yield piece
                if not rest:
                    rest = stream.read(BLOCK)

        yield pieces()


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}


def read_records(stream) -> Iterator[dict]:
    """Records of an archive, front to back, each verified."""
    for pieces in _members(stream):
        got = b""
        while b"\r\n\r\n" not in got:
            if (piece := next(pieces, None)) is None or len(got) > MAX_HEAD:
                raise Broken("no end of the record head")
            got += piece
        head, _, got = got.partition(b"\r\n\r\n")
        version, *lines = head.split(_EOL)
        if not version.startswith(b"WARC/"):
            raise Broken("not a WARC record")
        h = _fields(lines)
        size = int(h["content-length"])
        block, parts, have = hashlib.sha256(), [], 0
        while True:  # the block, framed by its length, then two line ends
            part = got[: size - have]
            block.update(part)
            parts.append(part)
            have += len(part)
            got = got[len(part) :]
            if have == size:
                break
            if not got and (got := next(pieces, b"")) == b"":
                raise Broken("short block")
        closing = got + b"".join(pieces)
        if closing != b"\r\n\r\n":
            raise Broken("bytes after the block")
        if h["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise Broken("block digest differs")
        http, _, payload = b"".join(parts).partition(b"\r\n\r\n")
        of_http = _fields(http.split(_EOL)[1:])
        revisit = h["warc-type"] == "revisit"
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and (len(payload) != int(of_http["content-length"]) or hashlib.sha256(payload).hexdigest() != digest):
            raise Broken("payload digest differs")

        def ident(value: str | None) -> int | None:
            name = (value or "").removeprefix("<urn:page:").removesuffix(">")
            return int(name) if name else None

        yield {"page_id": ident(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": int(of_http["content-length"]), "payload_digest": digest, "record_type": h["warc-type"], "refers_to": ident(h.get("warc-refers-to")), "payload": None if revisit else payload}


_COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _read(payloads: bool):
    names = [c for c in _COLUMNS if payloads or c != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, n in zip(batch.column("archive").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                where, path = _open(archive)
                rows, seen, held = [], 0, 0
                with where.open_input_stream(path) as stream:
                    for r in read_records(stream):
                        rows.append(r)
                        seen += 1
                        held += len(r["payload"] or b"") if payloads else 100
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], _COLUMNS[c]) for c in names], names=names)
                            rows, held = [], 0
                if seen != n:
                    raise Broken(f"{archive}: {seen} of {n} records")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], _COLUMNS[c]) for c in names], names=names)

    return run


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of ``archives(archive, n_records)``; ``payloads`` adds the bytes of response records."""
    kinds = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items() if payloads or c != "payload")
    spread = archives.repartition(archives.sparkSession.sparkContext.defaultParallelism, "archive")
    return spread.mapInArrow(_read(payloads), schema)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc"), least))
