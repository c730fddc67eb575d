"""WARC archives: write with an index, read back by coalesced byte ranges of the index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.storage import scratch_path

INDEX = "page_id {id}, path string, offset bigint, length bigint, url string, digest string"
RECORD = "page_id {id}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id}, url string, payload string"
#: Written when an archive of a task has grown so far; a task with more rows starts another file.
ARCHIVE_BYTES = 256 << 20


def _open_out(path: str):
    """Stream to a file of any store that Arrow knows (file, hdfs, s3, gs ...)."""
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(name, compression=None)


def _clean(value: str) -> str:
    return "".join(c for c in value if c >= " ")


def record_bytes(page_id, url: str | None, payload: bytes, sha1: str, refers_to, revisit: bool, level: int) -> bytes:
    """One gzip member holding one WARC/1.1 record; a revisit keeps the headers and drops the payload."""
    body = b"" if revisit else payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode()
    return gzip.compress(head + body + b"\r\n\r\n", level, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return fields, rest[:n]


def revisit_plan(pages: DataFrame, least_bytes: int, salts: int = 32) -> DataFrame:
    """pages(page_id, url, html) plus sha1, refers_to: the largest page_id of equal payloads, where it is another.

    Payloads under least_bytes refer to none. Equality is that of SHA-1, length and XXH64 together.
    Winners are first found per salt and looked up per salt, so a hot payload is not one task's, and
    only payloads that occur more than once are looked up.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumns(
        {"sha1": F.sha1(payload.cast("binary")), "size": F.octet_length(payload), "h": F.xxhash64(payload)}
    )
    key = ["sha1", "size", "h"]
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt")
    light = rows.where(F.col("size") >= least_bytes).select("page_id", *key, salt)
    part = light.groupBy(*key, "salt").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    winner = part.groupBy(*key).agg(F.max("top").alias("refers_to"), F.sum("n").alias("n"), F.collect_list("salt").alias("salt")).where("n > 1")
    winner = winner.select(*key, "refers_to", F.explode("salt").alias("salt"))
    told = light.join(winner, [*key, "salt"]).where("page_id <> refers_to").select("page_id", "sha1", "refers_to")
    # a page_id that occurs twice is told apart by its digest
    return rows.select("page_id", "url", "html", "sha1").join(told.distinct(), ["page_id", "sha1"], "left")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, level: int = 6) -> DataFrame:
    """Write pages(page_id, url, html) to gzip-per-record WARC files in folder; returns the index.

    The index has one row per record: page_id, path, offset, length, url, digest. Each task writes
    files of its own under a fresh name and reports only what it has written, so a task that is run
    again after a lost executor leaves at most an unreferenced file. The files are written when the
    index is; keep the index (as write_and_read does) rather than evaluating it twice.
    """
    planned = revisit_plan(pages, least_bytes).select("page_id", "url", "html", "sha1", "refers_to")
    kind = pages.schema["page_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        for b in batches:
            index: list[tuple] = []
            for row in b.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = _open_out(path)
                revisit = row["refers_to"] is not None
                data = record_bytes(row["page_id"], row["url"], row["html"].encode(), row["sha1"], row["refers_to"], revisit, level)
                out.write(data)
                index.append((row["page_id"], path, at, len(data), row["url"], row["sha1"]))
                at += len(data)
            columns = list(zip(*index)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
                names=["page_id", "path", "offset", "length", "url", "digest"],
            )
        if out is not None:
            out.close()

    return planned.mapInArrow(write, INDEX.format(id=kind))


def coalesced_ranges(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Sorted byte ranges that cover the selected records: path, start, stop, parts array<(offset, length)>.

    Records less than `gap` bytes apart are read together; a range is also cut at multiples of
    `most`, so it holds about that much however many records lie side by side.
    """
    order = Window.partitionBy("path").orderBy("offset")
    apart = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order)
    block = F.floor(F.col("offset") / most)
    starts = F.coalesce((apart > gap) | (block != F.lag(block).over(order)), F.lit(True))
    islands = index.select("path", "offset", "length").withColumn("new", starts.cast("int")).withColumn("run", F.sum("new").over(order))
    return islands.groupBy("path", "run").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"),
    ).drop("run")


def read_archives(index: DataFrame, kind: str = "bigint", **options) -> DataFrame:
    """Records of an index or of any selection of its rows, read by coalesced ranges and parsed.

    page_id, payload_bytes and payload_digest (of the full payload), record_type, refers_to, url and
    payload (null for revisits). The digest of each response is checked against its header.
    """
    ranges = coalesced_ranges(index, **options)
    # a number, so that adaptive execution does not put the few, but heavy, rows into one task
    ranges = ranges.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened = None, None
        for b in batches:
            for r in sorted(b.to_pylist(), key=lambda r: (r["path"], r["start"])):
                if r["path"] != at:
                    fs, name = pafs.FileSystem.from_uri(r["path"])
                    at, opened = r["path"], fs.open_input_file(name)
                data = io.BytesIO(opened.read_at(r["stop"] - r["start"], r["start"])).getbuffer()
                rows = []
                for p in r["parts"]:
                    begin = p["offset"] - r["start"]
                    head, body = parse_record(bytes(data[begin : begin + p["length"]]))
                    sha1 = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    full = head["WARC-Type"] == "response"
                    if full and hashlib.sha1(body).hexdigest() != sha1:
                        raise ValueError(f"digest mismatch in {at} at {p['offset']}")
                    whole = lambda name: head[name] if kind == "string" else int(head[name])
                    rows.append((
                        whole("X-Page-Id") if head["X-Page-Id"] else None, int(head["X-Payload-Length"]), sha1, head["WARC-Type"],
                        whole("X-Refers-To-Page") if "X-Refers-To-Page" in head else None, head["WARC-Target-URI"], body.decode() if full else None,
                    ))
                ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
                types = (ids, pa.int64(), pa.string(), pa.string(), ids, pa.string(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return ranges.mapInArrow(read, RECORD.format(id=kind))


def write_and_read(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, **options) -> DataFrame:
    """Write pages(page_id, url, html, ...) as WARC and read every record back through the index.

    Of equal payloads of at least least_bytes bytes, the one with the largest page_id is the
    response and the others revisit it; smaller ones are all responses. A null html is an empty
    payload; a null url an empty one; a repeated row makes records of its own; a page with a null
    page_id is a response. Extra columns are ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = folder or scratch_path(spark, "warc")
    index_path = f"{folder}/index"
    write_archives(pages, f"{folder}/data", least_bytes).write.parquet(index_path)
    return read_archives(spark.read.parquet(index_path), kind, **options)
