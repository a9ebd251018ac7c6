"""WARC archives that store payload bytes once.

Writing: of records with equal payloads of at least ``least`` bytes, one (that
with the largest page id) is a ``response`` with the bytes, the others are
``revisit`` records that name it. Archives are gzip files with a member for each
record, named by partition; a task writes under a name of its own and renames at
the end.

Reading: every response's payload is checked against its digest. Exact record
headers and payloads are kept as two tables, payloads once for each digest, and
records are put together again by joining them: a revisit with the response that
it names, and this with its payload.

Copies are told by SHA-256 and length. Groups come from a map-side aggregate, and
only groups with copies are joined back, so a payload that a third of all pages
share goes to no single task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.token_files import _store
from noteloom.llm.word_ids import batches_by_size
from noteloom.runtime import Scratch, numbered, qualified, ship

LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = re.compile(rb"WARC-Record-ID: <urn:page:(-?\d*):(\d+)>")


def _head(lines: list[str]) -> bytes:
    return "\r\n".join([*lines, "", ""]).encode()


def record_bytes(page_id, uid: int, url, payload: bytes, digests: tuple[str, str], refers, date: str) -> bytes:
    """One WARC record. digests: SHA-1 and SHA-256 of the payload. refers: (page_id, uid) of the response that a revisit stands for, else None."""
    name = lambda p, u: f"<urn:page:{'' if p is None else p}:{u}>"
    http = _head(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"])
    block = http if refers else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name(page_id, uid)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines += [f"WARC-Payload-Digest: sha1:{digests[0]}", f"Payload-SHA-256: {digests[1]}"]
    if refers:
        lines += [f"WARC-Refers-To: {name(*refers)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _head(lines) + block + b"\r\n\r\n"


def _write_part(folder: str, date: str, level: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name, records = f"{at}/part-{part:05d}.warc.gz", 0
        own = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns))
                for uid, page_id, url, html, sha1, sha256, keep_uid, keep_id in rows:
                    refers = (keep_id, keep_uid) if keep_uid is not None and keep_uid != uid else None
                    out.write(gzip.compress(record_bytes(page_id, uid, url, (html or "").encode(), (sha1, sha256), refers, date), level, mtime=0))
                    records += 1
        store.move(own, name) if records else store.delete_file(own)
        if records:
            yield pa.RecordBatch.from_pydict({"file": [name.rpartition("/")[2]], "records": [records]})

    return run


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> list[str]:
    """Write a record for each row of ``pages``; returns the files' names, one for each partition that had rows.

    Null html is an empty payload, a null url leaves out the target, a null page
    id sorts below all others; rows may repeat. Every page is one record, with the
    whole html, however long. An empty table writes no file. Columns other than
    those named aren't read, whatever their names.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = qualified(spark, folder)
    scratch = Scratch(spark, "warc")
    pages = numbered(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), scratch)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.withColumn("bytes", F.octet_length(payload).cast("long"))
    digests = scratch.write(pages.filter(F.col("bytes") >= least).select("uid", "page_id", "bytes", F.sha2(payload, 256).alias("strong")), "digests")
    best = F.max(F.struct("page_id", (-F.col("uid")).alias("back"))).alias("best")
    copies = digests.groupBy("strong", "bytes").agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = scratch.write(copies.select("strong", "bytes", F.col("best.page_id").alias("keep_id"), (-F.col("best.back")).alias("keep_uid")), "copies")
    chosen = scratch.write(digests.join(copies, ["strong", "bytes"]).filter("uid <> keep_uid").select("uid", "keep_uid", "keep_id"), "chosen")
    scratch.drop("digests", "copies")
    rows = pages.join(chosen, "uid", "left").select("uid", "page_id", "url", "html", F.sha1(payload), F.sha2(payload, 256), "keep_uid", "keep_id")
    return sorted(r.file for r in rows.mapInArrow(_write_part(folder, date, level), "file string, records long").collect())


def parse_records(stream):
    """(header bytes, {name: value}, block) for each record of a stream of decompressed bytes."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head[1:])}
        yield b"".join(head), fields, stream.read(int(fields[b"content-length"]))


_RECORDS = "page_id long, uid long, record_type string, header binary, http binary, payload_digest string, payload_sha256 string, refers_to long, refers_uid long, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, folder: str, files: list[str], with_payload: bool = True) -> DataFrame:
    """The records of the archives: exact headers, digest and, for responses, length and payload, checked against the digest."""
    ship(spark)
    folder = qualified(spark, folder)
    schema = _RECORDS if with_payload else _RECORDS.removesuffix(", payload binary")
    if not files:
        return spark.createDataFrame([], schema)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def rows(name: str):
        store, at = _store(folder)
        with store.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
            for header, fields, block in parse_records(stream):
                own = RECORD.search(header)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                kind = fields[b"warc-type"].decode()
                refers = RECORD.search(b"WARC-Record-ID: " + fields.get(b"warc-refers-to", b""))
                strong = fields[b"payload-sha-256"].decode()
                if kind == "response" and (hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest()) != (digest, strong):
                    raise ValueError(f"{name}: a payload doesn't match its digest {digest}")
                number = lambda m, k: int(m[k]) if m and m[k] else None
                body = (len(payload), payload) if kind == "response" else (None, None)
                yield (number(own, 1), number(own, 2), kind, header, http + b"\r\n\r\n", digest, strong, number(refers, 1), number(refers, 2), *body)[: len(arrow)]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for group in batches_by_size(rows(files[i]), lambda r: 300 + (r[9] or 0)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), arrow)], schema=arrow)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def payload_store(records: DataFrame, once_from: int | None = None) -> DataFrame:
    """Payloads by strong digest, each once: payload_sha256, payload_bytes and payload.

    once_from: the caller knows that payloads of at least so many bytes have one
    response each, as in archives that :func:`write_warc` wrote, so that only
    shorter ones need a shuffle.
    """
    found = records.filter("record_type = 'response'").select("payload_sha256", "payload_bytes", "payload")
    if once_from is None:
        return found.dropDuplicates(["payload_sha256"])
    return found.filter(F.col("payload_bytes") >= once_from).unionByName(found.filter(F.col("payload_bytes") < once_from).dropDuplicates(["payload_sha256"]))


def record_headers(records: DataFrame) -> DataFrame:
    """Exact headers of all records, without payloads."""
    return records.select("page_id", "uid", "record_type", "header", "http", "payload_digest", "payload_sha256", "refers_to", "refers_uid")


def original_records(headers: DataFrame, store: DataFrame) -> DataFrame:
    """Headers with the payloads they stand for: a revisit's is that of the response it names.

    store: payload_sha256 and whatever of the payload is wanted. A record whose
    payload isn't there has nulls.
    """
    named = headers.filter("record_type = 'response'").select(F.col("uid").alias("__named"), F.col("payload_sha256").alias("__strong"))
    joined = headers.join(named, F.coalesce("refers_uid", "uid") == F.col("__named"), "left")
    kept = store.withColumnRenamed("payload_sha256", "__kept")
    return joined.join(kept, F.col("__strong") == F.col("__kept"), "left").drop("__named", "__strong", "__kept")


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives, read them back into headers and a payload store, and put every record together again.

    Returns page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to.
    Length and digest are those of the bytes in the store, for revisits too; a
    record whose header says otherwise, or that has no payload, is an error. Nulls,
    copies and empty tables: as :func:`write_warc` says.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archive")
    files = write_warc(pages, scratch.path + "/warc", least=least)
    headers = scratch.write(record_headers(read_warc(spark, scratch.path + "/warc", files, with_payload=False)), "headers")
    store = scratch.write(payload_store(read_warc(spark, scratch.path + "/warc", files), once_from=least), "store")
    kept = store.select("payload_sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("strong"))
    whole = original_records(headers, kept)
    wrong = F.raise_error(F.concat(F.lit("not the payload that the header of this page names: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string")
    same = F.coalesce((F.col("sha1") == F.col("payload_digest")) & (F.col("strong") == F.col("payload_sha256")), F.lit(False))
    return whole.select("page_id", "payload_bytes", F.when(same, F.col("sha1")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to")
