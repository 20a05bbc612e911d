"""WARC archives: records written with an index, and read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, open_folder, read_table

#: Shorter payloads are always archived whole.
LEAST_SHARED = 100
#: Bytes after which a task begins another archive; bytes of unwanted records that one read may
#: take along; bytes of one read.
ROLL, GAP, SPAN = 64 << 20, 64 << 10, 8 << 20
#: Bytes of archives that a reading task takes, and the least for which it is worth another task.
TASK, SMALL_TASK = 64 << 20, 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def _header(lines: Iterable[tuple[str, str | None]]) -> bytes:
    kept = (f"{k}: " + re.sub(r"[\r\n]+", " ", v) for k, v in lines if v is not None)
    return "\r\n".join(kept).encode() + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    body = http + payload if refers_to is None else http
    head = _header(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Profile", None if refers_to is None else _PROFILE),
            ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(body))),
        ]
    )
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The record in one gzip member. The digest of a response is that of the payload it holds."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    own = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    whole = fields["WARC-Type"] == "response"
    return {
        "page_id": own("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if whole else None,
        "payload_bytes": len(payload) if whole else length,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"],
        "refers_to": own("WARC-Refers-To"),
    }


def with_roles(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), digest, and refers_to: the page whose payload is the same.

    Groups of equal payloads are counted on digests before anything is shuffled. Each join stands on
    two tables, so that Spark can split a payload that many pages share; the pages themselves are
    joined by their own id, which is even.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    keys = scratch.save(rows.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest"), "keys")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.save(groups.where("refers_to IS NOT NULL").select("digest", "refers_to"), "groups")
    again = keys.join(groups, "digest").where("page_id IS NULL OR page_id <> refers_to")
    again = scratch.save(again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(again, same, "left").drop("_id", "_digest")


def write(spark: SparkSession, pages: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive all rows of pages(page_id, url, html) in `folder` and return the index, a table there.

    Of pages with equal payloads of at least LEAST_SHARED bytes that with the smallest page_id is a
    response and the others are revisits of it; rows that repeat this smallest id are responses too.
    A null html is an empty payload, a null url has no header, and a null page_id is never referred
    to. A task that is run again writes archives under new names, and only those of the attempt that
    succeeded are in the index.
    """
    scratch = Scratch(spark)
    rows = with_roles(scratch, pages).select("page_id", "url", F.col("html").cast("binary"), "digest", "refers_to")

    def archive(batches: Iterator[pa.RecordBatch]):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        out, at, name = None, 0, ""
        for batch in batches:
            index = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ROLL:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, html, digest, refers_to, date)
                out.write(member)
                index.append((name, at, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(member)
            if index:
                columns = list(zip(*index))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    index = rows.mapInArrow(archive, INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Coalesce sorted (file, offset, length) into (file, start, end, records) of one read each."""
    held: list[tuple[int, int]] = []
    file, start, end = "", 0, 0
    for name, offset, length in rows:
        if held and (name != file or offset - end > GAP or offset + length - start > SPAN):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end, held


def read(index: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """The records that the rows of `index` select, parsed from the archives.

    The rows are dealt out by file and offset, so that every task reads its archives forward, in few
    large ranges, whatever part of the records is asked for. The tasks are as many as the bytes of
    the records call for, not those of the index, which is far smaller.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def fetch(batches):
        files, path = open_folder(folder)
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)))
            for name, start, end, members in ranges(rows):
                with files.open_input_file(f"{path}/{name}") as file:
                    file.seek(start)
                    data = file.read(end - start)
                found = [parse(data[o - start : o - start + n]) for o, n in members]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], types.get(c, pa.string())) for c in names], names=names)

    tasks = reading_tasks(index.agg(F.sum("length")).first()[0] or 0, index.sparkSession.sparkContext.defaultParallelism)
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(fetch, schema)


def reading_tasks(size: int, cores: int) -> int:
    """TASK bytes each; fewer bytes, but SMALL_TASK at least, where cores would stand idle otherwise."""
    return max(1, -(-size // TASK), min(cores, size // SMALL_TASK))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark).root}/warc"
    index = write(spark, read_table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
"""
