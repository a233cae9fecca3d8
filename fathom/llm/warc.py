"""WARC archives: a distributed writer that writes equal payloads once, and a sequential reader.

Each record is a gzip member of its own. The reader inflates a file chunk by chunk, frames each
record's block by its Content-Length, and checks the digests of block and payload; its memory is
bounded by one record.

Null payloads count as empty. Of records with equal payloads of at least ``LEAST`` bytes those
with the smallest page_id are responses, others revisit them (also rows that repeat that id are
responses); rows without page_id revisit the smallest id there is, and are responses where all ids
of the payload are null. A null or empty url is written as an empty target. Payloads are of any length;
a task holds one batch of rows, the reader one record. An empty table gives an empty one. Columns
besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

LEAST = 100
CHUNK = 1 << 18
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the RFC 4122 name space of URLs


def _record_id(page: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page} {digest} {url}')}>"


def _line(text: str) -> str:
    """Without line ends, which would end a header."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", text)


def write_record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response, or with ``refers_to`` a revisit that leaves the payload out, as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, url, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes | None:
        """The body after the HTTP headers; None for revisits, which hold none."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers["warc-type"] == "response" else None


class WarcError(ValueError):
    pass


def _inflate(source) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether a member ends after them)."""
    member, held = None, b""
    while True:
        held = held or source.read(CHUNK)
        if not held:
            if member is not None:
                raise WarcError("the file ends within a record")
            return
        member = member or zlib.decompressobj(31)
        out = member.decompress(held, CHUNK)
        held = member.unused_data if member.eof else member.unconsumed_tail
        ended = member.eof
        if ended:
            member = None
        yield out, ended


def read_records(source) -> Iterator[Record]:
    """All records of a file in order; raises ``WarcError`` where framing or a digest is wrong."""
    head = b""
    headers: dict[str, str] | None = None
    parts: list[bytes] = []
    missing = 0
    digest = hashlib.sha256()
    for data, ended in _inflate(source):
        if headers is None:
            head += data
            if b"\r\n\r\n" in head:
                top, _, data = head.partition(b"\r\n\r\n")
                version, *lines = top.decode("utf-8").split("\r\n")
                if not version.startswith("WARC/1."):
                    raise WarcError(f"not a record: {version[:40]!r}")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                missing, parts, digest, head = int(headers["content-length"]), [], hashlib.sha256(), b""
            else:
                data = b""
        if headers is not None and data:
            own, tail = data[:missing], data[missing:]
            parts.append(own)
            digest.update(own)
            missing -= len(own)
            head += tail  # the two line ends after the block
        if ended:
            if headers is None or missing or head != b"\r\n\r\n":
                raise WarcError("a record's block does not have the length it states")
            record = Record(headers, b"".join(parts))
            if headers.get("warc-block-digest", "sha256:" + digest.hexdigest()) != "sha256:" + digest.hexdigest():
                raise WarcError(f"wrong block digest in {headers.get('warc-record-id')}")
            payload = record.payload
            if payload is not None and headers.get("warc-payload-digest") != "sha256:" + hashlib.sha256(payload).hexdigest():
                raise WarcError(f"wrong payload digest in {headers.get('warc-record-id')}")
            yield record
            head, headers = b"", None


MANIFEST = "path string, n_records bigint, n_bytes bigint"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html`` as archives, one file a task; returns the written manifest.

    Payloads are compared by digest: the smallest id of each digest is found from digests alone and
    written, then joined to the pages; a payload that very many pages share is split in that join.
    """
    spark = pages.sparkSession
    scratch.limit_batches(spark, 500)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest")
    )
    first = (
        rows.where(F.octet_length("body") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    )
    first = scratch.materialize(first.select("digest", "first"), "payloads")
    rows = rows.join(first, "digest", "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.select(F.coalesce("page_id", F.lit(0)).alias("page"), F.col("page_id").isNull().alias("no_page"), "url", "body", "digest", F.coalesce("refers_to", F.lit(0)).alias("to"), F.col("refers_to").isNotNull().alias("revisit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        with store.open_output_stream(path) as sink:
            for x in batches:
                for page, no_page, url, body, digest, to, revisit in x.itertuples(index=False, name=None):
                    raw = write_record(None if no_page else int(page), url, body.encode(), digest, int(to) if revisit else None)
                    sink.write(raw)
                    n, size = n + 1, size + len(raw)
        yield pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size]})

    rows.mapInPandas(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record, read and verified by the sequential reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None else int(x)
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for x in batches:
            for path in x["path"]:
                rows, held = [], 0
                with store.open_input_stream(path) as source:
                    for r in read_records(source):
                        h = r.headers
                        row = (number(h.get("x-page-id")), h["warc-target-uri"], int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], number(h.get("x-refers-to-page-id")))
                        rows.append((*row, r.payload) if with_payload else row)
                        held += len(r.block) if with_payload else 0
                        if len(rows) == 5_000 or held > 1 << 24:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    files = manifest.where("n_records > 0").select("path")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInPandas(run, RECORDS + (", payload binary" if with_payload else ""))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    folder = scratch.new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder).drop("url")


# The digest of the round trip in DuckDB.
ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {LEAST} GROUP BY 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d LEFT JOIN f USING (digest)
"""
