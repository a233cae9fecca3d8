"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. The ledger is a Parquet table with one row
for each pair of blob and rule version that has been scanned, found spans or none, in folders by the
beginning of the blob's address. A scan asks the ledger by addresses alone which blobs lack which rule
versions, takes one text of each of these blobs, runs only the rules it lacks, appends what it found,
and joins the ledger's findings back to every path that has the blob.

Null texts count as empty. Repeated rows share a blob and get the same findings. Texts are of any
length. An empty table gives an empty one, and adds nothing to the ledger. Offsets are code points of
the whole text, end exclusive. Columns besides the key and the text are ignored, so their names
cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import scratch

# The patterns of the three base rules.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    either_case: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


RULES = (Rule("assign", ASSIGN, 6, 2, True), Rule("access", ACCESS, 20), Rule("hex", HEX, 24))
LEDGER = "blob string, rule string, spans array<struct<s:bigint,e:bigint>>"
#: Characters of the address that name a folder of the ledger; 256 folders.
SHARD = 2
#: Addresses of unseen blobs that may be broadcast (80 bytes each), so that the texts stay where they are.
BROADCAST_BLOBS = 500_000


def find(rule: Rule, text: str, compiled: re.Pattern | None = None) -> list[tuple[int, int]]:
    found = (compiled or rule.compiled()).finditer(text)
    g, least = rule.group, rule.least
    return [m.span() for m in found if m.end(g) - m.start(g) >= least]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs``: blob, body, missing (rule keys to run). Returns rows of the ledger."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {r.key: (r, r.compiled()) for r in rules}
        for x in batches:
            rows = [
                (blob, key, [{"s": s, "e": e} for s, e in find(known[key][0], body, known[key][1])])
                for blob, body, missing in zip(x["blob"], x["body"], x["missing"], strict=True)
                for key in missing
            ]
            yield pd.DataFrame(rows, columns=["blob", "rule", "spans"])

    return blobs.select("blob", "body", "missing").mapInPandas(run, LEDGER)


def addressed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("body"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER + ", shard string").parquet(ledger)


def _shard(blob: str = "blob"):
    return F.concat(F.lit("s"), F.substring(blob, 1, SHARD))


def unseen(paths: DataFrame, ledger: str, every) -> DataFrame:
    """blob, missing, body: one text of each blob for which the ledger lacks some rule version."""
    spark = paths.sparkSession
    if not _exists(spark, ledger):  # all are new: a blob's texts meet in one place
        return paths.groupBy("blob").agg(F.first("body").alias("body")).withColumn("missing", every)
    # addresses only: the ledger is read in the folders that these are in
    held = scratch.materialize(paths.select("blob", _shard().alias("shard")).distinct(), "blobs")
    shards = [r.shard for r in held.select("shard").distinct().collect()]
    seen = read_ledger(spark, ledger).where(F.col("shard").isin(shards)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    lacking = scratch.materialize(held.join(seen, "blob", "left").select("blob", missing.alias("missing")).where("size(missing) > 0"), "unseen")
    few = lacking.count() <= BROADCAST_BLOBS
    texts = paths.select("blob", "body").join(F.broadcast(lacking) if few else lacking, "blob")
    return texts.groupBy("blob").agg(F.first("body").alias("body"), F.first("missing").alias("missing"))


def scan(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``ledger`` (a path) lacks, append it there, and return ``(path, blob, <kind>...)``.

    Each kind is a column of spans, sorted as found. The ledger may not exist yet.
    """
    spark = docs.sparkSession
    scratch.limit_batches(spark)
    paths = addressed(docs, key, text)
    blobs = unseen(paths, ledger, F.array(*[F.lit(r.key) for r in rules]))
    new = scratch.materialize(scan_blobs(blobs, rules), "scanned")
    new.withColumn("shard", _shard()).repartition("shard").write.mode("append").partitionBy("shard").parquet(ledger)
    # one row a blob, written, so that a blob with very many paths can be split in the join
    rows = read_ledger(spark, ledger).where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    found = rows.groupBy("blob").agg(
        *[F.first(F.when(F.col("rule") == r.key, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules]
    )
    found = found.where(" or ".join(f"size({r.kind}) > 0" for r in rules))
    found = scratch.materialize(found, "findings")
    out = paths.select("path", "blob").join(found, "blob", "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return out.select("path", "blob", *[F.coalesce(r.kind, none).alias(r.kind) for r in rules])


def spans_text(rules: tuple[Rule, ...] = RULES):
    """``kind:start:end`` of all columns of ``scan``, by start, then by the order of the rules."""

    def ranked(n: int, kind: str):
        return F.transform(kind, lambda x: F.struct(x.s.alias("s"), F.lit(n).alias("n"), F.lit(kind).alias("k"), x.e.alias("e")))

    spans = F.array_sort(F.concat(*[ranked(n, r.kind) for n, r in enumerate(rules)]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))), ",")


def secret_report(docs: DataFrame, ledger: str) -> DataFrame:
    """The digest of ``scan``: counts, the hash of the base spans, and all spans as text."""
    x = scan(docs, ledger).withColumn("spans", spans_text())
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return x.select(
        F.col("path").alias("doc_id"), *[count(r.kind) for r in RULES], F.sha2("spans", 256).alias("base_sha256"), "spans", F.col("blob").alias("blob_sha256")
    )


# The same in DuckDB: matches are set off by two characters that no text may hold, and their places are summed up.
def _spans_sql(n: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    if rule.either_case:  # ASCII letters only, so spelled out
        head, _, tail = pattern.partition(")")
        pattern = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + ")" + tail
    parts = rf"string_split(regexp_replace(t, '{pattern}', chr(57344) || '\0' || chr(57345), 'g'), chr(57344))"
    return rf"""SELECT doc_id, blob, {n} AS n, '{rule.kind}' AS kind, s, s + length(found) AS e FROM (SELECT *, list_sum(list_transform(parts[1:i], lambda x: length(replace(x, chr(57345), ''))))::BIGINT AS s, string_split(parts[i + 1], chr(57345))[1] AS found
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, row, blob, {parts} AS parts FROM d))) WHERE length(regexp_extract(found, '{pattern}', {rule.group})) >= {rule.least}"""


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    found = " UNION ALL ".join(_spans_sql(n, r).replace("SELECT doc_id, blob, ", "SELECT row, ", 1) for n, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob FROM documents),
f AS ({found}),
g AS (SELECT row, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) AS spans FROM f GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in rules)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, blob AS blob_sha256 FROM d LEFT JOIN g USING (row)"""
