"""Collections: tables of documents, chunks, vectors and postings under one folder, as a log of segments.

A write adds one segment, a folder with the new rows of each table and the ids it touched, however large the
collection is; then a new pointer, numbered one up, names the segments in order. Documents that older segments hold and that the
write replaces or removes are listed in the segment as ``gone``; readers leave them out of all older segments. When
``FAN`` segments have come after the last one that is much larger than they are, they are merged into one, so that the work of merging
grows with the logarithm of the size.

Readers take the newest pointer, so they see all of a write or nothing of it. A writer that finds a newer pointer
than it began with puts its segment behind the newer ones, if these touched other documents; if they touched the same, it fails as
overtaken. What the last two pointers name is kept, so that frames already read stay readable through
the next write; folders that only older ones named are removed. A folder of a writer that died stays until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import lexical
from fathom.sources import workspace

PARENTS = "parent_id string, doc_id string, filename string, content string, page_start int, page_end int, metadata map<string,string>"
CHILDREN = "chunk_id string, parent_id string, doc_id string, filename string, content string, page_number int, contextualized_content string, embedding array<double>"
#: A packed index of words (see ``lexical``). Files are sorted by ``shard``, a number by the term, so that searches skip most of them.
POSTINGS = "part string, field string, term string, docs array<int>, tf array<int>, keys array<string>, owners array<string>, dl array<int>, shard int"
REGISTRY = "doc_id string, filename string, pdf_path string, chunks bigint, inserted_at timestamp, custom_metadata map<string,string>"
CLUSTERS = "key string, doc_id string, original_uuid string, original_index bigint, chunk_id string, content string, page_start int, page_end int, token_count double, page_info string, contextualized_content string, text_to_embed string, embedding array<double>"
TABLES = {"parents": PARENTS, "children": CHILDREN, "postings": POSTINGS, "registry": REGISTRY, "clusters": CLUSTERS, "cluster_postings": POSTINGS}
#: Tables whose rows stand for many documents; these are named in ``owners`` of the rows without a term.
PACKED = {"postings", "cluster_postings"}
#: What files are sorted by, where it is not the document.
ORDER = {"postings": ["shard"], "cluster_postings": ["shard"]}
FAN, KEPT, TRIES = 8, 2, 20
#: Tables from up to so many bytes (Spark's estimate) are gathered to few files.
SMALL = 32 << 20


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id", ids: DataFrame | None = None) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key neither it nor ``ids`` has."""
    gone = (new if ids is None else ids).select(key).distinct()
    return old.join(gone, key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti").select(*rows.columns)


class Overtaken(RuntimeError):
    """Another writer touched the same documents meanwhile; read again and repeat."""


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name.lower()}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- pointers ---

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _last(self) -> int:
        """The highest number that a pointer has, readable or not."""
        return max((int(n.split("-")[1]) for n in self._names(self.path) if n.startswith("pointer-")), default=0)

    def _newest(self) -> tuple[int, list[dict]]:
        """The number of the newest pointer that can be read, and its segments, oldest first; (0, []) without one."""
        numbers = sorted((int(n.split("-")[1]) for n in self._names(self.path) if n.startswith("pointer-")), reverse=True)
        for n in numbers:
            try:
                return n, self._read_pointer(n)
            except ValueError:  # cut short by a writer that died
                continue
        return 0, []

    def _read_pointer(self, n: int) -> list[dict]:
        source = self._fs.open(self._path(self._pointer(n)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _pointer(self, n: int) -> str:
        return f"{self.path}/pointer-{n:012d}"

    def _point(self, n: int, segments: list[dict]) -> None:
        if self._fs.exists(self._path(self._pointer(n))):
            raise Overtaken(self.path)
        fresh = self._path(f"{self.path}/next-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        # a name that is taken is never overwritten by a rename
        if not self._fs.rename(fresh, self._path(self._pointer(n))):
            self._fs.delete(fresh, False)
            raise Overtaken(self.path)

    def _commit(self, change: Callable[[list[dict]], list[dict]]) -> None:
        """``change`` makes the new list of segments of the newest one, and may refuse; it is asked again if another pointer comes first."""
        for _ in range(TRIES):
            now, last = self._newest()[1], self._last()
            made = change(now)
            try:
                self._point(last + 1, made)
            except Overtaken:  # another writer was quicker
                continue
            self._clean(last + 1)
            return
        raise Overtaken(self.path)

    def _named(self, numbers) -> set[str]:
        """The folders that these pointers name; those that are gone or cannot be read name none."""
        out = set()
        for k in numbers:
            try:
                out |= {s["id"] for s in self._read_pointer(k)} if self._fs.exists(self._path(self._pointer(k))) else set()
            except ValueError:
                continue
        return out

    def _clean(self, n: int) -> None:
        """Remove pointers before the last ``KEPT``, and folders that they alone named."""
        old = [k for k in range(max(1, n - KEPT - 8), n - KEPT + 1) if self._fs.exists(self._path(self._pointer(k)))]
        for name in self._named(old) - self._named(range(n - KEPT + 1, n + 1)):
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        for k in old:
            self._fs.delete(self._path(self._pointer(k)), False)

    def vacuum(self, hours: float = 24.0) -> int:
        """Remove folders older than this that no pointer names (of writers that died); returns how many."""
        import time

        last = self._last()
        named = self._named(range(max(1, last - KEPT - 8), last + 1))
        least = (time.time() - 3600 * hours) * 1000
        where = self._path(self.path)
        found = [s.getPath() for s in self._fs.listStatus(where) if s.getModificationTime() <= least] if self._fs.exists(where) else []
        found = [p for p in found if p.getName().startswith(("segment-", "next-")) and p.getName() not in named]
        for p in found:
            self._fs.delete(p, True)
        return len(found)

    # --- tables ---

    def _gone(self, segments: list[dict]) -> DataFrame | None:
        """doc_id and the number of the segment before which it does not count; None without any."""
        some = [(n, s) for n, s in enumerate(segments) if s["gone"] and n]
        if not some:
            return None
        rows = self.spark.read.schema("doc_id string, segment string").parquet(*[f"{self.path}/{s['id']}/gone" for _, s in some])
        return rows.groupBy("doc_id").agg(F.max(self._number(segments)).alias("before"))

    @staticmethod
    def _number(segments: list[dict]):
        """The place of a row's segment in order."""
        return F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate(segments) for x in (s["id"], n)]), F.col("segment"))

    def read(self, table: str) -> DataFrame:
        """The rows that count; an empty table before anything was written."""
        return self._live(table, self._newest()[1])

    def _rows(self, table: str, segments: list[dict]) -> DataFrame:
        """All rows of the segments, and which segment each is of."""
        having, schema = [f"{self.path}/{s['id']}/{table}" for s in segments if table in s["tables"]], f"{TABLES[table]}, segment string"
        return self.spark.read.schema(schema).parquet(*having) if having else self.spark.createDataFrame([], schema)

    def _live(self, table: str, segments: list[dict], count: int | None = None) -> DataFrame:
        """Of the segments from ``count`` on (of all if None), as the later ones leave them."""
        rows = self._rows(table, segments[count or 0 :])
        gone = self._gone(segments)
        if gone is None:
            return rows.drop("segment")
        rows = rows.withColumn("number", self._number(segments))
        if table not in PACKED:
            return rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["number"] < gone["before"]), "left_anti").drop("segment", "number")
        # which places of a part still count
        rows = self._places(rows, gone).with_live(rows.drop("number"))
        kept = F.filter(F.arrays_zip("docs", "tf"), lambda x: F.get(F.col("live"), x.docs))
        changed = F.col("live").isNotNull() & F.col("term").isNotNull()
        rows = rows.withColumn("kept", F.when(changed, kept))
        rows = rows.withColumns({"docs": F.when(changed, F.col("kept.docs")).otherwise(F.col("docs")), "tf": F.when(changed, F.col("kept.tf")).otherwise(F.col("tf"))})
        lengths = F.when(F.col("live").isNotNull() & F.col("term").isNull(), F.zip_with("dl", "live", lambda n, on: F.when(on, n).otherwise(F.lit(0)))).otherwise(F.col("dl"))
        return rows.withColumn("dl", lengths).where(F.col("term").isNull() | (F.size("docs") > 0)).drop("segment", "live", "kept")

    @staticmethod
    def _places(rows: DataFrame, gone: DataFrame) -> lexical.Index:
        """The index of ``rows`` (with the number of their segment), and which places of its parts still count; names of documents are not in it."""
        own = rows.where((F.col("shard") == lexical.DOCUMENTS) & F.col("term").isNull()).select("part", "number", "owners").dropDuplicates(["part"])
        places = own.select("part", "number", F.posexplode("owners").alias("place", "doc_id")).join(gone, "doc_id", "left")
        on = F.coalesce(F.col("number") >= F.col("before"), F.lit(True))
        live = places.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", on.alias("on")))).alias("p")).select("part", F.col("p.on").alias("live"))
        live = workspace.written(live.where(F.exists("live", lambda x: ~x)), "live")
        return lexical.Index(rows.drop("segment", "number"), "", live=F.broadcast(live) if live.count() <= lexical.BROADCAST_PARTS else live)

    def index(self, table: str, key: str) -> lexical.Index:
        """A packed table as an index. Its rows stay as they were written; what does not count any more is left out of what searches take."""
        segments = self._newest()[1]
        gone = self._gone(segments)
        if gone is None or not any(table in s["tables"] for s in segments):
            return lexical.Index(self._live(table, segments), key)
        found = self._places(self._rows(table, segments).withColumn("number", self._number(segments)), gone)
        return lexical.Index(found.rows, key, live=found.live)

    def registry(self) -> DataFrame:
        """The registry, or an empty one where it cannot be read."""
        try:
            rows = self.read("registry")
            rows.isEmpty()
            return rows
        except Exception:  # unreadable for whatever reason  # noqa: BLE001
            return self.spark.createDataFrame([], REGISTRY)

    # --- writes ---

    def _ids(self, segments: list[dict]) -> DataFrame:
        """The documents that segments touched."""
        if not segments:
            return self.spark.createDataFrame([], "doc_id string")
        return self.spark.read.schema("doc_id string").parquet(*[f"{self.path}/{s['id']}/ids" for s in segments])

    def _write(self, name: str, table: str, rows: DataFrame, ordered: bool = False) -> None:
        """Small tables are gathered to one file; the rows of large ones stay where they are. Each file is sorted by what searches ask for,
        which large tables that come ``ordered`` are already.
        """
        kinds = self.spark.createDataFrame([], TABLES[table]).schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        order = ORDER.get(table, ["doc_id"])
        if workspace.read_bytes(rows) <= SMALL:
            rows, ordered = rows.hint("rebalance", F.col(order[0])), False
        rows = rows if ordered else rows.sortWithinPartitions(*order)
        if table in PACKED:  # longer names go past the sort
            rows = rows.withColumn("part", F.concat(F.lit(f"{name}/"), F.element_at(F.split("part", "/"), -1)))
        rows.withColumn("segment", F.lit(name)).write.parquet(f"{self.path}/{name}/{table}")

    def replace(self, ids: DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame], ordered: tuple[str, ...] = (), **rows: DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
        """Rows of the documents ``ids`` (doc_id) go from all tables, and ``rows`` of these documents come in.

        A table may be a function that makes it of those written before it, which it gets by their names; ``ids`` may be one of all of them.
        Tables that are ``ordered`` come in the order of their files.
        """
        name = f"segment-{uuid.uuid4().hex}"
        now = self._newest()[1]
        done = lambda table: self._rows(table, [{"id": name, "tables": [table]}]).drop("segment")
        for table, new in rows.items():
            self._write(name, table, new(done) if callable(new) else new, table in ordered)
        ids = ids(done) if callable(ids) else ids
        ids.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id is not null").distinct().write.parquet(f"{self.path}/{name}/ids")
        touched = self._ids([{"id": name}])
        gone = touched.join(self._ids(now), "doc_id", "left_semi").select("doc_id", F.lit(name).alias("segment"))
        gone.write.parquet(f"{self.path}/{name}/gone")
        any_gone = bool(now) and not self.spark.read.parquet(f"{self.path}/{name}/gone").isEmpty()
        segment = {"id": name, "tables": sorted(rows), "gone": any_gone, "bytes": self._bytes(name)}
        seen = {s["id"] for s in now}

        def behind(newest: list[dict]) -> list[dict]:
            # a merged segment has what its parts had: those that came after the base are looked at
            others = [s for s in newest if s["id"] not in seen and not ("merged" in s and set(s["merged"]) <= seen)]
            if others and not touched.join(self._ids(others), "doc_id", "left_semi").isEmpty():
                raise Overtaken(self.path)
            return [*newest, segment]

        self._commit(behind)
        self.compact()

    def _bytes(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.path}/{name}")).getLength()

    def compact(self, all_: bool = False) -> bool:
        """Merge the last segments if ``FAN`` of about one size have gathered, or all; whether there was anything to do."""
        now = self._newest()[1]
        first, total = len(now), 0
        while first and (all_ or now[first - 1]["bytes"] <= FAN * max(total, 1) or first == len(now)):
            first -= 1
            total += now[first]["bytes"]
        run = now[first:]
        if len(run) < (2 if all_ else FAN):
            return False
        name = f"segment-{uuid.uuid4().hex}"
        tables = sorted({t for s in run for t in s["tables"]})
        for table in tables:
            rows = self._live(table, now, first)
            if table in PACKED:  # parts of several segments may have one name
                rows = rows.withColumn("part", F.md5("part"))
            self._write(name, table, rows)
        self._ids(run).distinct().write.parquet(f"{self.path}/{name}/ids")
        older = self._ids(now[:first])
        gone = self._ids([s for s in run if s["gone"]]).distinct().join(older, "doc_id", "left_semi") if first else older
        gone.select("doc_id", F.lit(name).alias("segment")).write.parquet(f"{self.path}/{name}/gone")
        merged = {"id": name, "tables": tables, "gone": first > 0 and any(s["gone"] for s in run), "bytes": self._bytes(name), "merged": [s["id"] for s in run]}
        names = merged["merged"]

        def instead(newest: list[dict]) -> list[dict]:
            own = [s["id"] for s in newest]
            if own[first : first + len(names)] != names:
                raise Overtaken(self.path)
            return [*newest[:first], merged, *newest[first + len(names) :]]

        try:
            self._commit(instead)
        except Overtaken:  # another writer merged them
            return False
        return True

    def remove(self, doc_id: str) -> bool:
        if not self.read("registry").where(F.col("doc_id") == doc_id).take(1):
            return False
        self.replace(self.spark.createDataFrame([(doc_id,)], "doc_id string"))
        return True

    def recreate(self) -> None:
        """Drop everything in the collection."""
        self._fs.delete(self._path(self.path), True)
