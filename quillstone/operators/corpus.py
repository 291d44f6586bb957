"""A corpus on disk: tables as sorted runs, named by manifests.

A commit writes the rows it adds or replaces to a folder of its own, a run, and then creates the next manifest, a small JSON
file that lists the runs and the schema of every table; until that file is there, nothing of the commit is seen, and of two
writers one fails. Rows of keyed tables carry the number of their commit: a reader takes each key's last row, with the first
one's `created_at`. Nothing is updated in place.

Runs are dealt to buckets by document and sorted by document and key, with Bloom filters on the ids. The document is part of
what rows are resolved by, so a filter on it goes below the resolution: a lookup reads one bucket of each run, there the row
groups of its document, and shuffles what it found and no more. When `FAN` neighbouring runs of a level have come together,
they are merged into one of the next level, so a table of n commits has about FAN * log(n) runs, and each row is written
again once a level.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Key of each table; a table without one only grows.
KEYS = {"documents": "doc_id", "nodes": "node_id", "annotations": "annotation_id", "edges": "edge_id", "activities": None, "contents": None}
#: Tables whose rows belong to one document for good, which is then part of their key.
BY_DOCUMENT = frozenset(("documents", "nodes", "annotations"))
#: Tables that another module merges, as it knows which rows are dead.
OWN_MERGE = frozenset(("postings", "blocks", "tombstones", "statistics"))
BUCKETS = 16
FAN = 4
#: Columns with a Bloom filter in each file, where a table has them.
FILTERED = ("node_id", "parent_id", "annotation_id", "target_id")
#: Spark's setting by which a job's shuffle files are deleted when it ends, not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class ConflictError(RuntimeError):
    """Another commit came first."""


def last_rows(rows: DataFrame, *keys: str, keep_seq: bool = False) -> DataFrame:
    """Each key's row with the highest `seq`, and the earliest created_at; one partial aggregate."""
    others = [c for c in rows.columns if c not in (*keys, "seq")]
    first = [F.min("created_at").alias("first")] if "created_at" in others else []
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "seq").alias("r"), F.max("seq").alias("seq"), *first)
    pick = lambda c: F.col("first") if c == "created_at" and first else F.col(f"r.{c}")
    return found.select(*keys, *(pick(c).alias(c) for c in others), *(["seq"] if keep_seq else []))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those with their key; columns that only one has are null in the other."""
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)), allowMissingColumns=True)
    return last_rows(both, key)


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Corpus:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        path, fs = self._path("manifests/*.json")
        return max((int(f.getPath().getName()[:-5]) for f in fs.globStatus(path) or []), default=0)

    def _state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "schemas": {}}
        path, fs = self._path(f"manifests/{version:08}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The runs of every table, oldest first."""
        return {name: [place for place, _ in runs] for name, runs in self._state(version)["tables"].items()}

    def has(self, table: str) -> bool:
        return table in self.manifest()

    def runs(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a table's runs, with seq, bucket and v (the commit that wrote the run), not resolved."""
        state = self._state(version)
        return self._read(name, [place for place, _ in state["tables"][name]], state["schemas"][name])

    def _read(self, name: str, places: list[str], schema: str) -> DataFrame:
        fields = StructType.fromJson(json.loads(schema)).add("v", IntegerType()).add("bucket", IntegerType())
        return self.spark.read.schema(fields).option("basePath", f"{self.root}/tables/{name}").parquet(*(f"{self.root}/{p}" for p in places))

    def _resolved(self, name: str, rows: DataFrame, keep_seq: bool = False) -> DataFrame:
        """The last row of each key. The bucket and the document are part of the key, so filters on them reach the files."""
        rows = rows.drop("v")
        if not KEYS.get(name):
            return rows if keep_seq else rows.drop("seq", "bucket")
        keys = ["bucket", "doc_id", KEYS[name]] if name in BY_DOCUMENT and "doc_id" in rows.columns else ["bucket", KEYS[name]]
        found = last_rows(rows, *dict.fromkeys(keys), keep_seq=keep_seq)
        return found if keep_seq else found.select(*(c for c in rows.columns if c not in ("seq", "bucket")))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last one by default."""
        return self._resolved(name, self.runs(name, version))

    def of_document(self, name: str, doc_id: object) -> DataFrame:
        """A document's rows of a table: one bucket of each run is read."""
        rows = self.runs(name)
        return self._resolved(name, rows.where((F.col("bucket") == bucket_of(F.lit(doc_id).cast(rows.schema["doc_id"].dataType))) & (F.col("doc_id") == F.lit(doc_id))))

    def by_key(self, name: str, key: str, value: object) -> DataFrame:
        """Rows by an id that is part of their key; row groups without it are passed over by their Bloom filters."""
        rows = self.runs(name)
        return self._resolved(name, rows.where(F.col(key) == F.lit(value)))

    def _write(self, name: str, rows: DataFrame, place: str) -> str:
        """Write one run; returns its schema without the bucket."""
        if "bucket" not in rows.columns:
            owner = "doc_id" if "doc_id" in rows.columns and name in BY_DOCUMENT else KEYS.get(name)
            rows = rows.withColumn("bucket", bucket_of(F.col(owner)) if owner else F.lit(0))
        order = [c for c in ("doc_id", KEYS.get(name)) if c and c in rows.columns and name not in OWN_MERGE]
        if order:
            # Spark splits a bucket that is too large for one task, and joins small ones
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *dict.fromkeys(order))
        # each row is written again once a level, so runs are packed well, and a filter is as large as its ids ask for
        out = rows.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in FILTERED:
            if c in rows.columns and name not in OWN_MERGE:
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        # what is shuffled for a run is of no use once it is written
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            out.parquet(f"{self.root}/{place}")
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return rows.drop("bucket").schema.json()

    def _publish(self, version: int, state: dict) -> None:
        path, fs = self._path(f"manifests/{version:08}.json")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise ConflictError(f"version {version} exists") from e
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()

    def commit(self, changes: dict[str, DataFrame | Callable], replace: tuple[str, ...] = ()) -> int:
        """Write all changes and publish them at once; returns the new version. Tables in `replace` begin anew.

        Rows may be a function of what this commit has written so far, which it is given as a reader of the runs by name.
        """
        before = self.version()
        state = self._state(before)
        after = before + 1
        done: dict[str, str] = {}
        written = lambda name: self._read(name, [f"tables/{name}/v={after:08}"], done[name])
        for name, rows in changes.items():
            place = f"tables/{name}/v={after:08}"
            rows = rows(written) if callable(rows) else rows
            schema = done[name] = self._write(name, rows.withColumn("seq", F.lit(after)), place)
            kept = [] if name in replace else state["tables"].get(name, [])
            state["tables"][name] = [*kept, [place, 0]]
            state["schemas"][name] = joined_schema(state["schemas"].get(name) if kept else None, schema)
        self._publish(after, state)
        for name in changes:
            after = self.settle(name) or after
        return after

    def settle(self, name: str) -> int | None:
        """Merge the youngest runs of a level if there are FAN of them, and so on upwards; the version that this makes, if any."""
        made = None
        while name not in OWN_MERGE:
            version = self.version()
            state = self._state(version)
            runs = state["tables"][name]
            level = runs[-1][1]
            same = next((k for k, (_, own) in enumerate(reversed(runs)) if own != level), len(runs))
            if same < FAN:
                return made
            young = [place for place, _ in runs[-same:]]
            place = f"tables/{name}/v={version + 1:08}"
            merged = self._resolved(name, self._read(name, young, state["schemas"][name]), keep_seq=True)
            self._write(name, merged, place)
            state["tables"][name] = [*runs[:-same], [place, level + 1]]
            try:
                self._publish(version + 1, state)
            except ConflictError:
                return made  # another writer came first; the next commit settles
            made = version + 1
        return made

    def compact(self, name: str) -> int:
        return self.commit({name: self.table(name)}, (name,))


def joined_schema(old: str | None, new: str) -> str:
    """The fields of both, those of the older one first."""
    if old is None:
        return new
    fields = StructType.fromJson(json.loads(old))
    for f in StructType.fromJson(json.loads(new)).fields:
        if f.name not in fields.names:
            fields = fields.add(f)
    return fields.json()
