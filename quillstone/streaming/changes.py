"""File changes: one event per path and batch, quiet-gap batches, live sessions, known stats, and ingestion of a watched folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql.streaming.state import GroupState

    from quillstone.api import Workspace

#: Events between two order-preserving cuts of a log; a day of them is ordered by many tasks.
BUCKET_SECONDS = 3600


def classify(kind: Column) -> Column:
    """What a change event means for its file: modified, removed, or null where it says nothing of the content."""
    low = F.lower(kind)
    return F.when(low.isin("create", "modify", "created", "modified", "write"), "modified").when(low.isin("remove", "delete", "removed", "deleted"), "removed")


def coalesce_changes(events: DataFrame, path: str, kind: str, ts: str, tie: str) -> DataFrame:
    """The last event of each path, as one partial aggregate."""
    return events.groupBy(path).agg(F.max_by(kind, F.struct(ts, tie)).alias(kind), F.max(ts).alias(ts), F.count("*").alias("n_events"))


def debounce(events: DataFrame, ts: str, tie: str, seconds: float) -> DataFrame:
    """Batch number of each event within its day: a gap of `seconds` or more starts a new batch.

    Days are the partitions, so that a long log is not ordered by one task.
    """
    day = Window.partitionBy("day").orderBy(ts, tie)
    rows = events.withColumn("day", F.to_date(ts))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(day)) / 1e6
    rows = rows.withColumn("__new", F.coalesce((gap >= seconds).cast("int"), F.lit(1)))
    return rows.withColumn("batch", F.sum("__new").over(day).cast("long")).drop("__new")


def debounced(events: DataFrame, ts: str, tie: str, seconds: float) -> DataFrame:
    """Batch number of each event over the whole log, from 1: a gap of `seconds` or more starts a new batch.

    Events are ordered within hours; an hour's first event is compared with the last one before it, and batches are
    counted on from the hours' own numbers, of which there are few. So midnight ends nothing, and no task orders a day.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumn("__at", at).withColumn("__hour", F.floor(F.col("__at") / (BUCKET_SECONDS * 1_000_000)))
    inside = Window.partitionBy("__hour").orderBy("__at", tie)
    rows = rows.withColumn("__gap", F.col("__at") - F.lag("__at").over(inside))
    hours = rows.groupBy("__hour").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count_if(F.col("__gap") >= seconds * 1e6).alias("breaks"))
    along = Window.orderBy("__hour")
    starts = F.coalesce((F.col("first") - F.lag("last").over(along) >= seconds * 1e6).cast("long"), F.lit(1).cast("long"))
    hours = hours.withColumn("starts", starts).withColumn("total", F.sum(F.col("starts") + F.col("breaks")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    hours = hours.select("__hour", (F.col("total") - F.col("breaks")).alias("before"))
    rows = rows.withColumn("__n", F.sum(F.coalesce((F.col("__gap") >= seconds * 1e6).cast("long"), F.lit(0))).over(inside))
    return rows.join(hours, "__hour").withColumn("batch", F.col("before") + F.col("__n")).select(*events.columns, "batch")


def sessions(feed: DataFrame, by: str, ts: str, seconds: float, late_seconds: float) -> DataFrame:
    """first, last and n_events of each quiet-gap batch of the events of one `by` (a watched folder), live.

    A gap of `seconds` or more starts a new batch, as in `debounced`. On a stream a batch comes out once, when the watermark
    (the latest time seen, less `late_seconds`) has passed its last event by the gap: one that is still open at the end of a
    run stays in the state, and an event that comes later than `late_seconds` is passed over by the engine. Events of several
    micro-batches, and ones out of order by less, are joined. On a table every batch comes out. A null time belongs to none.
    """
    gap = f"{round(seconds * 1_000_000) - 1} microseconds"
    rows = feed.select(by, F.col(ts).cast("timestamp").alias("__at")).where("__at is not null").withWatermark("__at", f"{late_seconds} seconds")
    found = rows.groupBy(by, F.session_window("__at", gap).alias("__session")).agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n_events"))
    return found.drop("__session")


#: A stat as the state and its step hold it; a null length or change time is -1, and equal to itself.
STAT = "path string, length long, modified_us long, seen_us long"
STAT_NAMES = ["path", "length", "modified_us", "seen_us"]
#: What one state holds: the last stats of its paths, a column as an array.
KNOWN = "paths array<string>, lengths array<long>, modified array<long>, seen array<long>"
#: Paths share this many states, so that calls of the step do not grow with them. A checkpoint holds states by this number.
BUCKETS = 1024


def last_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last stat of each path in each batch of rows: what one path has many of is dropped before the shuffle."""
    for rows in batches:
        yield rows.sort_values(["seen_us", "modified_us", "length"]).drop_duplicates("path", keep="last")


def changed_stats(feed: DataFrame, ttl_seconds: int) -> DataFrame:
    """Of a stream of stats (path, length, modified, seen), those whose length or change time is not the one known for the path.

    The last stat of a path in a micro-batch counts: by seen, then modified, then length. It is compared with the one in the
    state, which outlives restarts by the query's checkpoint. A path that was not seen for `ttl_seconds` of the feed's own
    time is forgotten, so the states hold living paths; its next stat is a change. A stat seen before the one in the state
    says nothing, and one later than `ttl_seconds` is passed over by the engine, as are those without path or time.
    Paths are dealt by hash over BUCKETS states, each compared as a whole.
    """
    micros = lambda name: F.coalesce(F.unix_micros(F.col(name).cast("timestamp")), F.lit(-1))
    rows = feed.where("path is not null and seen is not null").select("path", F.coalesce(F.col("length").cast("long"), F.lit(-1)).alias("length"), micros("modified").alias("modified_us"), micros("seen").alias("seen_us"))
    rows = rows.mapInPandas(last_stats, STAT).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))
    rows = rows.withColumn("seen", F.timestamp_micros("seen_us")).withWatermark("seen", f"{ttl_seconds} seconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {path: (seen, modified, length) for path, length, modified, seen in zip(*state.get, strict=True)} if state.exists else {}
        last: dict[str, tuple[int, int, int]] = {}
        for batch in () if state.hasTimedOut else batches:
            for path, length, modified, seen in zip(*(batch[name].tolist() for name in STAT_NAMES), strict=True):
                stat = (seen, modified, length)
                last[path] = max(last.get(path, stat), stat)
        last = {path: stat for path, stat in last.items() if path not in known or known[path][0] <= stat[0]}
        found = [(path, stat[2], stat[1], stat[0]) for path, stat in last.items() if path not in known or known[path][1:] != stat[1:]]
        # a stat of this batch stays for the next one, even if it came so late that its time is over
        watermark = state.getCurrentWatermarkMs()
        living = {path: stat for path, stat in known.items() if stat[0] // 1000 + ttl_seconds * 1000 >= watermark} | last
        if living:
            state.update(([*living], [x[2] for x in living.values()], [x[1] for x in living.values()], [x[0] for x in living.values()]))
            # a timeout has to lie ahead of the watermark
            state.setTimeoutTimestamp(max(min(x[0] for x in living.values()) // 1000 + ttl_seconds * 1000, watermark + 1))
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=STAT_NAMES)

    found = rows.groupBy("bucket").applyInPandasWithState(step, STAT, KNOWN, "append", "EventTimeTimeout")
    known_or_null = lambda name: F.when(F.col(name) >= 0, F.col(name))
    return found.select("path", known_or_null("length").alias("length"), F.timestamp_micros(known_or_null("modified_us")).alias("modified"), F.timestamp_micros("seen_us").alias("seen"))


def unchanged_dropped(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, import_hash) whose content is not the one that is known for their path."""
    return files.join(known.select("path", "import_hash"), ["path", "import_hash"], "left_anti")


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every_ms: int = 500):  # noqa: ANN201
    """A streaming query that hands each batch of files to `sink`: path, content and import_hash.

    Which files were seen is kept by the source's own log; a batch holds a file once, with its last content. No state
    grows beside that: the sink knows what is stored. A file that goes away says nothing. `stop()` ends the query.
    """
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("allowOverwrites", True)
    rows = source.schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(some: DataFrame, number: int) -> None:
        last = some.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content"))
        sink(last.withColumn("import_hash", F.sha2("content", 256)), number)

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=f"{every_ms} milliseconds")).start()


def ingest_stream(workspace: Workspace, folder: str, checkpoint: str, once: bool = True):  # noqa: ANN201
    """Take in a folder as its files come and change; a file whose content is known is passed over.

    Changes are gathered for the settings' `debounce_ms`.
    """
    from quillstone.sources import files

    def sink(batch: DataFrame, number: int) -> None:
        workspace.ingest_frame(files.described(batch.select("path", "content")), True).count()

    return watch(workspace.spark, folder, sink, checkpoint, once, workspace.config.debounce_ms)
