"""The record of what was done: one row for each activity, and its query."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.stored import shared_table

SCHEMA = "activity_id string, activity_type string, input_ids array<string>, output_ids array<string>, agent string, config string, started_at timestamp, ended_at timestamp"


def config_json(kind: str | None, merge: bool, threshold: float) -> str:
    return json.dumps({"format": kind, "merge": merge, "fuzzy_threshold": threshold})


def log(spark: SparkSession, activity: str, inputs: DataFrame, outputs: DataFrame, agent: str, config: str, now: Column) -> DataFrame:
    """One row for each document that was taken in: its own id, and the ids made, in order of position; no ids give null.

    `inputs` has doc_id, `outputs` doc_id, node_id and position.
    """
    made = outputs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"]).alias("made"))
    rows = inputs.select("doc_id").distinct().join(made, "doc_id", "left").withColumn("n", now)
    doc = F.col("doc_id").cast("string")
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(activity), doc, F.col("n").cast("string")), 256).alias("activity_id"), F.lit(activity).alias("activity_type"),
        F.when(doc.isNotNull(), F.array(doc)).alias("input_ids"), F.col("made").alias("output_ids"), F.lit(agent).alias("agent"), F.lit(config).alias("config"),
        F.col("n").cast("timestamp").alias("started_at"), F.col("n").cast("timestamp").alias("ended_at"),
    )


def query(activities: DataFrame, doc_id: str | None = None, activity: str | None = None, limit: int | None = None) -> DataFrame:
    """Activities, the last ones first, by document (among inputs or outputs), type and number, each if given."""
    rows = activities
    if doc_id is not None:
        rows = rows.where(F.coalesce(F.array_contains("input_ids", doc_id), F.lit(False)) | F.coalesce(F.array_contains("output_ids", doc_id), F.lit(False)))
    if activity is not None:
        rows = rows.where(F.col("activity_type") == activity)
    rows = rows.orderBy(F.desc("started_at"), "activity_id")
    return rows if limit is None else rows.limit(limit)


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """node_id, ancestor_id and distance for each start node, up to the document.

    A node's path holds the paths of all its ancestors, so one join on document and path finds them at any depth. Siblings
    have theirs in common, so that is done once for each parent, and its list is as long as the tree is deep.
    """
    low = nodes.select("doc_id", "node_id", "path").join(start.select("node_id").distinct(), "node_id", "left_semi").where(F.size("path") > 0)
    low = low.select("doc_id", "node_id", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("above"))
    above = low.select("doc_id", "above").distinct()
    up = above.select("doc_id", "above", F.explode(F.transform(F.sequence(F.lit(0), F.size("above")), lambda k: F.slice("above", 1, k))).alias("path"))
    found = up.join(nodes.select("doc_id", "path", F.col("node_id").alias("ancestor_id")), ["doc_id", "path"])
    lists = found.groupBy("doc_id", "above").agg(F.collect_list(F.struct("ancestor_id", (F.size("above") + 1 - F.size("path")).alias("distance"))).alias("found"))
    return low.join(lists, ["doc_id", "above"]).select("node_id", F.inline("found"))


def links(activities: DataFrame) -> DataFrame:
    """child and parent: each output of an activity comes from each of its inputs; an id is no parent of its own."""
    rows = activities.select(F.explode("output_ids").alias("child"), "input_ids").select("child", F.explode("input_ids").alias("parent"))
    return rows.where("child <> parent").distinct()


def lineage(ties: DataFrame, start: DataFrame) -> DataFrame:
    """child, ancestor and depth: what each start (child) comes from, over any number of ties (child, parent), by the shortest way.

    Each round goes one tie up from what the last one found new, so a circle ends where it began; rounds are stored.
    """
    known = shared_table(ties.select(F.col("child").alias("at"), F.col("parent").alias("ancestor")).where("at is not null and ancestor is not null").distinct(), "ties")
    first = shared_table(start.select("child").where("child is not null").distinct().join(known.withColumnRenamed("at", "child"), "child").select("child", "ancestor", F.lit(1).alias("depth")), "lineage")
    middle = first.select(F.col("ancestor").alias("child")).distinct()
    if 2 * middle.count() > first.select("child").distinct().count():
        return closure(first, known)
    # many come from few: the rounds are those of the few
    asked = shared_table(middle.join(known.withColumnRenamed("at", "child"), "child").select("child", "ancestor", F.lit(1).alias("depth")), "lineage")
    further = shared_table(closure(asked, known), "lineage").select(F.col("child").alias("middle"), F.col("ancestor").alias("last"), "depth")
    through = first.select("child", F.col("ancestor").alias("middle")).join(further, "middle").select("child", F.col("last").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    return first.unionByName(through).groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def closure(new: DataFrame, known: DataFrame) -> DataFrame:
    """`new` (child, ancestor, depth 1) with all that the ties (at, ancestor) lead to."""
    found, depth = new, 1
    while not new.isEmpty():
        depth += 1
        step = new.select("child", F.col("ancestor").alias("at")).join(known, "at").select("child", "ancestor").distinct()
        new = shared_table(step.join(found, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        found = found.unionByName(new)
        if depth % 8 == 0:
            found = shared_table(found, "lineage")
    return found
