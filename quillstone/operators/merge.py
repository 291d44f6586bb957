"""A new version of documents against the stored one: nodes keep their identity where their text is the same or close.

Set mode matches equal hashes first, one to one by occurrence, then what is left by edit distance (see `diff`). Sequential
mode goes through a document's new nodes in order and gives each the first free equal node, else the closest free one, so
an early close match can take what a later node equals. The document's own node is matched by document.

Defined cases: a document without an old version is new as a whole; one without a new version is left alone; nodes of
equal text are told by their order; a null text equals an empty one.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillstone.operators import diff
from quillstone.sources.stored import drop_table, shared_table

THRESHOLD = 0.2


def numbered(nodes: DataFrame, same_type: bool) -> DataFrame:
    """What the diff needs: doc_id, block (the place in order), text and, where types must agree, a hash of both."""
    rows = nodes.where(F.size("path") > 0).select("doc_id", F.col("position").cast("long").alias("block"), F.coalesce("text", F.lit("")).alias("text"), "node_type")
    return rows if same_type else rows.drop("node_type")


def pairs(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD, mode: str = "set", same_type: bool = False) -> DataFrame:
    """doc_id, old_block, new_block and outcome (kept or updated) of the nodes that keep their identity."""
    a, b = numbered(old, same_type), numbered(new, same_type)
    match = sequential if mode == "sequential" else pairs_of
    if same_type:
        # a type is a document of its own to the diff
        key = lambda x: x.withColumn("doc_id", F.struct("doc_id", "node_type")).drop("node_type")
        found = match(key(a), key(b), threshold)
        return found.withColumn("doc_id", F.col("doc_id.doc_id"))
    return match(a, b, threshold)


def pairs_of(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    both = shared_table(diff.matched(a, b), "matched")
    kept = both.where("is_new = 0 and partner is not null").select("doc_id", F.col("block").alias("old_block"), F.col("partner").alias("new_block"), F.lit("kept").alias("outcome"))
    return kept.unionByName(diff.fuzzy_of(diff.without_partner(both), threshold).select("doc_id", "old_block", "new_block", F.lit("updated").alias("outcome")))


def distance(a: str, b: str, bound: int) -> int | None:
    """Edit distance up to a bound: a column of the table at a time, as the bits of whole numbers (Myers 1999)."""
    n = diff.shared_start(a, b)
    a, b = a[n:], b[n:]
    n = diff.shared_start(a[::-1], b[::-1])
    a, b = sorted((a[: len(a) - n], b[: len(b) - n]), key=len)
    far = len(b)
    if far - len(a) > bound:
        return None
    if not a:
        return far
    code = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    here = {c: int.from_bytes(np.packbits(code == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    whole, last = (1 << far) - 1, 1 << (far - 1)
    up, down = whole, 0
    for left, x in zip(range(len(a) - 1, -1, -1), a, strict=True):
        same = here[x]
        steps = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(steps | up)), up & steps
        far += 1 if more & last else -1 if less & last else 0
        if far - left > bound:
            return None
        more, kept = more << 1 | 1, same | down
        up, down = (less << 1 | ~(kept | more)) & whole, more & kept & whole
    return far if far <= bound else None


#: An edit takes or makes at most so many grams of GRAM characters, which are counted in BINS by their hash.
GRAM, BINS = 3, 512


def profile(text: str) -> np.ndarray:
    """How many grams of a text fall into each bin; sums of differences are at most 2 * GRAM for each edit between two texts."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code) - GRAM + 1
    if n < 1:
        return np.zeros(BINS, np.int32)
    h = (code[:n] * np.uint32(0x9E3779B1) ^ code[1 : n + 1] * np.uint32(0x85EBCA77)) + code[2:] * np.uint32(0xC2B2AE3D)
    return np.bincount(h >> 23, minlength=BINS).astype(np.int32)


class Free:
    """The old nodes of one document that are not taken, in order."""

    def __init__(self, blocks: list[int], keys: list[bytes], texts: list[str]) -> None:
        self.blocks, self.texts, self.free = blocks, texts, np.ones(len(blocks), bool)
        self.size, self.bytes = np.array([len(t) for t in texts], np.int64), np.array([len(t.encode()) for t in texts], np.int64)
        self.equal: dict[bytes, deque] = defaultdict(deque)
        for k, key in enumerate(keys):
            self.equal[key].append(k)
        self.profiles: np.ndarray | None = None

    def take_equal(self, key: bytes) -> int | None:
        queue = self.equal.get(key, ())
        while queue and not self.free[queue[0]]:
            queue.popleft()
        return self.take(queue.popleft()) if queue else None

    def take(self, k: int) -> int:
        self.free[k] = False
        return self.blocks[k]

    def take_closest(self, text: str, threshold: float) -> int | None:
        """The free node of the least ratio, the first of equals; grams give a bound below each distance, so few are measured."""
        size = np.maximum(self.bytes, len(text.encode()))
        some = np.flatnonzero(self.free & (size > 0) & (np.abs(self.size - len(text)) <= size * threshold + 1))
        if not len(some):
            return None
        if self.profiles is None:
            self.profiles = np.stack([profile(t) for t in self.texts])
        own, least = profile(text), np.abs(self.size[some] - len(text))
        for at in range(0, len(some), 4096):
            apart = np.abs(self.profiles[some[at : at + 4096]] - own).sum(1)
            least[at : at + 4096] = np.maximum(least[at : at + 4096], -(-apart // (2 * GRAM)))
        ratio, best = least / size[some], (threshold, -1)
        for j in np.argsort(ratio, kind="stable"):
            k, bytes_ = int(some[j]), int(size[some[j]])
            if ratio[j] > best[0]:
                break
            d = distance(self.texts[k], text, int(bytes_ * best[0]) + 1)
            if d is not None and (d / bytes_ < best[0] or d / bytes_ == best[0] and (best[1] < 0 or k < best[1])):
                best = d / bytes_, k
        return None if best[1] < 0 else self.take(best[1])


def sequential(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """The pairs in a document's order. Rows come in order from Spark and are read as a stream; a task holds one document's old texts.

    Those come from one value of the table and are no longer than it. An identity of text is what `nodes` hashes.
    """
    key = F.unhex(F.sha2(F.regexp_replace("text", r"\A[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\z", ""), 256))
    rows = [x.select("doc_id", F.lit(k).alias("is_new"), "block", key.alias("key"), "text") for k, x in enumerate((old, new))]
    # a window, as Spark drops a repartition over a union that looks dealt that way, and may then change how its sides are dealt
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("is_new", "block"))
    rows = rows[0].unionByName(rows[1]).withColumn("place", place)
    schema = StructType([rows.schema["doc_id"], StructField("old_block", LongType()), StructField("new_block", LongType()), StructField("outcome", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, free = None, ([], [], []), None
        for batch in batches:
            taken, out = [], []
            for k, (d, is_new, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)):
                if d != doc:
                    doc, held, free = d, ([], [], []), None
                block, same, text = row
                if not is_new:
                    for column, value in zip(held, row, strict=True):
                        column.append(value)
                    continue
                free = free or Free(*held)
                found, outcome = free.take_equal(same), "kept"
                if found is None:
                    found, outcome = free.take_closest(text, threshold), "updated"
                if found is not None:
                    taken.append(k), out.append((found, block, outcome))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def shaped(digest: Column) -> Column:
    """A digest in the form of an identity."""
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def merge(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD, mode: str = "set", same_type: bool = False) -> DataFrame:
    """The node columns of the new version with version, status and outcome (kept, updated, new or deleted).

    `old` holds node columns, version and status; `new` is as `nodes.segment` makes it. A node that is updated has its
    version raised by one; one that is gone keeps its row with the status deleted.
    """
    # what is known of documents and matches is stored, so that neither version is worked out again for each of its uses
    edition = shared_table(old.groupBy("doc_id").agg(F.max("version").alias("last"), F.count("*").alias("rows")), "edition")
    same = new.join(edition.select("doc_id"), "doc_id", "left_semi")
    before = old.where("status = 'active'").join(shared_table(new.select("doc_id").distinct(), "documents"), "doc_id", "left_semi")
    place = F.col("position").cast("long")
    held = shared_table(before.select("doc_id", place.alias("old_block"), F.col("node_id").alias("held_id"), F.col("version").alias("held_version"), F.col("structural_hash").alias("held_hash"), (F.size("path") == 0).alias("root")), "held")
    roots = held.where("root").select("doc_id", "old_block", F.col("old_block").alias("new_block"), F.lit("root").alias("outcome"))
    match = pairs(before, same, threshold, mode, same_type).unionByName(roots)
    match = shared_table(match.join(held.drop("root"), ["doc_id", "old_block"]), "match")
    drop_table(held)
    joined = new.select("doc_id", "node_id", "structural_hash", place.alias("new_block")).join(match, ["doc_id", "new_block"], "left").join(edition, "doc_id", "left")
    # an identity that content gives may belong to a node of an older version, so later ones are salted
    fresh = F.when(F.col("last").isNull(), F.col("node_id")).otherwise(shaped(F.sha2(F.concat_ws("@", "node_id", F.col("last").cast("string"), F.col("rows").cast("string")), 256)))
    changed = (F.col("outcome") == "updated") | ((F.col("outcome") == "root") & (F.col("held_hash") != F.col("structural_hash")))
    placed = joined.select(
        "doc_id", "node_id", F.coalesce("held_id", fresh).alias("final_id"),
        F.when(changed, F.col("held_version") + 1).otherwise(F.coalesce("held_version", F.lit(1))).cast("int").alias("version"),
        F.when(F.col("outcome") == "root", F.when(changed, "updated").otherwise("kept")).otherwise(F.coalesce("outcome", F.lit("new"))).alias("outcome"),
        F.lit("active").alias("status"),
    )
    placed = shared_table(placed, "placed")
    parents = placed.select("doc_id", F.col("node_id").alias("parent_id"), F.col("final_id").alias("final_parent"))
    columns = [*new.columns, "version", "status", "outcome"]
    current = new.join(placed, ["doc_id", "node_id"]).join(parents, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.col("final_parent")).withColumn("node_id", F.col("final_id")).select(columns)
    gone = before.join(match.select("doc_id", F.col("held_id").alias("node_id")), ["doc_id", "node_id"], "left_anti")
    return current.unionByName(gone.withColumns({"status": F.lit("deleted"), "outcome": F.lit("deleted")}).select(columns))


def counts(merged: DataFrame) -> DataFrame:
    """doc_id and the numbers of nodes that were kept, updated, new and deleted."""
    return merged.groupBy("doc_id").agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("kept", "updated", "new", "deleted")))
