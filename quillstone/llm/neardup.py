"""All pairs of documents whose word-shingle sets have a Jaccard similarity of at least a threshold.

Documents with equal sets form a class and are represented by one of them. Each representative has a MinHash signature of
`DEEPEST` digits in each of `TREES` trees. A signature is one 64-bit number, first digit on top, so the order of the numbers
is that of the tree's sorted prefix trie, and a subtree is a run of numbers with a common prefix.

Prefixes are matched at full depth first and shortened by a digit at a time, until the target recall is reached; that
depends on the corpus. A level's candidates are verified exactly, and those that met at a deeper one take no part again.
A pair of similarity s has met by depth d with probability 1 - (1 - s^d)^TREES, so each link that was found stands for one
over that many, and the links found over the links there should be is the level's recall. One link at the threshold is
counted beside them, so that a corpus without links is searched as deep as that takes.

Verification is done on the shingle sets, inside tasks: a task gets one subtree, or two blocks of a large one, and returns
a row for each linked representative (how many documents it is linked to there, and a root), never a row for each pair. A
pair that meets in several subtrees counts in the first one alone; subtrees with the same members are kept once. The
roots' connected components are found by alternating star contractions on stored tables. So no group is gathered whole,
no pair is lost to a cap, and copies cost nothing beyond their class.

Defined cases: a null text or one without words is a class of its own, without links; a row without an id gets neither;
ids may be of any type with an order, and one names one text (`first_of_each` tells rows apart where that is not so);
repeated rows are copies; other columns are ignored, or pass through whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillstone.llm.common import bound_batches, col, drop_table, fresh, shared_table
from quillstone.llm.shingles import mixed, shingle_sets

WIDTH = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
TREES = 32
#: Digits of a signature in each tree, of eight bits each.
DEEPEST = 8
#: Members of one block of a large subtree and about as many shingles, and pairs that are looked at together.
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
PAIRS = 8192
#: Bytes of a partition up to which the side without texts may be joined by hash.
SMALL_SIDE = 64 << 20
#: Stands for a tree in which a representative has no subtree; labels are shorter than that, or a full one is as rare as any.
NO_SUBTREE = -(1 << 63)
#: Ranges of similarity from the threshold to 1 in which links are counted.
RANGES = 20


def met(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that a pair has a common prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def recall(links: np.ndarray, depth: int, threshold: float) -> float:
    """Links found over links expected, by similarity range, with one link at the threshold beside them."""
    low = threshold + (1 - threshold) * np.arange(RANGES) / RANGES
    return float((links.sum() + 1) / ((links / met(low, depth)).sum() + 1 / met(threshold, depth)))


def hash_family(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signature(shingles: np.ndarray, family: np.ndarray) -> np.ndarray:
    """One 64-bit number for each tree, whose digits from the top are those of DEEPEST minima."""
    least = np.full(len(family), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        part = shingles[None, k : k + 4096] * family[:, None]
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(1))
    digits = (mixed(least) >> np.uint64(56)).reshape(-1, DEEPEST)
    return (digits << np.arange(8 * (DEEPEST - 1), -1, -8, dtype=np.uint64)).sum(1, dtype=np.uint64)


def sketches(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, k1, k2, n (which identify the set; null without words) and the signature p."""
    family = hash_family(TREES * DEEPEST)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), WIDTH)
            k1 = [int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)) if len(s) else None for s in sets]
            k2 = [int(np.add.reduce(mixed(s + np.uint64(77))).view(np.int64)) if len(s) else None for s in sets]
            p = [signature(s, family).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(p, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "n", "p"])

    return documents.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("t")).mapInArrow(sketch, "doc_id long, k1 long, k2 long, n long, p array<long>")


def firsts(i: np.ndarray, j: np.ndarray, group: dict, length: np.ndarray, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are this task's: of a size that can match, from the two blocks if there are two, first met here, and new to this level."""
    kept, whole, block = group["kept"], group["p"], group["block"]
    fit = ((block[i] != block[j]) | (group["b1"][0] == group["b2"][0])) & (np.minimum(length[i], length[j]) >= threshold * np.maximum(length[i], length[j]))
    i, j = i[fit], j[fit]
    both = (kept[i] == kept[j]) & (kept[i] != NO_SUBTREE)
    first = both.any(1) & (both.argmax(1) == group["tree"][0])
    i, j = i[first], j[first]
    if depth < DEEPEST:
        # what has a longer prefix in common was verified on the level before
        new = ((whole[i] ^ whole[j]).view(np.uint64) >> np.uint64(8 * (DEEPEST - depth - 1)) != 0).all(1)
        i, j = i[new], j[new]
    return i, j


def linked_within(group: dict, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and root of each member of one task's group, and its pairs by similarity; a root is the smallest linked id known here."""
    reps, sizes = group["rep"], group["size"]
    n = len(reps)
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    length = np.array([len(s) for s in sets])
    if n <= 12:
        i, j = np.triu_indices(n, 1)
    else:
        every, owner = np.concatenate(sets), np.repeat(np.arange(n), length)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        change = np.flatnonzero(np.diff(every)) + 1
        counts = np.diff(np.concatenate([[0], change, [len(every)]]))
        column = np.repeat(np.where(counts > 1, np.cumsum(counts > 1) - 1, -1), counts)
        owner, column = owner[column >= 0], column[column >= 0]
        shared = np.zeros((n, n), np.float32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [c, c + 4096])
            x = np.zeros((n, 4096), np.float32)
            x[owner[lo:hi], column[lo:hi] - c] = 1
            shared += x @ x.T
        i, j = np.nonzero(np.triu(shared >= threshold * (length[:, None] + length[None, :] - shared) - 1e-3, 1))
    links, root, found = np.zeros(n, np.int64), np.arange(n), np.zeros(RANGES, np.int64)
    parts = (firsts(i[at : at + PAIRS], j[at : at + PAIRS], group, length, depth, threshold) for at in range(0, len(i), PAIRS))
    for a, b in (pair for x, y in parts for pair in zip(x.tolist(), y.tolist(), strict=True)):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if n <= 12 else int(shared[a, b])
        every = int(length[a] + length[b] - common)
        if common < threshold * every:
            continue
        found[min(RANGES - 1, int((common / every - threshold) / (1 - threshold) * RANGES + 1e-9))] += 1
        links[a] += sizes[b]
        links[b] += sizes[a]
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if reps[a] > reps[b]:
            a, b = b, a
        root[b] = a
    for k in range(n):
        while root[k] != root[root[k]]:
            root[k] = root[root[k]]
    return links, reps[root], found


def verified(members: DataFrame, depth: int, threshold: float) -> DataFrame:
    """rep, links, root and, on one row of each group, its pairs by similarity. `members` arrives sorted by group, and a group never exceeds two blocks."""

    def columns(b: pa.RecordBatch) -> dict:
        """A batch's columns as arrays; the shingles stay bytes."""
        lists = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("kept", "p")}
        plain = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "label", "b1", "b2", "rep", "block", "size")}
        return plain | {c: x.reshape(b.num_rows, -1) for c, x in lists.items()} | {"shingles": b.column("shingles").to_pylist()}

    def part(group: dict, a: int, b: int) -> dict:
        return {c: x[a:b] for c, x in group.items()}

    def close(group: dict) -> pa.RecordBatch | None:
        # a text that is there twice under one id is one member
        once = np.sort(np.unique(group["rep"], return_index=True)[1])
        if len(once) < 2:
            return None
        if len(once) < len(group["rep"]):
            group = {c: [x[k] for k in once] if c == "shingles" else x[once] for c, x in group.items()}
        links, root, found = linked_within(group, depth, threshold)
        got = np.flatnonzero(links)
        if not len(got):
            return None
        pairs = pa.array([found, *[None] * (len(got) - 1)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(group["rep"][got]), pa.array(links[got]), pa.array(root[got]), pairs], ["rep", "links", "root", "pairs"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = columns(b)
            same = np.ones(b.num_rows, bool)
            same[0] = held is not None and all(held[c][-1] == now[c][0] for c in keys)
            for c in keys:
                same[1:] &= now[c][1:] == now[c][:-1]
            bounds = [0, *(np.flatnonzero(~same[1:]) + 1).tolist(), b.num_rows]
            for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = part(now, a, z)
                if k == 0 and same[0]:
                    held = {c: held[c] + own[c] if c == "shingles" else np.concatenate([held[c], own[c]]) for c in own}
                    continue
                if held is not None and (out := close(held)) is not None:
                    yield out
                held = own
        if held is not None and (out := close(held)) is not None:
            yield out

    keys = ["tree", "label", "b1", "b2"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(check, "rep long, links long, root long, pairs array<long>")


def components(edges: DataFrame) -> DataFrame:
    """u and the smallest id of its component, for every end u of an edge (u, v). Stars are contracted until none changes."""
    before = None
    edges = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            return edges
        before, last = state, edges
        # large star: larger neighbours of u go to the smallest of u's neighbourhood; small star: the smaller ones do
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        edges = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = shared_table(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        drop_table(last)


def level(texts: DataFrame, classes: DataFrame, deeper: DataFrame | None, depth: int, threshold: float) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """This depth's subtrees, the stored links of pairs that first meet here, and their number by similarity."""
    entries = classes.select("rep", "n", F.posexplode("p").alias("tree", "word")).select("rep", "n", "tree", F.shiftrightunsigned("word", 8 * (DEEPEST - depth)).alias("label"))
    subtrees = entries.groupBy("tree", "label").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "rep")).alias("y")).where("m > 1")
    # subtrees with the same members say the same; the first of them stays
    groups = shared_table(subtrees.groupBy("m", "x", "y").agg(F.min(F.struct("tree", "label")).alias("s"), F.max("size").alias("size")), "groups")
    # a subtree whose members are those of a deeper one has no pair that is new
    alone = groups if deeper is None else groups.join(deeper, ["m", "x", "y"], "left_anti")
    alone = alone.select("s.tree", "s.label", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = shared_table(entries.drop("n").join(alone, ["tree", "label"]), "subtrees")
    slots = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.coalesce(F.try_element_at(F.col("mine"), k), F.lit(NO_SUBTREE)))
    per_rep = held.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "label"))).alias("mine"), F.collect_list(F.struct("tree", "label", "blocks")).alias("in")).select("rep", slots.alias("kept"), "in")
    known = classes.select("rep", "size", (F.col("p") if depth < DEEPEST else F.array().cast("array<bigint>")).alias("p"))
    wanted = per_rep.join(known, "rep")

    def add_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(b.column(1), WIDTH)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets, *b.columns[2:]], ["rep", "shingles", "kept", "in", "size", "p"])

    involved = texts.join(wanted, "rep").select("rep", "t", "kept", "in", "size", "p")
    schema = "rep long, shingles binary, kept array<long>, in array<struct<tree:int,label:long,blocks:int>>, size long, p array<long>"
    sets = involved.mapInArrow(add_sets, schema).select("rep", "shingles", "kept", "size", "p", F.explode("in").alias("s")).select("rep", "shingles", "kept", "size", "p", "s.*")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = sets.select("tree", "label", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "rep", "block", "size", "kept", "p", "shingles")
    found = shared_table(verified(members, depth, threshold), "links")
    drop_table(held)
    counts = np.zeros(RANGES)
    for r in found.where("pairs is not null").select(F.posexplode("pairs").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return groups.select("m", "x", "y"), found, counts


def hash_joins(spark: SparkSession) -> None:
    """Let Spark join by hash, without sorting the texts, where it has measured that each partition of the other side is small."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(SMALL_SIDE))


def join(documents: DataFrame, text: str, doc_id: str, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its connected links), copy_of (smallest id with its very set), n_links."""
    bound_batches(documents.sparkSession)
    hash_joins(documents.sparkSession)
    if not isinstance(documents.select(col(doc_id)).schema[0].dataType, IntegralType):
        return join_by_row(documents, text, doc_id, threshold, target)
    sketch = shared_table(sketches(documents, text, doc_id), "sketches")
    known = sketch.where("k1 is not null and doc_id is not null")
    classes = shared_table(known.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "p")).alias("r"), F.count("*").alias("size")).select("k1", "k2", "n", F.col("r.doc_id").alias("rep"), F.col("r.p").alias("p"), "size"), "classes")
    texts = documents.select(col(doc_id).cast("long").alias("rep"), col(text).alias("t"))
    levels, pairs, groups = [], np.zeros(RANGES), None
    for depth in range(DEEPEST, 0, -1):
        groups, found, counts = level(texts, classes, groups, depth, threshold)
        levels.append(found.drop("pairs"))
        pairs += counts
        if recall(pairs, depth, threshold) >= target:
            break
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    links = found.groupBy("rep").agg(F.sum("links").alias("l"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"u": "rep", "v": "root"})
    own = classes.select("k1", "k2", "n", "rep", "size").join(links, "rep", "left").join(roots, "rep", "left")
    return (
        sketch.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2", "n").join(own, ["k1", "k2", "n"], "left")
        .select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_of"), (F.coalesce("l", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_links"))
    )


def join_by_row(documents: DataFrame, text: str, doc_id: str, threshold: float, target: float) -> DataFrame:
    """The same for ids that are no whole numbers: rows are joined by a stored number, and classes get their smallest id."""
    rows = shared_table(documents.select(col(doc_id).alias("id"), col(text).alias("t")).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = join(rows.where("id is not null"), "t", "row", threshold, target).join(rows.select(F.col("row").alias("doc_id"), "id"), "doc_id")
    found = shared_table(found, "row-classes")
    smallest = lambda c: found.groupBy(c).agg(F.min("id").alias(f"{c}_id"))
    named = found.join(smallest("class_id"), "class_id").join(smallest("copy_of"), "copy_of")
    none = F.lit(None).cast(rows.schema["id"].dataType)
    without = rows.where("id is null").select("id", none.alias("class_id"), none.alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return named.select("id", F.col("class_id_id").alias("class_id"), F.col("copy_of_id").alias("copy_of"), "n_links").unionByName(without).withColumnRenamed("id", "doc_id")


def first_of_each(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row of each class: the one with the smallest id, rows without an id last.

    Rows are told apart by a stored key, not by their id: of repeated rows one stays, of two texts under one id only what
    is a copy goes, and copies without an id go like others. A text without words is a class of its own, so its row stays.
    """
    row = fresh(documents.columns, "row")
    rows = shared_table(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = join(rows, text, row).select(F.col("doc_id").alias("r"), "class_id")
    found = found.join(rows.select(F.col(row).alias("r"), col(doc_id).alias("id")), "r")
    # each class names the row that stays, so nothing is joined by class
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("f")).select(F.col("f.r").alias(row))
    return rows.join(first, row, "left_semi").select(*(col(c) for c in documents.columns))
