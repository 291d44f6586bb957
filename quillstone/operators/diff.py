"""Node diff between two versions: equal hashes first, one to one by occurrence, then edit distance.

The edit-distance join rests on the pigeonhole principle: d edits leave d + 1 runs of a text whole, so texts within distance
d share a run of at least (length - d) / (d + 1) characters. From each text the locally least hashes of its grams are kept
(winnowing), so that two texts that share a run of a scheme's length keep a gram in common; grams are joined by document, and
only the pairs that meet are measured. Pairs are taken best first, so close ones are looked for before distant ones: each
tier of ratios joins what the tiers before it left, by the longest runs that its ratio allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quillstone.functions import text as T
from quillstone.sources.stored import drop_table, shared_table

#: Ratios up to which pairs are looked for together; a threshold ends the list.
TIERS = (0.02, 0.05)
#: Shortest run that two texts share, to the length of a gram and the number of neighbouring grams of which the least is
#: kept. Texts that need not share a run of two characters are compared by length alone.
SCHEMES = {0: (0, 1), 2: (2, 1), 3: (2, 2), 4: (3, 2), 8: (5, 4), 16: (8, 9), 32: (12, 21)}
#: Rounds in which mutual bests are taken by node; what is left after them is taken document by document.
ROUNDS = 2


def exact(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, old_block, new_block and status: kept, new or deleted. The k-th node of a text is the k-th one of the other side.

    Both sides go through one exchange, as hashes; it serves the numbering of either side and the matching.
    """
    rows = [x.select("doc_id", "block", F.unhex(T.structural_hash(F.col("text"))).alias("hash"), F.lit(k).alias("side")) for k, x in enumerate((old, new))]
    both = rows[0].unionByName(rows[1]).repartition("doc_id", "hash")
    both = both.withColumn("occ", F.row_number().over(Window.partitionBy("doc_id", "hash", "side").orderBy("block")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("block")))
    pairs = both.groupBy("doc_id", "hash", "occ").agg(of(0).alias("old_block"), of(1).alias("new_block"))
    status = F.when(F.col("old_block").isNull(), "new").when(F.col("new_block").isNull(), "deleted").otherwise("kept")
    return pairs.select("doc_id", "old_block", "new_block", status.alias("status"))


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, block, is_new, partner and text of the nodes of both sides, shuffled once, by document.

    The partner is the node of the other side that exact() gives; only nodes without one keep their text.
    """
    rows = [x.select("doc_id", "block", "text", F.lit(k).alias("is_new")) for k, x in enumerate((old, new))]
    rows = rows[0].unionByName(rows[1]).repartition("doc_id").withColumn("hash", T.structural_hash(F.col("text")))
    occ = F.row_number().over(Window.partitionBy("doc_id", "hash", "is_new").orderBy("block"))
    both = Window.partitionBy("doc_id", "hash", "occ")
    rows = rows.withColumn("occ", occ)
    other = F.when(F.count("*").over(both) > 1, F.sum("block").over(both) - F.col("block")).cast(rows.schema["block"].dataType)
    rows = rows.withColumn("partner", other)
    return rows.select("doc_id", "block", "is_new", "partner", F.when(F.col("partner").isNull(), F.col("text")).alias("text"))


def left_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, block, text and is_new of the nodes that exact() leaves without a partner."""
    return without_partner(matched(old, new))


def without_partner(both: DataFrame) -> DataFrame:
    return both.where("partner is null").select("doc_id", "block", "text", "is_new")


def shared_start(a: str, b: str) -> int:
    """Characters that both begin with; slices are compared, in halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def with_differing_parts(pairs: DataFrame) -> DataFrame:
    """doc_id, old_block, new_block, size, old_part and new_part: the texts without what both begin and end with, which no edit touches."""
    kept = ["doc_id", "old_block", "new_block", "size"]
    schema = StructType([*(pairs.schema[c] for c in kept), StructField("old_part", StringType()), StructField("new_part", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: tuple[list[str], list[str]] = ([], [])
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                a, b = x.as_py(), y.as_py()
                n = shared_start(a, b)
                a, b = a[n:], b[n:]
                m = shared_start(a[::-1], b[::-1])
                parts[0].append(a[: len(a) - m]), parts[1].append(b[: len(b) - m])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(p, pa.string()) for p in parts)], schema.names)

    return pairs.select(*kept, "old_text", "new_text").mapInArrow(run, schema)


def best_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are taken, from pairs sorted by doc_id, ratio, old_block and new_block: a pair is taken if both nodes are free."""
    doc, olds, news = None, set(), set()
    for batch in batches:
        taken = []
        for k, (d, o, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "old_block", "new_block")), strict=True)):
            if d != doc:
                doc, olds, news = d, set(), set()
            if o not in olds and n not in news:
                olds.add(o)
                news.add(n)
                taken.append(k)
        yield batch.take(pa.array(taken, pa.int64())).select(["doc_id", "old_block", "new_block", "distance"])


def sampled_grams(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the grams that are least among `window` neighbours somewhere, each once, and their first and last places."""
    if not gram:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(text))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - gram + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if n <= window:
        at = np.array([n - 1 - int(h[::-1].argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
        at = np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))
    # a text that repeats itself has the same gram many times
    kept, first = np.unique(h[at], return_index=True)
    last = len(at) - 1 - np.unique(h[at][::-1], return_index=True)[1]
    return kept.view(np.int64), at[first].astype(np.int64), at[last].astype(np.int64)


def with_bound(rows: DataFrame, threshold: float) -> DataFrame:
    """Add d, the edits that a text allows if it is the longer one in bytes, and its scheme."""
    d = F.floor(F.col("bytes") * threshold + 1e-9).cast("int")
    run = F.ceil((F.col("size") - d) / (d + 1))
    scheme = F.lit(0)
    for least in sorted(SCHEMES):
        scheme = F.when(run >= least, least).otherwise(scheme) if least else scheme
    return rows.withColumns({"d": d, "scheme": scheme})


def grams(rows: DataFrame) -> DataFrame:
    """A row for each kept gram of each text and scheme of `wanted`, in few columns, as there are many.

    doc_id, gram (mixed with the scheme), who (twice the block, plus is_new), shape (characters and bytes), span (first and
    last place of the gram) and owns; the last three but one hold two numbers of 32 bits.
    """
    schema = StructType([rows.schema["doc_id"], *(StructField(c, LongType()) for c in ("gram", "who", "shape", "span")), StructField("owns", BooleanType())])
    whole = rows.select("doc_id", (F.col("block") * 2 + F.col("is_new")).cast("long").alias("who"), (F.col("size").cast("long") * (1 << 32) + F.col("bytes")).alias("shape"), "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                taken, owns, found, spans = [], [], [], []
                for k, (text, wanted) in enumerate(zip(part.column(3), part.column(4).to_pylist(), strict=True)):
                    raw, seen = text.as_py(), {}
                    for w in wanted:
                        if w["scheme"] not in seen:
                            h, first, last = sampled_grams(raw, *SCHEMES[w["scheme"]])
                            seen[w["scheme"]] = h ^ np.int64(w["scheme"] * 0x632BE59BD9B4E019 % (1 << 63)), (first << 32) | last
                        own = seen[w["scheme"]]
                        taken.append(np.full(len(own[0]), k)), owns.append(np.full(len(own[0]), bool(w["owns"]))), found.append(own[0]), spans.append(own[1])
                joined = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
                at = pa.array(joined(taken, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(joined(found, np.int64)), part.column(1).take(at), part.column(2).take(at), pa.array(joined(spans, np.int64)), pa.array(joined(owns, bool))], schema.names)

    return whole.mapInArrow(run, schema)


def near_pairs(rest: DataFrame, threshold: float) -> DataFrame:
    """doc_id, old_block, new_block, distance and ratio of the pairs of `rest` (see left_over) with a ratio of at most the threshold.

    Of a pair the text with more bytes says how many edits there may be, and so which scheme finds it; the other one has its
    grams under every scheme that such texts of its document use, if it can be as long as one of them.
    """
    rows = with_bound(rest.where("text <> ''").withColumns({"size": F.length("text"), "bytes": F.octet_length("text")}), threshold)
    owners = rows.where("d > 0")
    used = owners.groupBy("doc_id", (1 - F.col("is_new")).alias("is_new"), "scheme").agg(F.min(F.col("size") - F.col("d")).alias("low"), F.max(F.col("size") + F.col("d")).alias("high"), F.max("bytes").alias("most"))
    used = used.groupBy("doc_id", "is_new").agg(F.collect_list(F.struct("scheme", "low", "high", "most")).alias("used"))  # as many as there are schemes
    fit = F.filter("used", lambda u: (u["low"] <= F.col("size")) & (F.col("size") <= u["high"]) & (F.col("bytes") <= u["most"]))
    pick = lambda u, owns: F.struct(F.lit(owns).alias("owns"), u.alias("scheme"))
    guest = F.coalesce(F.transform(fit, lambda u: pick(u["scheme"], 0)), F.array().cast("array<struct<owns:int,scheme:int>>"))
    own = F.when(F.col("d") > 0, F.array(pick(F.col("scheme"), 1))).otherwise(F.array().cast("array<struct<owns:int,scheme:int>>"))
    rows = rows.join(used, ["doc_id", "is_new"], "left").withColumn("wanted", F.concat(own, guest)).where(F.size("wanted") > 0)
    every = shared_table(grams(rows), "grams")
    key, packed = ["doc_id", "gram"], ["who", "shape", "span"]
    longer, shorter = every.where("owns").select(*key, *packed), every.where("not owns").select(*key, *(F.col(c).alias(f"other_{c}") for c in packed))
    # packed rows are shuffled, and unpacked where they meet
    field = lambda c, k: F.shiftright(c, 32).cast("int") if k == 0 else F.col(c).bitwiseAND((1 << 32) - 1).cast("int")
    own = [field("shape", 0).alias("size"), field("shape", 1).alias("bytes"), field("span", 0).alias("first"), field("span", 1).alias("last"), F.shiftright("who", 1).alias("block"), F.col("who").bitwiseAND(1).alias("is_new")]
    other = [field("other_shape", 0).alias("other_size"), field("other_shape", 1).alias("other_bytes"), field("other_span", 0).alias("other_first"), field("other_span", 1).alias("other_last"), F.shiftright("other_who", 1).alias("other_block"), F.col("other_who").bitwiseAND(1).alias("other_is_new")]
    meet = longer.join(shorter, key).select("doc_id", *own, *other).withColumn("d", F.floor(F.col("bytes") * threshold + 1e-9).cast("int"))
    near = (F.col("is_new") != F.col("other_is_new")) & (F.col("bytes") >= F.col("other_bytes")) & (F.abs(F.col("size") - F.col("other_size")) <= F.col("d")) & (F.col("first") - F.col("d") <= F.col("other_last")) & (F.col("other_first") <= F.col("last") + F.col("d"))
    side = lambda k: F.when(F.col("is_new") == k, F.col("block")).otherwise(F.col("other_block"))
    met = meet.where(near).select("doc_id", side(0).alias("old_block"), side(1).alias("new_block")).distinct()
    text = lambda k, name: rest.where(F.col("is_new") == k).select("doc_id", F.col("block").alias(f"{name}_block"), F.col("text").alias(f"{name}_text"))
    both = met.join(text(0, "old"), ["doc_id", "old_block"]).join(text(1, "new"), ["doc_id", "new_block"])
    size = F.greatest(F.octet_length("old_text"), F.octet_length("new_text"))
    parts = with_differing_parts(both.select("doc_id", "old_block", "new_block", size.alias("size"), "old_text", "new_text"))
    # one more than the threshold allows, so that rounding loses no pair; the ratio decides, once each distance is stored
    distance = F.call_function("levenshtein", F.col("old_part"), F.col("new_part"), F.floor(F.col("size") * threshold).cast("int") + 1)
    measured = shared_table(parts.select("doc_id", "old_block", "new_block", "size", distance.cast("long").alias("distance")), "pairs")
    out = measured.where("distance >= 0").withColumn("ratio", F.col("distance") / F.col("size")).where(F.col("ratio") <= threshold).drop("size")
    drop_table(every)
    return out


def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs of which neither node is among the taken ones."""
    return rows.join(taken.select("doc_id", "old_block"), ["doc_id", "old_block"], "left_anti").join(taken.select("doc_id", "new_block"), ["doc_id", "new_block"], "left_anti")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs that are taken best first, by ratio, then block, each node once.

    A pair that is the best of both of its nodes is taken whatever the others are, so the first rounds go by node. What they
    leave is sorted by Spark and read as a stream, document by document.
    """
    rank = F.struct("ratio", "old_block", "new_block")
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        best = lambda side: F.min(rank).over(Window.partitionBy("doc_id", side))
        marked = pairs.withColumns({"rank": rank, "of_old": best("old_block")}).withColumn("of_new", best("new_block"))
        done.append(shared_table(marked.where("rank = of_old and rank = of_new").select("doc_id", "old_block", "new_block", "distance"), "taken"))
        before = pairs
        pairs = shared_table(without(pairs, done[-1]), "pairs")
        drop_table(before)
        if pairs.isEmpty():
            break
    else:
        schema = StructType([pairs.schema[c] for c in ("doc_id", "old_block", "new_block", "distance")])
        sorted_pairs = pairs.select("doc_id", "old_block", "new_block", "distance", "ratio").repartition("doc_id").sortWithinPartitions("doc_id", "ratio", "old_block", "new_block")
        done.append(shared_table(sorted_pairs.mapInArrow(best_first, schema), "taken"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fuzzy(old: DataFrame, new: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Matches of what exact() leaves on either side, whatever its length or script: doc_id, old_block, new_block, distance.

    A match is a mutual best pair by ratio, then block; rounds of mutual bests on what is left are repeated until none is
    added. A document's pairs taken best first are the same pairs: the first one left is always a mutual best, and taking
    one changes no other. So pairs of a lower ratio can be found and taken before those of a higher one are looked for.
    """
    return fuzzy_of(shared_table(left_over(old, new), "left-over"), threshold)


def fuzzy_of(rest: DataFrame, threshold: float) -> DataFrame:
    """fuzzy() of the nodes that are left over."""
    found: list[DataFrame] = []
    for tier in (*(t for t in TIERS if t < threshold), threshold):
        found.append(one_to_one(near_pairs(rest, tier)))
        if tier < threshold:
            sides = [found[-1].select("doc_id", F.col(f"{name}_block").alias("block"), F.lit(k).alias("is_new")) for k, name in enumerate(("old", "new"))]
            before = rest
            rest = shared_table(rest.join(sides[0].unionByName(sides[1]), ["doc_id", "block", "is_new"], "left_anti").select(*rest.columns), "left-over")
            drop_table(before)
            if rest.where("is_new = 0").isEmpty() or rest.where("is_new = 1").isEmpty():
                break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
