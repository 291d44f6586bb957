"""Annotations: made from requests, anchored by position and by quote, found again after edits, and their life.

A request names a node and may quote a part of its text. The annotation keeps the quote's byte span and the quote with up
to `CONTEXT` bytes on either side, cut at a word's edge. After an edit a span holds if its text is still the quote; else the
quote is looked for, and of several places the one with more of the context, then the first, is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quillstone.functions import text as T
from quillstone.sources.stored import shared_table

CONTEXT = 64
#: An anchor's states, and the motivation of a request that gives none.
STATUSES = ("active", "active_partial", "orphan", "deleted")
MOTIVATION = "commenting"
#: How sure each way of finding an anchor is.
CONFIDENCE = {"position": 1.0, "quote with context": 0.8, "quote": 0.6, "quote in other white space or case": 0.4}


def prefix_context(before: Column, most: int = CONTEXT) -> Column:
    """The end of a text, at most so many bytes, from a word's edge on."""
    return fitted(F.reverse(before), most, True)


def suffix_context(after: Column, most: int = CONTEXT) -> Column:
    """The start of a text, at most so many bytes, up to a word's edge."""
    return fitted(after, most, False)


def fitted(text: Column, most: int, backwards: bool) -> Column:
    # characters while their bytes fit, then back to the last edge of a word if one was cut
    letters = F.split(F.substring(text, 1, most + 1), "")
    state = F.struct(F.lit("").alias("s"), F.lit(True).alias("open"))
    step = lambda a, c: F.when(a["open"] & (F.octet_length(a["s"]) + F.octet_length(c) <= most), F.struct(F.concat(a["s"], c).alias("s"), F.lit(True).alias("open"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("open")))
    taken = F.aggregate(letters, state, step, lambda a: a["s"])
    rest = F.substring(text, F.length(taken) + 1, F.lit(1))
    inside = rest.rlike(r"^[\p{L}\p{N}]") & taken.rlike(r"[\p{L}\p{N}]$")
    cut = F.when(inside, F.regexp_replace(taken, r"[\p{L}\p{N}]+$", "")).otherwise(taken)
    return F.reverse(cut) if backwards else cut


def reconcile(rows: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Add exact, prefix, suffix and error (EMPTY_SPAN, OUT_OF_RANGE or null) for byte spans of a text."""
    t, a, b = F.col(text), F.col(start).cast("int"), F.col(end).cast("int")
    size = F.octet_length(t)
    error = F.when(a >= b, "EMPTY_SPAN").when(t.isNull() | a.isNull() | b.isNull() | (a < 0) | (b > size), "OUT_OF_RANGE")
    sound = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    return sound.withColumns({
        "exact": F.when(ok, T.byte_slice(t, a, b)),
        "prefix": F.when(ok, prefix_context(T.byte_slice(t, F.lit(0), a))),
        "suffix": F.when(ok, suffix_context(T.byte_slice(t, b, size))),
    })


def annotate(requests: DataFrame, nodes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Annotations and rejects of requests (request_id, doc_id, node_id, and quote, body and motivation or null).

    A node that is not there is SENTENCE_NOT_FOUND, a quote that its text does not hold is QUOTE_NOT_FOUND. Without a quote
    the whole node is the target.
    """
    known = nodes.select("node_id", F.col("text").alias("node_text"), F.col("doc_id").alias("node_doc"), F.col("version").alias("node_version"))
    rows = requests.join(known, "node_id", "left")
    quote = F.coalesce("quote", "node_text")
    error = F.when(F.col("node_doc").isNull() | (F.col("node_doc") != F.col("doc_id")), "SENTENCE_NOT_FOUND").when((quote == "") | ~F.contains("node_text", quote), "QUOTE_NOT_FOUND")
    rows = rows.withColumns({"reject": error, "exact_quote": quote})
    rejects = rows.where("reject is not null").select("request_id", "doc_id", "node_id", F.col("reject").alias("error"))
    good = rows.where("reject is null").drop("reject")
    before = F.expr("substring(node_text, 1, instr(node_text, exact_quote) - 1)")
    good = good.withColumn("char_start", F.octet_length(before).cast("long")).withColumn("char_end", F.col("char_start") + F.octet_length("exact_quote"))
    good = reconcile(good, "node_text", "char_start", "char_end")
    selectors = F.to_json(F.array(
        F.struct(F.lit("TextPositionSelector").alias("type"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit(None).cast("string").alias("exact"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix")),
        F.struct(F.lit("TextQuoteSelector").alias("type"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.col("exact"), F.col("prefix"), F.col("suffix")),
    ))
    made = good.select(
        F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), "node_id", "char_start", "char_end"), 256).alias("annotation_id"),
        "doc_id", F.col("node_id").alias("target_id"), "node_version", "char_start", "char_end", "exact", "prefix", "suffix", selectors.alias("selectors"),
        F.when(F.col("body").isNotNull(), F.to_json(F.struct(F.lit("TextualBody").alias("type"), F.col("body").alias("value"), F.lit("text/plain").alias("format")))).alias("body"),
        F.coalesce("motivation", F.lit(MOTIVATION)).alias("motivation"), F.lit("active").alias("status"), now.alias("created_at"),
    )
    return made, rejects


SELECTORS = "array<struct<type:string,start:bigint,end:bigint,exact:string,prefix:string,suffix:string>>"


def from_selectors(selectors: Column) -> Column:
    """start, end, exact, prefix and suffix out of the JSON of selectors."""
    parts = F.from_json(selectors, SELECTORS)
    pick = lambda kind: F.get(F.filter(parts, lambda s: s["type"] == kind), 0)
    place, quote = pick("TextPositionSelector"), pick("TextQuoteSelector")
    return F.struct(place["start"].alias("start"), place["end"].alias("end"), quote["exact"].alias("exact"), quote["prefix"].alias("prefix"), quote["suffix"].alias("suffix"))


def places(raw: bytes, exact: bytes) -> list[int]:
    """Byte offsets of the occurrences that do not overlap."""
    out, at = [], raw.find(exact) if exact else -1
    while at >= 0:
        out.append(at)
        at = raw.find(exact, at + len(exact))
    return out


def find_quote(text: str, exact: str, prefix: str | None, suffix: str | None) -> tuple[int, int, bool] | None:
    """Span of the quote, and whether the context told it: one point each for prefix and suffix, the first of equals."""
    raw, quote = text.encode(), exact.encode()
    found = places(raw, quote)
    if not found:
        return None
    before, after = (prefix or "").encode(), (suffix or "").encode()
    points = [int(bool(before) and raw.endswith(before, 0, p)) + int(bool(after) and raw.startswith(after, p + len(quote))) for p in found]
    best = max(points)
    p = found[points.index(best)]
    return p, p + len(quote), best > 0


def folded(text: str) -> tuple[str, list[int]]:
    """Lower case with each run of white space as one blank, and the byte offset of every character that stays."""
    out, at, size = [], [], 0
    for c in text:
        low = " " if c.isspace() else c.lower()
        if not (low == " " and out and out[-1] == " "):
            out.append(low[:1] or c)
            at.append(size)
        size += len(c.encode())
    return "".join(out), [*at, size]


def resolved(text: str | None, start: int | None, end: int | None, exact: str | None, prefix: str | None, suffix: str | None) -> tuple[str, int | None, int | None, float]:
    """status, span and confidence of an anchor in a text."""
    if text is None:
        return "orphan", None, None, 0.0
    raw = text.encode()
    if start is not None and end is not None and 0 <= start < end <= len(raw) and (exact is None or raw[start:end] == exact.encode()):
        return "active", start, end, CONFIDENCE["position"]
    if exact:
        found = find_quote(text, exact, prefix, suffix)
        if found:
            return "active_partial", found[0], found[1], CONFIDENCE["quote with context" if found[2] else "quote"]
        low, at = folded(text)
        wanted = folded(exact.strip())[0]
        p = low.find(wanted) if wanted else -1
        if p >= 0:
            return "active_partial", at[p], at[p + len(wanted)], CONFIDENCE["quote in other white space or case"]
    return "orphan", None, None, 0.0


def resolve(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """annotation_id, new_status, new_start, new_end and confidence of the annotations that are not deleted, in the nodes' present text.

    An annotation whose node is gone or deleted is an orphan.
    """
    live = nodes.where("status = 'active'") if "status" in nodes.columns else nodes
    rows = annotations.where("status <> 'deleted'").select("annotation_id", "target_id", "char_start", "char_end", "exact", "prefix", "suffix")
    rows = rows.join(live.select(F.col("node_id").alias("target_id"), F.col("text").alias("now")), "target_id", "left").select("annotation_id", "now", "char_start", "char_end", "exact", "prefix", "suffix")
    schema = StructType([rows.schema["annotation_id"], StructField("new_status", StringType()), StructField("new_start", LongType()), StructField("new_end", LongType()), StructField("confidence", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [resolved(*x) for x in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


#: Words of the runs by which a lost quote meets the texts that may hold it.
RUN = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def runs_of(words: Column, size: Column) -> Column:
    """Hashes of the different runs of `size` words."""
    last = F.size(words) - size + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.when(last > 0, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))


def moved(lost: DataFrame, nodes: DataFrame) -> DataFrame:
    """annotation_id, new_target, new_version, new_start, new_end and confidence of orphans whose quote is in another node now.

    `lost` holds annotations; `nodes` has every node of their documents, the deleted targets too, with node_type, position,
    version and status. Looked into are the active nodes of the target's document and type. The text that `resolved` is
    surest of wins; of its places the one nearest to where the target was, then the earlier one, then the smaller node_id.
    A quote meets texts by the run of its inner words that the fewest texts of the document have; outer words may be cut, so
    a quote of one or two words has to stand there as whole words, and one without any stays lost, as does one whose target
    has no row. Equal quotes and equal texts meet once. Each quote's places are ordered by one task, in sorted runs on disk.
    """
    was = nodes.select(F.col("node_id").alias("target_id"), "node_type", F.col("position").alias("was"))
    quote = ["doc_id", "node_type", "exact", "prefix", "suffix"]
    lost = lost.select("annotation_id", "doc_id", "target_id", "exact", "prefix", "suffix").join(was, "target_id")
    lost = shared_table(lost.withColumn("quote_id", F.sha2(F.to_json(F.struct(*quote)), 256)), "lost")
    words = words_of(F.col("exact"))
    quotes = lost.dropDuplicates(["quote_id"]).select("quote_id", *quote, F.when(F.size(words) >= 3, F.slice(words, 2, F.size(words) - 2)).otherwise(words).alias("inner"))
    quotes = quotes.withColumn("size", F.least(F.size("inner"), F.lit(RUN))).where("size > 0")
    scope = ["doc_id", "node_type"]
    met = [*scope, "size", "key"]
    asked = quotes.select("quote_id", *scope, "size", F.explode(runs_of(F.col("inner"), F.col("size"))).alias("key"))

    live = nodes.where("status = 'active'").join(quotes.groupBy("doc_id").agg(F.collect_set("size").alias("sizes")), "doc_id")
    live = shared_table(live.select(*scope, "node_id", "position", "version", F.sha2("text", 256).alias("text_id"), "text", "sizes"), "live")
    texts = live.dropDuplicates([*scope, "text_id"])
    held = texts.select(*scope, "text_id", words_of(F.col("text")).alias("words"), F.explode("sizes").alias("size"))
    held = held.select(*scope, "text_id", "size", F.explode(runs_of(F.col("words"), F.col("size"))).alias("key"))
    held = shared_table(held.join(asked.select(met).distinct(), met, "left_semi").select("text_id", *met), "runs")
    counted = asked.join(held.groupBy(met).agg(F.count("*").alias("n")), met, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("quote_id", *scope, "size").agg(F.min(F.struct("n", "key")).alias("best")).where("best.n > 0").select("quote_id", *scope, "size", "best.key")
    candidates = rarest.join(held, met).select("quote_id", *scope, "text_id")
    pairs = candidates.join(quotes.select("quote_id", "exact", "prefix", "suffix"), "quote_id").join(texts.select(*scope, "text_id", "text"), [*scope, "text_id"])
    schema = "quote_id string, text_id string, new_start long, new_end long, confidence double"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for quote_id, text_id, text, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                status, start, end, sure = resolved(text, None, None, *rest)
                if status != "orphan":
                    found.append((quote_id, text_id, start, end, sure))
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["quote_id", "text_id", "new_start", "new_end", "confidence"])

    found = shared_table(pairs.select("quote_id", "text_id", "text", "exact", "prefix", "suffix").mapInArrow(verify, schema), "found")
    found = found.join(found.groupBy("quote_id").agg(F.max("confidence").alias("most")), "quote_id").where("confidence = most").drop("most")
    spots = found.join(quotes.select("quote_id", *scope), "quote_id").join(live.select(*scope, "text_id", "node_id", "position", "version"), [*scope, "text_id"])
    spot = F.struct("position", F.col("node_id").alias("new_target"), F.col("version").alias("new_version"), "new_start", "new_end", "confidence").alias("spot")
    line = spots.select("quote_id", "position", "node_id", spot).unionByName(lost.select("quote_id", F.col("was").alias("position"), "annotation_id"), allowMissingColumns=True)
    nearest = lambda position: F.last("spot", ignorenulls=True).over(Window.partitionBy("quote_id").orderBy(position, F.col("annotation_id").isNotNull(), F.desc("node_id")).rowsBetween(Window.unboundedPreceding, 0))
    line = line.select("annotation_id", "position", nearest(F.asc("position")).alias("before"), nearest(F.desc("position")).alias("after")).where("annotation_id is not null")
    earlier = F.col("after").isNull() | (F.col("position") - F.col("before.position") <= F.col("after.position") - F.col("position"))
    return line.select("annotation_id", F.when(earlier, F.col("before")).otherwise(F.col("after")).alias("spot")).where("spot is not null").select("annotation_id", "spot.new_target", "spot.new_version", "spot.new_start", "spot.new_end", "spot.confidence")


def with_place(annotations: DataFrame, found: DataFrame) -> DataFrame:
    """Annotations, those that `moved` found being partly active at their new node and span."""
    both = annotations.join(found, "annotation_id", "left")
    here = F.col("new_target").isNotNull()
    new = {"target_id": F.col("new_target"), "node_version": F.col("new_version"), "char_start": F.col("new_start"), "char_end": F.col("new_end"), "status": F.lit("active_partial")}
    return both.withColumns({name: F.when(here, value).otherwise(F.col(name)).cast(annotations.schema[name].dataType) for name, value in new.items() if name in annotations.columns}).select(annotations.columns)


def is_active(status: Column) -> Column:
    return status.isin("active", "active_partial")


def with_status(annotations: DataFrame, resolution: DataFrame) -> DataFrame:
    """Annotations as resolved: spans move with the text. Orphans stay until their text comes back; deleted ones stay deleted."""
    both = annotations.join(resolution, "annotation_id", "left")
    moved = F.col("new_start").isNotNull()
    both = both.withColumns({"status": F.coalesce("new_status", "status"), "char_start": F.when(moved, F.col("new_start")).otherwise(F.col("char_start")), "char_end": F.when(moved, F.col("new_end")).otherwise(F.col("char_end"))})
    return both.select(annotations.columns)


def orphaned(annotations: DataFrame, deleted: DataFrame) -> DataFrame:
    """Annotations, those that are active and whose target is among the deleted nodes being orphans."""
    gone = deleted.select(F.col("node_id").alias("target_id"), F.lit(True).alias("gone")).distinct()
    both = annotations.join(gone, "target_id", "left")
    return both.withColumn("status", F.when(F.col("gone") & (F.col("status") == "active"), "orphan").otherwise(F.col("status"))).select(annotations.columns)


def removed(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    """Annotations, those with the given ids being deleted; their rows stay."""
    gone = ids.select("annotation_id", F.lit(True).alias("gone")).distinct()
    both = annotations.join(gone, "annotation_id", "left")
    return both.withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status"))).select(annotations.columns)


def for_target(annotations: DataFrame, target_id: str) -> DataFrame:
    return annotations.where((F.col("target_id") == target_id) & (F.col("status") != "deleted"))


def for_document(annotations: DataFrame, doc_id: object) -> DataFrame:
    return annotations.where((F.col("doc_id") == F.lit(doc_id)) & (F.col("status") != "deleted"))
