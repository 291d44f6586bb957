"""Documents to nodes: blocks, sentences, headings, section paths and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, block (from 1) and text of each line that is not blank; no shuffle, as order comes from the array."""
    lines = F.filter(F.split(T.normalize_text(F.col("text")), "\n"), lambda x: x.rlike(r"\S"))
    return documents.select("doc_id", F.posexplode(lines).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("block"), "text")


#: Sentences whose ends are summed in one array; longer blocks are summed in such parts.
PART = 128


def running(sizes: Column, start: Column) -> Column:
    """The sums of an array up to each element."""
    return F.aggregate(sizes, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), start) + x)))


def sentences(block_rows: DataFrame) -> DataFrame:
    """Sentence spans of blocks in UTF-8 bytes: doc_id, block, n, char_start, char_end, text. Spans are contiguous.

    Offsets are running sums inside the block's own array, part by part, so nothing is shuffled.
    """
    rows = block_rows.select("doc_id", "block", F.regexp_extract_all("text", F.lit(T.SENTENCE), 0).alias("s"))
    rows = rows.withColumn("z", F.transform("s", lambda x: F.octet_length(x).cast("long")))
    rows = rows.withColumn("z", F.transform(F.sequence(F.lit(0), F.greatest(F.size("z") - 1, F.lit(0)), F.lit(PART)), lambda k: F.slice("z", k + 1, PART)))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("t", running(F.transform("z", lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero))
    rows = rows.withColumn("e", F.flatten(F.transform("z", lambda p, k: running(p, F.coalesce(F.get("t", k - 1), zero)))))
    rows = rows.select("doc_id", "block", F.posexplode(F.arrays_zip("s", "e")).alias("p", "x"))
    return rows.select("doc_id", "block", (F.col("p") + 1).cast("long").alias("n"), (F.col("x.e") - F.octet_length("x.s")).alias("char_start"), F.col("x.e").alias("char_end"), F.col("x.s").alias("text"))


def document_sentences(documents: DataFrame) -> DataFrame:
    """doc_id and s, all sentences of a document in order; the order is the array's, so nothing is shuffled."""
    lines = F.filter(F.split(T.normalize_text(F.col("text")), "\n"), lambda x: x.rlike(r"\S"))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(T.SENTENCE), 0)))
    return documents.select("doc_id", found.alias("s"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, position, level and title of h1 to h6."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>.*?</h[1-6]>"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("p", "x"))
    title = F.regexp_replace(F.regexp_replace("x", r"(?s)^<h[1-6][^>]*>|</h[1-6]>$", ""), "<[^>]*>", "")
    return rows.select("page_id", (F.col("p") + 1).cast("long").alias("position"), F.substring("x", 3, 1).cast("int").alias("level"), title.alias("title"))


def section_path(rows: DataFrame, doc: str, order: str, level: str, deepest: int = 3) -> DataFrame:
    """Dotted numbers: a level's counter starts anew under each heading of a higher level."""
    out, path = rows, None
    for k in range(1, deepest + 1):
        c = f"__c{k}"
        out = out.withColumn(c, F.sum((F.col(level) == k).cast("long")).over(Window.partitionBy(doc, *(f"__c{j}" for j in range(1, k))).orderBy(order)))
        part = F.when(F.col(level) >= k, F.col(c).cast("string"))
        path = part if path is None else F.concat_ws(".", path, part)
    return out.withColumn("section_path", path).drop(*(f"__c{k}" for k in range(1, deepest + 1)))


def neighbours(nodes: DataFrame, parent: str, order: list[str], node: str) -> DataFrame:
    """prev_id, next_id and ordinal among siblings; a node without a parent has no siblings."""
    w = Window.partitionBy(parent).orderBy(*order)
    has = F.col(parent).isNotNull()
    pick = lambda c: F.when(has, c)
    return nodes.withColumns({"prev_id": pick(F.lag(node).over(w)), "next_id": pick(F.lead(node).over(w)), "ordinal": pick(F.row_number().over(w).cast("long"))})


def ordered_text(column: str, order: str, separator: str) -> Column:
    """Aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), separator)
