"""Phrase search with BM25 over sentences or blocks, by plain words or by stems, and over a stored index."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.functions import stemming
from quillstone.functions import text as T
from quillstone.sources.stored import shared_table

#: What a search returns when no number is given.
MOST_HITS = 50


def phrase_frequency(tokens: Column, phrase: list[str]) -> Column:
    """Occurrences of consecutive tokens, overlapping ones included.

    Each token gets a space of its own on either side, and a look-ahead counts where the phrase starts. This is evaluated
    once for a row in the scan, so a search needs no posting list and no join.
    """
    padded = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.regexp_count(padded, F.lit("(?= " + "  ".join(phrase) + " )")).cast("long")


def bm25(nodes: DataFrame, text: str, phrase: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """All rows with the phrase and their score (lower is better). Corpus statistics are one partial aggregate."""
    rows = nodes.withColumn("__t", T.tokens(F.col(text)))
    return scored(rows.withColumns({"__len": F.size("__t"), "__f": phrase_frequency(F.col("__t"), phrase)}).drop("__t"), k1, b)


def scored(rows: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows with __len and __f (words, and how often the phrase is there) to those with the phrase, frequency and score.

    The texts are read once: the hits are stored, and the corpus statistics are observed while that is done.
    """
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("__len").alias("avg"), F.count_if(F.col("__f") > 0).alias("df"))
    hits = shared_table(watched.where("__f > 0"), "hits")
    found = seen.get
    one = score(F.col("__f"), F.col("__len"), found["n"] or 0, found["avg"] or 0.0, found["df"] or 0, k1, b)
    return hits.withColumn("score", one).withColumnRenamed("__f", "frequency").drop("__len")


def score(frequency: Column, length: Column, n: int, average: float, df: int, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 with the sign turned: the lower, the better. `n` nodes have `average` words, and `df` of them hold the phrase."""
    idf = F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5)), F.lit(1e-6))
    return F.round(-idf * (frequency * (k1 + 1)) / (frequency + k1 * (1 - b + b * length / F.lit(float(average) or 1.0))), 6)


def highlight(text: Column, phrase: list[str]) -> Column:
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + r"[^\p{L}\p{N}]+".join(phrase) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>")


def sanitized(query: str) -> list[str]:
    """A user's query is always one phrase: its terms in order, quotes and operators being no part of a term."""
    return stemming.terms(query)


def with_terms(nodes: DataFrame, text: str, name: str = "terms") -> DataFrame:
    """Add the stemmed terms, joined by blanks. Every other column passes through an Arrow batch untouched."""
    schema = StructType([*nodes.schema.fields, StructField(name, StringType())])
    at = nodes.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [" ".join(stemming.terms(t)) if t else "" for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], schema.names)

    return nodes.mapInArrow(run, schema)


def build_index(nodes: DataFrame) -> DataFrame:
    """What a search reads: doc_id, node_id, node_type, status and terms. Store it beside the nodes; it is made per row."""
    status = "status" if "status" in nodes.columns else F.lit("active").alias("status")
    return with_terms(nodes.select("doc_id", "node_id", "node_type", status, "text"), "text").drop("text")


def update_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the rows of changed nodes in place of their old ones; what did not change is not read as text again."""
    return index.join(changed.select("node_id").distinct(), "node_id", "left_anti").select("doc_id", "node_id", "node_type", "status", "terms").unionByName(build_index(changed))


def search(index: DataFrame, query: str, doc_id: object = None, k: int = MOST_HITS, level: str | None = None, all_statistics: bool = False) -> DataFrame:
    """doc_id, node_id, node_type, frequency and score of the k best active nodes that hold the query as a phrase of stems.

    Number, length and frequency of nodes are taken over the active nodes of the level, or over all rows whatever their
    status and level with `all_statistics`; a document's scope limits the hits, not the statistics. A query without a term
    has no hit; k of 0 or less is the default.
    """
    phrase = sanitized(query)
    active = F.col("status") == "active"
    chosen = active if level is None else active & (F.col("node_type") == level)
    rows = index if all_statistics else index.where(chosen)
    words = F.split("terms", " ")
    size = F.when(F.col("terms") == "", 0).otherwise(F.size(words))
    frequency = phrase_frequency(words, phrase) if phrase else F.lit(0).cast("long")
    hits = scored(rows.withColumns({"__len": size, "__f": frequency}).drop("terms")).where(chosen)
    if doc_id is not None:
        hits = hits.where(F.col("doc_id") == F.lit(doc_id))
    return hits.select("doc_id", "node_id", "node_type", "frequency", "score").orderBy("score", "doc_id", "node_id").limit(k if k > 0 else MOST_HITS)


def marked(text: str, phrase: list[str]) -> str:
    """The text with each run of words whose stems are the phrase between marks; runs do not overlap."""
    spans, n = stemming.term_spans(text), len(phrase)
    out, at, k = [], 0, 0
    while n and k + n <= len(spans):
        if [t for t, _, _ in spans[k : k + n]] == phrase:
            start, end = spans[k][1], spans[k + n - 1][2]
            out += [text[at:start], "<mark>", text[start:end], "</mark>"]
            at, k = end, k + n
        else:
            k += 1
    return "".join([*out, text[at:]])


def snippets(hits: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """Hits with the snippet: the node's text with the phrase marked. There are at most k hits."""
    phrase = sanitized(query)
    rows = hits.join(nodes.select("node_id", "text"), "node_id")
    schema = StructType([*rows.schema.fields[:-1], StructField("snippet", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([marked(t or "", phrase) for t in b.columns[-1].to_pylist()], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


#: Words of the run by which a passage is looked for, and characters where it has too few words.
RUN, LETTERS = 4, 3


def run_keys(rows: DataFrame, words: Column, width: int) -> DataFrame:
    """Add keys, the hashes of each run of `width` words. The words' hashes are a column, so that they are made once a row."""
    rows = rows.withColumn("h", F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform(F.slice("h", 1, F.greatest(F.size("h") - width + 1, F.lit(0))), lambda h, k: F.xxhash64(h, *(F.get("h", k + j) for j in range(1, width))))
    return rows.withColumn("keys", F.when(F.size("h") >= width, runs).otherwise(F.array().cast("array<bigint>"))).drop("h")


def letter_keys(rows: DataFrame, text: str, width: int) -> DataFrame:
    """Add keys, the hashes of each run of `width` characters."""
    last = F.length(text) - width + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.xxhash64(F.lit("letters"), F.substring(text, k, F.lit(width))))
    return rows.withColumn("keys", F.when(last > 0, runs).otherwise(F.array().cast("array<bigint>")))


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, text and quote where a document (doc_id, text) holds a passage (item_id, quote); an empty one is held by none.

    A passage's inner words, without the first and the last, are whole words of the text as well, so a run of them is a
    key; one with too few words goes by its letters. Hashes and ids are joined, and the texts of the candidates are
    fetched once and looked at. Each passage has one key, so no side grows with the other.
    """
    words = T.tokens(F.col("quote"))
    inner = passages.where("quote <> ''").withColumn("inner", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    inner = inner.withColumn("width", F.least(F.size("inner"), F.lit(RUN))).withColumn("letters", F.when(F.col("width") == 0, F.least(F.length("quote"), F.lit(LETTERS))).otherwise(0))
    # a row for each width there is: RUN and LETTERS of them at most
    kinds = [tuple(r) for r in inner.select("width", "letters").distinct().collect()]
    out = None
    for width, letters in sorted(kinds):
        some = inner.where((F.col("width") == width) & (F.col("letters") == letters)).select("item_id", "inner", "quote")
        texts = documents.select("doc_id", "text")
        wanted = run_keys(some, F.col("inner"), width) if width else letter_keys(some, "quote", letters)
        held = run_keys(texts, T.tokens(F.col("text")), width) if width else letter_keys(texts, "text", letters)
        wanted = wanted.select("item_id", F.get("keys", 0).alias("key"))
        found = held.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).join(wanted, "key").select("doc_id", "item_id")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.select("doc_id", F.lit(None).cast(passages.schema["item_id"].dataType).alias("item_id"), "text", F.lit("").alias("quote")).where("false")
    out = out.distinct().join(passages.select("item_id", "quote"), "item_id").join(documents.select("doc_id", "text"), "doc_id")
    return out.where(F.contains("text", "quote")).select("doc_id", "item_id", "text", "quote")
