"""What a corpus holds: overviews, open questions, relations, briefs and clusters. All are single aggregations or joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: What a passage of an answer may be to its source.
DECLARATIONS = ("quotation", "compression", "inference", "composition", "original")


def overview(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """format, n_docs, n_nodes, n_chars, first and last of the documents and their active root texts."""
    sizes = nodes.where("status = 'active'").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.size("path") == 0, F.length("text"))).alias("c"))
    rows = documents.select("doc_id", "format", "ingested_at").join(sizes, "doc_id", "left")
    return rows.groupBy("format").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"), F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"))


def landscape(annotations: DataFrame) -> DataFrame:
    """Annotations by motivation and status, with sums over either."""
    return annotations.cube("motivation", "status").agg(F.count("*").alias("n"))


def open_questions(annotations: DataFrame) -> DataFrame:
    """Annotations that lost their place or found it elsewhere."""
    return annotations.where("status in ('orphan', 'active_partial')").select("annotation_id", "doc_id", "target_id", "exact", "status")


def relationships(edges: DataFrame) -> DataFrame:
    """Edges between documents: how many of each predicate, and how many of them are not live."""
    return edges.groupBy("source_doc", "target_doc", "predicate").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "live").alias("n_open"))


def targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their target's present text; null where it is gone."""
    live = nodes.where("status = 'active'").select(F.col("node_id").alias("target_id"), F.col("text").alias("target_text"), F.col("version").alias("target_version"))
    return edges.join(live, "target_id", "left")


def brief(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """A document to be read: doc_id, n_sentences, n_annotations and its numbered sentences, each followed by its notes."""
    notes = annotations.where("status <> 'deleted'").groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("k"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("["), "motivation", F.lit(": "), F.coalesce("exact", F.lit("")), F.lit("]")))), " ").alias("notes"))
    rows = nodes.where("status = 'active' and node_type = 'sentence'").select("doc_id", "node_id", "position", "text").join(notes, "node_id", "left")
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "node_id", "text", "notes"))).alias("s"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_annotations"))
    shown = F.transform("s", lambda x, n: F.concat(F.lit("§"), (n + 1).cast("string"), F.lit(" "), F.rtrim(x["text"]), F.coalesce(F.concat(F.lit(" "), x["notes"]), F.lit(""))))
    return whole.select("doc_id", F.size("s").cast("long").alias("n_sentences"), "n_annotations", F.array_join(shown, "\n").alias("text"))


def declared(requests: DataFrame, nodes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Declarations and rejects of requests (passage_id, node_id, relation): what a passage of an answer is to a node.

    A relation beyond the list is INVALID_RELATION, and a node that is not there NODE_NOT_FOUND; an original passage needs none.
    """
    rows = requests.join(nodes.select("node_id", F.col("version").alias("node_version")), "node_id", "left")
    error = F.when(~F.coalesce(F.col("relation").isin(*DECLARATIONS), F.lit(False)), "INVALID_RELATION").when((F.col("relation") != "original") & F.col("node_version").isNull(), "NODE_NOT_FOUND")
    rows = rows.withColumns({"error": error, "created_at": now})
    return rows.where("error is null").select("passage_id", "node_id", "relation", "node_version", "created_at"), rows.where("error is not null").select("passage_id", "node_id", "relation", "error")


def clusters(documents: DataFrame, text: str, k: int, features: int = 1 << 12, seed: int = 1) -> DataFrame:
    """doc_id and cluster by k-means over weighted words; the model is `k` rows of `features` numbers, whatever the corpus."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    rows = documents.select("doc_id", T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=features).transform(rows)
    weighed = IDF(inputCol="tf", outputCol="idf").fit(counted).transform(counted)
    scaled = Normalizer(inputCol="idf", outputCol="features").transform(weighed).select("doc_id", "features")
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(scaled).transform(scaled).select("doc_id", "cluster")
