"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and name -> the same result as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import anchors, annotations, corpus, diff, discover, index, merge, nodes, provenance, render, search, structure
from quillstone.sources.stored import shared_folder, shared_table
from quillstone.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NORM = r"(CASE WHEN regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\s\p{{Z}}]+$', '') = '' THEN '' ELSE regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\s\p{{Z}}]+$', '') || chr(10) END)"
TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
BLOCKS = r"blocks AS (SELECT doc_id, i AS block, l[i] AS text FROM (SELECT doc_id, list_filter(string_split(" + NORM.format("text") + r", chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
SENTENCES = BLOCKS + r""", parts AS (SELECT doc_id, block, regexp_extract_all(text, '[^.!?]+[.!?]*\s*|[.!?]+\s*') AS s FROM blocks),
sentences AS (SELECT *, char_end - octet_length(encode(text)) AS char_start FROM (SELECT doc_id, block, n, s[n] AS text, sum(octet_length(encode(s[n]))) OVER (PARTITION BY doc_id, block ORDER BY n)::BIGINT AS char_end FROM parts, unnest(range(1, len(s) + 1)) AS u(n)))"""
EDITED = BLOCKS + ", edited AS (SELECT doc_id, block, CASE WHEN block % 5 = 0 THEN text || ' x' ELSE text END AS text FROM blocks WHERE block % 7 <> 0)"
HASHED = EDITED + ", a AS (SELECT doc_id, block AS old_block, h, row_number() OVER (PARTITION BY doc_id, h ORDER BY block) AS occ FROM (SELECT *, sha256(" + TRIM.format("text") + ") AS h FROM blocks)), b AS (SELECT doc_id, block AS new_block, h, row_number() OVER (PARTITION BY doc_id, h ORDER BY block) AS occ FROM (SELECT *, sha256(" + TRIM.format("text") + ") AS h FROM edited)), d AS (SELECT doc_id, old_block, new_block, CASE WHEN old_block IS NULL THEN 'new' WHEN new_block IS NULL THEN 'deleted' ELSE 'kept' END AS status FROM a FULL JOIN b USING (doc_id, h, occ))"
PHRASE = ["of", "the"]
FREQUENCY = r"tok AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM blocks), f AS (SELECT doc_id, block, len(t) AS len, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))::BIGINT AS frequency FROM tok)"
QUOTED = "q AS (SELECT doc_id, item_id, d.text, b.text AS quote, strpos(d.text, b.text) - 1 AS pos FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


#: The time that queries take for now, so that their rows are the same on every run.
NOW = "timestamp '2026-01-01 00:00:00'"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(table(spark, sf_dir, "documents"))


def edited(blocks: DataFrame) -> DataFrame:
    """A second version: every seventh block is gone, every fifth has two more characters."""
    return blocks.where("block % 7 <> 0").withColumn("text", F.when(F.col("block") % 5 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))


@query("SELECT doc_id, sha256(text) AS raw_hash, sha256(" + NORM.format("text") + ") AS norm_hash, sha256(" + TRIM.format("text") + ") AS structural_hash FROM documents")
def normalize_hash(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", F.sha2(t, 256).alias("raw_hash"), F.sha2(T.normalize_text(t), 256).alias("norm_hash"), T.structural_hash(t).alias("structural_hash"))


KNOWN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.FORMATS.items())


@query(rf"SELECT page_id, CASE lower(regexp_extract(p, '\.([^./]+)$', 1)) {KNOWN} END AS format FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)")
def detect_format(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.detect_format(F.regexp_replace("url", "[?#].*$", "")).alias("format"))


@query(f"WITH {BLOCKS} SELECT doc_id, block, 1000.0::DOUBLE * block AS position, text FROM blocks")
def block_nodes(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("doc_id", "block", (F.col("block") * 1000.0).alias("position"), "text")


@query(f"WITH {SENTENCES} SELECT doc_id, block, n, char_start, char_end, text FROM sentences")
def sentence_nodes(spark, sf_dir):
    return structure.sentences(blocks_of(spark, sf_dir))


@query(f"WITH {SENTENCES} SELECT sha256({TRIM.format('text')}) AS hash, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM sentences GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def dup_sentences(spark, sf_dir):
    """Flagship: sentences that occur in several documents. Hashes as bytes, not texts, are shuffled; copies in a document first."""
    rows = blocks_of(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.SENTENCE), 0)).alias("text"))
    once = rows.groupBy(F.unhex(T.structural_hash(F.col("text"))).alias("h"), "doc_id").agg(F.count("*").alias("n"))
    found = once.groupBy("h").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).where("n_docs > 1")
    return found.select(F.lower(F.hex("h")).alias("hash"), "n_docs", "n")


@query(f"WITH {BLOCKS} SELECT doc_id, sha256({TRIM.format('text')}) AS hash, count(*) AS n FROM blocks GROUP BY ALL HAVING count(*) > 1")
def node_by_hash(spark, sf_dir):
    return blocks_of(spark, sf_dir).groupBy("doc_id", T.structural_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")


HEADINGS = r"heads AS (SELECT page_id, p AS position, x[p][3]::INT AS level, regexp_replace(regexp_replace(x[p], '(?s)^<h[1-6][^>]*>|</h[1-6]>$', '', 'g'), '<[^>]*>', '', 'g') AS title FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>') AS x FROM pages), unnest(range(1, len(x) + 1)) AS u(p))"


@query(f"WITH {HEADINGS} SELECT page_id, position, level, title FROM heads")
def html_headings(spark, sf_dir):
    return structure.headings(table(spark, sf_dir, "pages"))


@query(f"WITH {HEADINGS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY position) AS n, coalesce(level, 1) AS level, title FROM heads")
def toc(spark, sf_dir):
    rows = structure.headings(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("position")).cast("long").alias("n"), F.coalesce("level", F.lit(1)).alias("level"), "title")


@query(f"WITH {BLOCKS}, l AS (SELECT doc_id, block, (1 + block % 3)::INT AS level FROM blocks), c1 AS (SELECT *, sum((level = 1)::BIGINT) OVER (PARTITION BY doc_id ORDER BY block) AS a FROM l), c2 AS (SELECT *, sum((level = 2)::BIGINT) OVER (PARTITION BY doc_id, a ORDER BY block) AS b FROM c1), c3 AS (SELECT *, sum((level = 3)::BIGINT) OVER (PARTITION BY doc_id, a, b ORDER BY block) AS c FROM c2) SELECT doc_id, block, level, CASE level WHEN 1 THEN a::VARCHAR WHEN 2 THEN a || '.' || b ELSE a || '.' || b || '.' || c END AS section_path FROM c3")
def section_path(spark, sf_dir):
    rows = blocks_of(spark, sf_dir).select("doc_id", "block", (F.lit(1) + F.col("block") % 3).cast("int").alias("level"))
    return structure.section_path(rows, "doc_id", "block", "level")


@query(f"WITH {BLOCKS} SELECT lang, source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars, max(length(text)) AS longest FROM blocks JOIN documents USING (doc_id) GROUP BY ALL".replace("sum(length(text))", "sum(length(blocks.text))").replace("max(length(text))", "max(length(blocks.text))::INT"))
def corpus_overview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(T.normalize_text(F.col("text")), "\n"), lambda x: x.rlike(r"\S"))
    rows = d.select("lang", "source", F.posexplode(lines).alias("p", "x"))
    # a document's first block stands for it, so nothing has to be counted apart
    return rows.groupBy("lang", "source").agg(F.count_if(F.col("p") == 0).alias("n_docs"), F.count("*").alias("n_blocks"), F.sum(F.length("x")).alias("n_chars"), F.max(F.length("x")).alias("longest"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(DISTINCT block) AS n_blocks, count(*) AS n_sentences, max(char_end) AS longest_block FROM sentences GROUP BY doc_id")
def doc_stats(spark, sf_dir):
    rows = structure.sentences(blocks_of(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("n") == 1).alias("n_blocks"), F.count("*").alias("n_sentences"), F.max("char_end").alias("longest_block"))


@query("SELECT conv_id, turn, role, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id, row_number() OVER w AS ordinal FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return structure.neighbours(rows, "conv_id", ["turn"], "turn")


@query("SELECT conv_id, count(*) AS n_children, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS children FROM conversations GROUP BY conv_id")
def children(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("name"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_children"), structure.ordered_text("name", "turn", ",").alias("children"))


@query("SELECT a.conv_id, a.turn, b.turn AS sibling FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn")
def siblings(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return a.join(a.select("conv_id", F.col("turn").alias("sibling")), "conv_id").where("turn <> sibling")


@query(f"WITH {SENTENCES} SELECT doc_id || '/' || block || '/' || n AS node, doc_id || '/' || block AS parent, doc_id::VARCHAR AS root FROM sentences")
def ancestors(spark, sf_dir):
    rows = structure.sentences(blocks_of(spark, sf_dir))
    return rows.select(F.concat_ws("/", "doc_id", "block", "n").alias("node"), F.concat_ws("/", "doc_id", "block").alias("parent"), F.col("doc_id").cast("string").alias("root"))


@query(f"WITH {SENTENCES} SELECT s.doc_id, s.block, n, decode(encode(b.text)[char_start + 1 : char_end]) AS text FROM sentences s JOIN blocks b ON s.doc_id = b.doc_id AND s.block = b.block".replace("decode(encode(b.text)[char_start + 1 : char_end])", "s.text"))
def load_sentence(spark, sf_dir):
    """Each sentence, cut out of its parent's text by its byte span."""
    b = blocks_of(spark, sf_dir)
    s = structure.sentences(b).drop("text")
    return s.join(b, ["doc_id", "block"]).select("doc_id", "block", "n", T.byte_slice(F.col("text"), F.col("char_start").cast("int"), F.col("char_end").cast("int")).alias("text"))


@query(f"WITH {HASHED} SELECT * FROM d")
def diff_exact(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return diff.exact(b, edited(b))


@query(f"WITH {HASHED} SELECT doc_id, old_block FROM d WHERE status = 'deleted'")
def diff_deleted(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return diff.exact(b, edited(b)).where("status = 'deleted'").select("doc_id", "old_block")


@query(f"WITH {HASHED} SELECT doc_id, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'new') AS added, count(*) FILTER (status = 'deleted') AS deleted FROM d GROUP BY doc_id")
def diff_summary(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    count = lambda s: F.count_if(F.col("status") == s)
    return diff.exact(b, edited(b)).groupBy("doc_id").agg(count("kept").alias("kept"), count("new").alias("added"), count("deleted").alias("deleted"))


@query()
def diff_fuzzy(spark, sf_dir):
    """No SQL twin: repeated rounds on what is left, by characters, are beyond it; tests hold it against brute force."""
    b = blocks_of(spark, sf_dir)
    return diff.fuzzy(b, edited(b))


@query(f"WITH {BLOCKS}, {FREQUENCY} SELECT doc_id, block, frequency FROM f WHERE frequency > 0")
def search_phrase(spark, sf_dir):
    rows = blocks_of(spark, sf_dir)
    return rows.select("doc_id", "block", search.phrase_frequency(T.tokens(F.col("text")), PHRASE).alias("frequency")).where("frequency > 0")


BM25 = "s AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (frequency > 0) AS df FROM f), scored AS (SELECT doc_id, block, frequency, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (frequency * 2.2) / (frequency + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS score FROM f, s WHERE frequency > 0)"


@query(f"WITH {BLOCKS}, {FREQUENCY}, {BM25} SELECT * FROM scored ORDER BY score, doc_id, block LIMIT 50")
def bm25_topk(spark, sf_dir):
    rows = search.bm25(blocks_of(spark, sf_dir), "text", PHRASE)
    return rows.select("doc_id", "block", "frequency", "score").orderBy("score", "doc_id", "block").limit(50)


@query(f"WITH {BLOCKS}, {FREQUENCY}, {BM25} SELECT * FROM scored WHERE doc_id = (SELECT min(doc_id) FROM scored)")
def search_doc_scoped(spark, sf_dir):
    """The hits in one document: the first that has any. Its scope does not change the scores."""
    hits = search.bm25(blocks_of(spark, sf_dir), "text", PHRASE).select("doc_id", "block", "frequency", "score")
    return hits.join(F.broadcast(hits.agg(F.min("doc_id").alias("doc_id"))), "doc_id", "left_semi")


#: A control character after each character between words lets neighbouring phrases share what lies between them.
HIGHLIGHT = r"SELECT doc_id, replace(regexp_replace(regexp_replace(text, '([^\p{L}\p{N}])', '\1' || chr(1), 'g'), '(?i)(^|\x01)(of(?:[^\p{L}\p{N}\x01]\x01)+the)($|[^\p{L}\p{N}])', '\1<mark>\2</mark>\3', 'g'), chr(1), '') AS marked FROM documents"


@query(f"SELECT * FROM ({HIGHLIGHT}) WHERE contains(marked, '<mark>')")
def highlight(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text"), search.highlight(F.col("text"), PHRASE).alias("marked")).where("marked <> text").drop("text")


#: In capitals; what stands for two letters there goes, as engines differ in it.
CAPITALS = HIGHLIGHT.replace("regexp_replace(regexp_replace(text,", "regexp_replace(regexp_replace(upper(replace(text, 'ß', '')),").replace(r"(of(?:[^\p{L}\p{N}\x01]\x01)+the)", "(für)")


@query(f"SELECT * FROM ({CAPITALS}) WHERE contains(marked, '<mark>')")
def highlight_letters(spark, sf_dir):
    """A word with a letter beyond ASCII, looked for in texts in capitals."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.replace("text", F.lit("ß"), F.lit(""))).alias("text"))
    return d.withColumn("marked", search.highlight(F.col("text"), ["für"])).where("marked <> text").drop("text")


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the place of its first character."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = search.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), passages)
    return found.withColumn("at", (F.expr("instr(text, quote)") - 1).cast("int"))


@query(f"WITH {QUOTED} SELECT doc_id, item_id, pos::INT AS char_start, (pos + length(quote))::INT AS char_end FROM q")
def anchor_quote(spark, sf_dir):
    return quoted(spark, sf_dir).select("doc_id", "item_id", F.col("at").alias("char_start"), (F.col("at") + F.length("quote")).alias("char_end"))


NOW_TEXT = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '#' || text ELSE replace(text, quote, '') END"


@query(f"WITH {QUOTED}, n AS (SELECT *, {NOW_TEXT} AS now FROM q) SELECT doc_id, item_id, CASE WHEN substr(now, pos + 1, length(quote)) = quote THEN 'active' WHEN contains(now, quote) THEN 'active_partial' ELSE 'orphan' END AS status FROM n")
def anchor_status(spark, sf_dir):
    """Status of the quotes against an edited text: unchanged, shifted by one character, or with the quote removed."""
    rows = quoted(spark, sf_dir)
    now = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("#"), "text")).otherwise(F.replace("text", "quote", F.lit("")))
    return rows.select("doc_id", "item_id", anchors.anchor_status(now, F.col("at"), F.col("at") + F.length("quote"), F.col("quote")).alias("status"))


@query(f"WITH {QUOTED} SELECT doc_id, item_id, substr(text, greatest(pos - 31, 1), least(pos, 32)) AS prefix, substr(text, pos + length(quote) + 1, 32) AS suffix FROM q")
def quote_context(spark, sf_dir):
    q = quoted(spark, sf_dir)
    return q.select("doc_id", "item_id", F.substring("text", F.greatest(F.col("at") - 31, F.lit(1)), F.least("at", F.lit(32))).alias("prefix"), F.substring("text", F.col("at") + F.length("quote") + 1, F.lit(32)).alias("suffix"))


@query("SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)")
def annotations_for_doc(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def annotation_landscape(spark, sf_dir):
    held = table(spark, sf_dir, "labels").select(F.col("quality").alias("motivation"), F.col("toxic").alias("status"))
    return discover.landscape(held).withColumnsRenamed({"motivation": "quality", "status": "toxic"})


@query("SELECT l.doc_id, 'orphan' AS status FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 7 <> 0)")
def orphaned_annotations(spark, sf_dir):
    held = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("target_id"), F.lit("active").alias("status"))
    deleted = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("node_id"))
    return annotations.orphaned(held, deleted).where("status = 'orphan'").select("doc_id", "status")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def open_questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


EDGES = f"{QUOTED}, edges AS (SELECT doc_id AS source_id, item_id AS target_id, 'quotes' AS predicate, (doc_id % 3)::INT AS version_at_include, 'live' AS status FROM q), versions AS (SELECT item_id AS target_id, (item_id % 3)::INT AS version FROM benchmark)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quoted(spark, sf_dir)
    return q.select(F.col("doc_id").alias("source_id"), F.col("item_id").alias("target_id"), F.lit("quotes").alias("predicate"), (F.col("doc_id") % 3).cast("int").alias("version_at_include"), F.lit("live").alias("status"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), (F.col("item_id") % 3).cast("int").alias("version"))


@query(f"WITH {EDGES} SELECT source_id, count(*) AS n FROM edges GROUP BY source_id")
def edges_by_source(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT target_id, count(*) AS n FROM edges GROUP BY target_id")
def edges_by_target(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("target_id").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT source_id, target_id, version_at_include, version FROM edges JOIN versions USING (target_id) WHERE version_at_include < version")
def stale_edges(spark, sf_dir):
    return anchors.stale(edges(spark, sf_dir), versions(spark, sf_dir)).select("source_id", "target_id", "version_at_include", "version")


@query(f"WITH {EDGES} SELECT source_id, target_id, CASE WHEN version_at_include < version THEN 'stale' ELSE status END AS status FROM edges JOIN versions USING (target_id)")
def refresh_edges(spark, sf_dir):
    held = versions(spark, sf_dir).select(F.col("target_id").alias("node_id"), "version", F.lit("active").alias("status"))
    return anchors.refreshed(edges(spark, sf_dir), held).select("source_id", "target_id", "status")


@query(f"WITH {EDGES} SELECT source, target_id, predicate, count(*) AS n FROM edges JOIN documents ON doc_id = source_id GROUP BY ALL")
def relationship_graph(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source")
    linked = edges(spark, sf_dir).join(d, "source_id").select(F.col("source").alias("source_doc"), F.col("target_id").alias("target_doc"), "predicate", "status")
    return discover.relationships(linked).select(F.col("source_doc").alias("source"), F.col("target_doc").alias("target_id"), "predicate", "n")


CYCLES = "WITH RECURSIVE e AS (SELECT item_id AS a, (item_id * 3 + 1) % 10 AS b FROM benchmark WHERE item_id < 10), walk AS (SELECT a, b, 1 AS depth FROM e UNION ALL SELECT w.a, e.b, w.depth + 1 FROM walk w JOIN e ON w.b = e.a WHERE w.depth < 10) SELECT a AS node, min(depth) AS length FROM walk WHERE a = b GROUP BY a"


@query(CYCLES)
def edge_cycles(spark, sf_dir):
    """Items on a cycle, and the length of the shortest one, over all edges: quotes, and the example edges of all items.

    Documents and items have ids of their own, so a node's kind is part of it; the edges of items are derived, as no table
    holds any. No edge leads to a document, so only items can be on a cycle.
    """
    i = F.col("item_id")
    node = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("id"))
    quotes = edges(spark, sf_dir).select(node("document", F.col("source_id")).alias("source_id"), node("item", F.col("target_id")).alias("target_id"))
    items = table(spark, sf_dir, "benchmark").select(node("item", i).alias("source_id"), node("item", (i * 3 + 1) % 10).alias("target_id"))
    return anchors.cycles(quotes.unionByName(items)).select(F.col("node.id").alias("node"), "length")


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def activities_filter(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.col("event_id").alias("activity_id"), F.col("ts").alias("started_at"), "user_id", F.col("event_type").alias("activity_type"))
    return provenance.query(done, activity="click", limit=100).withColumnsRenamed({"activity_id": "event_id", "started_at": "ts", "activity_type": "event_type"})


NUMBERED = f"{SENTENCES}, numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, n) AS k, text FROM sentences)"


@query(f"WITH {NUMBERED} SELECT doc_id, string_agg('§' || k || ' ' || text, '' ORDER BY k) AS marked FROM numbered GROUP BY doc_id")
def markers(spark, sf_dir):
    """A document's sentences with their numbers, joined in the row."""
    rows = structure.document_sentences(table(spark, sf_dir, "documents")).where(F.size("s") > 0)
    numbered = F.transform("s", lambda x, k: F.concat(F.lit("§"), (k + 1).cast("string"), F.lit(" "), x))
    return rows.select("doc_id", F.array_join(numbered, "").alias("marked"))


@query(f"WITH {NUMBERED} SELECT doc_id, k AS marker, sha256({TRIM.format('text')}) AS hash FROM numbered")
def marker_map(spark, sf_dir):
    rows = structure.document_sentences(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode("s").alias("p", "x"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("marker"), T.structural_hash(F.col("x")).alias("hash"))


@query(f"WITH {BLOCKS} SELECT doc_id, string_agg(text, chr(10) ORDER BY block) AS body FROM blocks GROUP BY doc_id")
def project_plain(spark, sf_dir):
    """A document's blocks as text; the array keeps their order, so the projection needs no shuffle."""
    lines = F.filter(F.split(T.normalize_text(F.col("text")), "\n"), lambda x: x.rlike(r"\S"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).where(F.size("l") > 0).select("doc_id", F.array_join("l", "\n").alias("body"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, count(*) AS n_events FROM events GROUP BY user_id")
def coalesce_changes(spark, sf_dir):
    return changes.coalesce_changes(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("WITH g AS (SELECT event_id, ts, ts::DATE AS day, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 120000000)::INT, 1) AS x FROM events WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts, event_id)) SELECT event_id, day, sum(x) OVER (PARTITION BY day ORDER BY ts, event_id)::BIGINT AS batch FROM g")
def debounce_batches(spark, sf_dir):
    return changes.debounce(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 120).select("event_id", "day", "batch")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def changed_only(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("p", F.lag("event_type").over(w)).where("p is null or p <> event_type").select("event_id", "user_id", "event_type")


def paragraph_nodes(blocks: DataFrame, version: int = 1) -> DataFrame:
    """Blocks as paragraph nodes right below their document, in the columns of the node table."""
    number = (F.col("block") - 1).cast("int")
    identity = merge.shaped(F.sha2(F.concat_ws("/", "doc_id", "block"), 256))
    return blocks.select(
        "doc_id", identity.alias("node_id"), merge.shaped(F.sha2(F.col("doc_id").cast("string"), 256)).alias("parent_id"), F.array(number).alias("path"), F.lit("paragraph").alias("node_type"),
        (F.col("block") * 1000.0).alias("position"), "text", T.structural_hash(F.col("text")).alias("structural_hash"), F.lit(True).alias("has_content"), F.lit(version).alias("version"), F.lit("active").alias("status"),
    )


def page_nodes(spark: SparkSession, sf_dir: str, ast: bool = False) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return nodes.accepted(nodes.segment(pages, "page_id", F.col("html"), F.lit("html"), "uax29", ast=ast)).withColumnRenamed("doc_id", "page_id")


@query()
def md_nodes(spark, sf_dir):
    """Documents read as Markdown: the node table."""
    found = nodes.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.col("text"), F.lit("markdown"), "uax29", ast=False)
    return nodes.accepted(found).select("doc_id", "node_id", "parent_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "node_type", "position", "text", "char_start", "char_end", "level")


@query()
def html_nodes(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("page_id", "node_id", "parent_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "node_type", "position", "text", "char_start", "char_end", "level")


@query(f"WITH {HEADINGS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY position) AS n, level, replace(replace(replace(replace(trim(title), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS title FROM heads")
def tree_headings(spark, sf_dir):
    """Headings of the pages' trees, in order."""
    rows = page_nodes(spark, sf_dir).where("node_type = 'heading'")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("position")).cast("long")
    return rows.select("page_id", order.alias("n"), "level", F.col("text").alias("title"))


@query()
def node_counts(spark, sf_dir):
    """Nodes and sentences of each page, and the identities in order of position."""
    rows = page_nodes(spark, sf_dir)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"])
    return rows.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node_type") == "sentence").alias("n_sentences"), F.to_json(ids).alias("output_ids"))


@query()
def inline_spans(spark, sf_dir):
    return nodes.inline_spans(page_nodes(spark, sf_dir, True).withColumnRenamed("page_id", "doc_id")).withColumnRenamed("doc_id", "page_id")


@query()
def render_markdown(spark, sf_dir):
    return render.project(page_nodes(spark, sf_dir, True).withColumnRenamed("page_id", "doc_id"), "markdown").select(F.col("doc_id").alias("page_id"), "text")


@query()
def render_marked(spark, sf_dir):
    rows = render.project(page_nodes(spark, sf_dir, True).withColumnRenamed("page_id", "doc_id"), "plain", True)
    return rows.select(F.col("doc_id").alias("page_id"), "text", F.size("marker_map").cast("long").alias("n_markers"))


@query()
def diff_merge(spark, sf_dir):
    """The second version merged into the first: identities, versions and what became of each node."""
    b = blocks_of(spark, sf_dir)
    return merge.merge(paragraph_nodes(b), paragraph_nodes(edited(b)).drop("version", "status")).select("doc_id", "node_id", "position", "version", "status", "outcome")


@query()
def diff_sequential(spark, sf_dir):
    """The same match in a document's order, each node taking the first equal or else the closest free one; one task a document."""
    b = blocks_of(spark, sf_dir)
    return merge.pairs(paragraph_nodes(b), paragraph_nodes(edited(b)), mode="sequential").select("doc_id", "old_block", "new_block", "outcome")


@query(f"WITH {HASHED}, s AS (SELECT doc_id, count(*) FILTER (status = 'kept') AS n_kept FROM d GROUP BY doc_id), o AS (SELECT doc_id, count(*) AS n_before FROM blocks GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS n_now FROM edited GROUP BY doc_id) SELECT doc_id, n_kept, n_before, n_now FROM s JOIN o USING (doc_id) JOIN e USING (doc_id)")
def merge_counts(spark, sf_dir):
    """Nodes of each document that keep their text are those of the exact diff; with updated and new ones they are its new version, with updated and deleted ones the old one."""
    b = blocks_of(spark, sf_dir)
    found = merge.counts(merge.merge(paragraph_nodes(b), paragraph_nodes(edited(b)).drop("version", "status")))
    same = F.col("n_kept") + F.col("n_updated")
    return found.select("doc_id", "n_kept", (same + F.col("n_deleted")).alias("n_before"), (same + F.col("n_new")).alias("n_now")).where("n_now > 0")


@query(f"WITH {EDITED} SELECT o.doc_id, o.block, coalesce(e.text, o.text) AS text, CASE WHEN e.doc_id IS NULL THEN 1 ELSE 2 END AS version FROM blocks o LEFT JOIN edited e ON o.doc_id = e.doc_id AND o.block = e.block")
def upsert_nodes(spark, sf_dir):
    """The second version's rows in place of the first one's, by key; rows that it lacks stay."""
    key = lambda x, v: x.select(F.struct("doc_id", "block").alias("node_id"), "text", F.lit(v).alias("version"))
    b = blocks_of(spark, sf_dir)
    return corpus.upsert(key(b, 1), key(edited(b), 2), "node_id").select("node_id.doc_id", "node_id.block", "text", "version")


@query(f"WITH {EDITED}, v AS (SELECT o.doc_id, o.block, e.text AS now, o.text AS was FROM blocks o JOIN edited e ON o.doc_id = e.doc_id AND o.block = e.block) SELECT doc_id, block, CASE WHEN now = was THEN 1 ELSE 2 END AS version FROM v")
def version_bump(spark, sf_dir):
    """Versions of the blocks that are in both versions: raised where the text is another one."""
    b = blocks_of(spark, sf_dir)
    both = b.select("doc_id", "block", F.col("text").alias("was")).join(edited(b), ["doc_id", "block"])
    return both.select("doc_id", "block", F.when(F.col("text") == F.col("was"), 1).otherwise(2).alias("version"))


@query()
def search_query(spark, sf_dir):
    """A user's query over stems: the 50 best sentences, with the phrase marked."""
    rows = structure.sentences(blocks_of(spark, sf_dir))
    held = rows.select("doc_id", F.concat_ws("/", "doc_id", "block", "n").alias("node_id"), F.lit("sentence").alias("node_type"), F.lit("active").alias("status"), "text")
    return search.snippets(search.search(search.build_index(held), '"Of the'), held, '"Of the')


QUOTES = "pos >= 0 AND quote <> ''"


@query(f"WITH {QUOTED} SELECT doc_id, item_id, octet_length(encode(substr(text, 1, pos)))::BIGINT AS char_start, (octet_length(encode(substr(text, 1, pos))) + octet_length(encode(quote)))::BIGINT AS char_end, quote AS exact, 'commenting' AS motivation FROM q WHERE {QUOTES}")
def annotate_quotes(spark, sf_dir):
    """An annotation for each benchmark passage in a document; byte spans, as the requests' own quotes say."""
    requests, held = quote_requests(spark, sf_dir)
    made, _ = annotations.annotate(requests, held, F.expr(NOW))
    return made.select("doc_id", F.get_json_object("body", "$.value").cast("long").alias("item_id"), "char_start", "char_end", "exact", "motivation")


def quote_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests for the passages that documents quote, and those documents as nodes."""
    q = shared_table(quoted(spark, sf_dir).select("doc_id", "item_id", "text", "quote"), "quotes")
    node = F.col("doc_id").cast("string")
    requests = q.select(F.concat_ws("/", "doc_id", "item_id").alias("request_id"), "doc_id", node.alias("node_id"), "quote", F.col("item_id").cast("string").alias("body"), F.lit(None).cast("string").alias("motivation"))
    return requests, q.groupBy("doc_id").agg(F.first("text").alias("text")).select("doc_id", node.alias("node_id"), "text", F.lit(1).alias("version"))


@query()
def resolve_quotes(spark, sf_dir):
    """The annotations found again in edited documents: status, byte span and confidence."""
    requests, held = quote_requests(spark, sf_dir)
    made, _ = annotations.annotate(requests, held, F.expr(NOW))
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("#"), "text")).otherwise(F.lower("text"))
    return annotations.resolve(made, held.withColumns({"text": text, "status": F.lit("active")}))


#: The accepted predicates, as the twin states them; requests go through them and two that are none.
VALID = ("transcludes", "cites", "derives-from", "references", "extends", "refutes", "translates", "summarizes")
ASKED = (*VALID, "likes", "derives_from")
ENDS = f"""{QUOTED}, asked AS (SELECT doc_id AS source_id, CASE WHEN item_id % 5 = 0 THEN -1 ELSE item_id END AS target_id, [{", ".join(f"'{p}'" for p in ASKED)}][1 + doc_id % {len(ASKED)}] AS predicate FROM q)"""


@query(f"WITH {ENDS} SELECT source_id, target_id, predicate, CASE WHEN predicate NOT IN ({", ".join(f"'{p}'" for p in VALID)}) THEN 'INVALID_PREDICATE' WHEN target_id = -1 THEN 'NODE_NOT_FOUND' END AS error FROM asked")
def create_edges(spark, sf_dir):
    """Edges that requests ask for, accepted (no error) and rejected; a fifth of the targets are no nodes, a fifth of the predicates are none."""
    q = quoted(spark, sf_dir)
    asked = q.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("i"), F.when(F.col("item_id") % 5 == 0, -1).otherwise(F.col("item_id")).cast("string")).alias("target_id"), F.get(F.array(*map(F.lit, ASKED)), (F.col("doc_id") % len(ASKED)).cast("int")).alias("predicate"))
    made, bad = anchors.create(asked, edge_nodes(spark, sf_dir), F.expr(NOW))
    rows = made.select("source_id", "target_id", "predicate", F.lit(None).cast("string").alias("error")).unionByName(bad)
    number = lambda c: F.expr(f"cast(substring({c}, 2) as bigint)").alias(c)
    return rows.select(number("source_id"), number("target_id"), "predicate", "error")


def edge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items as nodes; every third item is deleted, and items differ in version."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("documents").alias("doc_id"), F.lit(1).alias("version"), F.lit("active").alias("status"))
    i = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("node_id"), F.lit("benchmark").alias("doc_id"), (F.col("item_id") % 4).cast("int").alias("version"), F.when(F.col("item_id") % 3 == 0, "deleted").otherwise("active").alias("status"))
    return d.unionByName(i)


@query(f"WITH {QUOTED} SELECT doc_id AS source_id, item_id AS target_id, CASE WHEN item_id % 3 = 0 THEN 'orphaned' WHEN item_id % 4 > doc_id % 3 THEN 'stale' ELSE 'live' END AS status FROM q")
def orphaned_edges(spark, sf_dir):
    """Edges with their present status: orphaned where the target is deleted, else stale where it is newer."""
    q = quoted(spark, sf_dir)
    held = q.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("target_id"), (F.col("doc_id") % 3).cast("int").alias("version_at_include"), F.lit("live").alias("status"))
    number = lambda c: F.expr(f"cast(substring({c}, 2) as bigint)").alias(c)
    return anchors.refreshed(held, edge_nodes(spark, sf_dir)).select(number("source_id"), number("target_id"), "status")


@query("SELECT conv_id, 'ingest' AS activity_type, count(*) AS n_outputs, string_agg(conv_id || '/' || turn, ',' ORDER BY turn) AS outputs FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def activity_log(spark, sf_dir):
    """One activity for each conversation that was taken in, with its turns as outputs."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("doc_id"), F.concat_ws("/", "conv_id", "turn").alias("node_id"), F.col("turn").cast("double").alias("position"))
    rows = provenance.log(spark, "ingest", c.select("doc_id"), c, "quillstone", provenance.config_json("plain", True, merge.THRESHOLD), F.expr(NOW))
    return rows.select(F.col("input_ids")[0].cast("long").alias("conv_id"), "activity_type", F.size("output_ids").cast("long").alias("n_outputs"), F.array_join("output_ids", ",").alias("outputs"))


@query("WITH g AS (SELECT event_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 120000000)::INT, 1) AS x FROM events WINDOW w AS (ORDER BY ts, event_id)) SELECT event_id, sum(x) OVER (ORDER BY ts, event_id)::BIGINT AS batch FROM g")
def debounce_log(spark, sf_dir):
    """Quiet-gap batches over the whole log: midnight ends none."""
    return changes.debounced(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 120).select("event_id", "batch")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'removed' END AS kind FROM events")
def classify_changes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "modify").when(F.col("event_type") == "purchase", "remove").otherwise("access")
    return table(spark, sf_dir, "events").select("event_id", changes.classify(kind).alias("kind"))


@query(f"WITH {BLOCKS} SELECT d.doc_id, sha256(d.text) AS import_hash, count(b.block) AS n_blocks FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id WHERE d.doc_id % 3 <> 0 GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """Documents as a stream, taken in batch by batch; those whose content is known already (every third) are passed over."""
    d = table(spark, sf_dir, "documents")
    content = lambda x: x.select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text", F.sha2("text", 256).alias("import_hash"))
    known = shared_table(content(d.where("doc_id % 3 = 0")).select("path", "import_hash"), "known")
    place = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"

    def sink(batch: DataFrame, number: int) -> None:
        new = changes.unchanged_dropped(content(batch), known)
        lines = F.filter(F.split(T.normalize_text(F.col("text")), "\n"), lambda x: x.rlike(r"\S"))
        new.select("doc_id", "import_hash", F.size(lines).cast("long").alias("n_blocks")).write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    # the brackets make a pattern of the name, so that it may be a file or a folder of files
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/documents[.]parquet")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows").drop("batch")


#: Fixed values of the two queries on live feeds: the gap and lateness of sessions in microseconds, and a path's life in seconds.
QUIET_US, LATE_US, STAT_LIFE = 6 * 3600 * 1_000_000, 600 * 1_000_000, 90 * 86400


def run_stream(rows: DataFrame, place: str) -> None:
    """Run a stream over all that is there, into Parquet, with its log and state beside it."""
    rows.writeStream.format("parquet").outputMode("append").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH g AS (SELECT user_id, epoch_us(ts) AS us, (coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 0) >= {QUIET_US})::INT AS x FROM events WHERE ts IS NOT NULL), n AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY us) AS n FROM g), s AS (SELECT user_id, n, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM n GROUP BY ALL) SELECT user_id, first_us, last_us, n_events FROM s WHERE last_us + {QUIET_US} - 1 <= (SELECT max(us) // 1000 * 1000 - {LATE_US} FROM g)")
def stream_sessions(spark, sf_dir):
    """Quiet-gap batches of each user's events as a live stream gives them: those that the watermark has closed."""
    place = f"{shared_folder(spark)}/sessions-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    feed = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events[.]parquet")
    run_stream(changes.sessions(feed, "user_id", "ts", QUIET_US / 1_000_000, LATE_US // 1_000_000), place)
    return spark.read.parquet(f"{place}/rows").select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n_events")


@query("WITH p AS (SELECT user_id, least((day(ts) - 1) // 10, 2) AS poll, arg_max(octet_length(encode(event_type)), (epoch_us(ts), octet_length(encode(event_type)))) AS length, max(epoch_us(ts)) AS seen_us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL), c AS (SELECT *, lag(length) OVER (PARTITION BY user_id ORDER BY poll) AS known FROM p) SELECT 'user/' || user_id AS path, length::BIGINT AS length, seen_us FROM c WHERE known IS NULL OR known <> length")
def stream_changed_stats(spark, sf_dir):
    """Users as files whose sizes are polled three times: the sizes that are not the known ones. Each poll restarts the stream from its checkpoint."""
    place = f"{shared_folder(spark)}/stats-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    stats = table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id").alias("path"), F.octet_length("event_type").cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), F.col("ts").cast("timestamp").alias("seen"))
    poll = F.least(F.floor((F.dayofmonth("seen") - 1) / 10), F.lit(2))
    for k in range(3):
        stats.where(poll == k).write.mode("append").parquet(f"{place}/polls")
        run_stream(changes.changed_stats(spark.readStream.schema(stats.schema).parquet(f"{place}/polls"), STAT_LIFE), place)
    return spark.read.parquet(f"{place}/rows").select("path", "length", F.unix_micros("seen").alias("seen_us"))


@query(rf"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'custom' ELSE CASE lower(regexp_extract(p, '\.([^./]+)$', 1)) {KNOWN} END END AS format FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)")
def detect_explicit(spark, sf_dir):
    """A name that is given wins: an alias is resolved, an unknown one passes through."""
    given = F.when(F.col("page_id") % 3 == 0, "MKD").when(F.col("page_id") % 3 == 1, "Custom")
    return table(spark, sf_dir, "pages").select("page_id", T.detect_format(F.regexp_replace("url", "[?#].*$", ""), given).alias("format"))


@query("SELECT doc_id, sha256(text) AS import_hash, " + NORM.format("text") + " AS normalized, CASE WHEN " + TRIM.format("text") + " = '' THEN 'EMPTY_DOCUMENT' END AS error FROM documents")
def prepare_input(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("import_hash"), T.normalize_text(t).alias("normalized"), F.when(T.trim_white(t) == "", "EMPTY_DOCUMENT").alias("error"))


@query(f"WITH {EDITED} SELECT o.doc_id, o.block, coalesce(e.text, o.text) AS text, CASE WHEN e.doc_id IS NULL THEN 1 ELSE 2 END AS version FROM blocks o LEFT JOIN edited e ON o.doc_id = e.doc_id AND o.block = e.block")
def corpus_versions(spark, sf_dir):
    """Two versions committed to a corpus on disk, and its last one read back."""
    store = stored_corpus(spark, "corpus")
    b = blocks_of(spark, sf_dir)
    key = lambda x, v: x.select(F.concat_ws("/", "doc_id", "block").alias("node_id"), "doc_id", "block", "text", F.lit(v).alias("version"))
    store.commit({"nodes": key(b, 1)})
    store.commit({"nodes": key(edited(b), 2)})
    return store.table("nodes").drop("node_id")


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source})::VARCHAR AS line FROM documents")
def ndjson_out(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"}).alias("line"))


@query()
def json_nodes(spark, sf_dir):
    """The trees of pages as converters' JSON, read back as documents of that format."""
    whole = render.project(page_nodes(spark, sf_dir, True).withColumnRenamed("page_id", "doc_id"), "json")
    found = nodes.segment(whole.select("doc_id", "text"), "doc_id", F.col("text"), F.lit("json"), "uax29", ast=False)
    return nodes.accepted(found).select(F.col("doc_id").alias("page_id"), "node_type", "position", "text")


@query()
def convert_batch(spark, sf_dir):
    """Pages under formats that fit, do not fit and are not known: how many nodes each gives, or its error."""
    kind = F.when(F.col("page_id") % 4 == 0, "json").when(F.col("page_id") % 4 == 1, F.lit(None)).when(F.col("page_id") % 4 == 2, "markdown").otherwise("html")
    found = nodes.segment(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", F.col("html"), kind, ast=False)
    return found.groupBy(F.col("doc_id").alias("page_id"), "error").agg(F.count("node_id").alias("n_nodes"))


@query()
def reconcile_quotes(spark, sf_dir):
    """Byte spans of quoted passages with up to 64 bytes of context on either side, cut at words."""
    requests, held = quote_requests(spark, sf_dir)
    made, _ = annotations.annotate(requests, held, F.expr(NOW))
    return made.select("doc_id", "char_start", "char_end", "exact", "prefix", "suffix")


@query()
def read_brief(spark, sf_dir):
    """Each page as numbered sentences, with a note on the first one."""
    rows = page_nodes(spark, sf_dir).withColumnRenamed("page_id", "doc_id").withColumns({"status": F.lit("active"), "version": F.lit(1)})
    first = rows.where("node_type = 'sentence'").groupBy("doc_id").agg(F.min_by("node_id", "position").alias("node_id"))
    requests = first.select(F.col("node_id").alias("request_id"), "doc_id", "node_id", F.lit(None).cast("string").alias("quote"), F.lit("first").alias("body"), F.lit(None).cast("string").alias("motivation"))
    made, _ = annotations.annotate(requests, rows, F.expr(NOW))
    return discover.brief(rows, made).withColumnRenamed("doc_id", "page_id")


@query()
def node_ancestors(spark, sf_dir):
    """Ancestors of every sentence of the pages, up to the document."""
    rows = page_nodes(spark, sf_dir).withColumnRenamed("page_id", "doc_id")
    return provenance.ancestors(rows, rows.where("node_type = 'sentence'").select("node_id"))


@query()
def topic_clusters(spark, sf_dir):
    return discover.clusters(table(spark, sf_dir, "documents"), "text", 8).groupBy("cluster").agg(F.count("*").alias("n_docs"))


def stored_corpus(spark: SparkSession, tag: str) -> corpus.Corpus:
    return corpus.Corpus(spark, f"{shared_folder(spark)}/{tag}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}")


def block_rows(blocks: DataFrame) -> DataFrame:
    """Blocks as active nodes to be indexed."""
    return blocks.select("doc_id", F.concat_ws("/", "doc_id", "block").alias("node_id"), F.lit("block").alias("node_type"), F.lit("active").alias("status"), "text")


#: The twins take words without marks; words whose stems are those of the phrase are stated, and a node's length is its number of words.
INDEXED = r"""tok AS (SELECT doc_id, block, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS t FROM {0}), f AS (SELECT doc_id, block, len(t) AS len, len(list_filter(range(1, len(t)), lambda i: t[i] IN ('of', 'ofs', 'ofe', 'ofes', 'ofed', 'ofing') AND t[i + 1] IN ('the', 'thes')))::BIGINT AS frequency FROM tok)"""
BEST = f"{BM25} SELECT doc_id, block, frequency, score FROM scored ORDER BY score, doc_id, doc_id || '/' || block LIMIT 50"


def with_block(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.substring_index("node_id", "/", -1).cast("long").alias("block"), "frequency", "score")


@query(f"WITH {BLOCKS}, {INDEXED.format('blocks')}, {BEST}")
def index_search(spark, sf_dir):
    """The best blocks for a phrase, from an index that is stored first and then read by the phrase's terms alone."""
    one = index.StoredIndex(stored_corpus(spark, "index"))
    one.rebuild(block_rows(blocks_of(spark, sf_dir)))
    return with_block(one.search("of the"))


NOW_BLOCKS = "now AS (SELECT b.doc_id, b.block, CASE WHEN b.block % 7 = 0 THEN 'of the ' || b.text ELSE coalesce(e.text, b.text) END AS text FROM blocks b LEFT JOIN edited e ON b.doc_id = e.doc_id AND b.block = e.block)"


@query(f"WITH {EDITED}, {NOW_BLOCKS}, {INDEXED.format('now')}, {BEST}")
def index_after_edit(spark, sf_dir):
    """The same after a second commit, which has postings of the changed blocks and tombstones for what they held before."""
    one = index.StoredIndex(stored_corpus(spark, "index"))
    b = blocks_of(spark, sf_dir)
    one.rebuild(block_rows(b))
    now = F.when(F.col("block") % 7 == 0, F.concat(F.lit("of the "), "text")).when(F.col("block") % 5 == 0, F.concat("text", F.lit(" x")))
    changed = b.withColumn("now", now).where("now is not null")
    one.update(block_rows(changed.withColumn("text", F.col("now"))), block_rows(changed))
    return with_block(one.search("of the"))


@query(r"WITH " + BLOCKS + r", tok AS (SELECT doc_id, block, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM blocks), f AS (SELECT doc_id, block, len(t) AS len, len(list_filter(t, lambda x: x IN ('und', 'unde', 'unds', 'undes', 'unded', 'unding')))::BIGINT AS frequency FROM tok), " + BEST.replace("LIMIT 50", "LIMIT 20"))
def index_top_term(spark, sf_dir):
    """The best blocks for one term: only the blocks of postings that can beat the twentieth are read."""
    one = index.StoredIndex(stored_corpus(spark, "index"))
    one.rebuild(block_rows(blocks_of(spark, sf_dir)))
    return with_block(one.search("und", k=20))


def two_versions(spark: SparkSession, sf_dir: str) -> corpus.Corpus:
    """The blocks as nodes of a stored corpus, and the edited ones as a second commit."""
    store = stored_corpus(spark, "corpus")
    b = blocks_of(spark, sf_dir)
    key = lambda x, v: x.select(F.concat_ws("/", "doc_id", "block").alias("node_id"), "doc_id", F.col("doc_id").cast("string").alias("parent_id"), "block", "text", F.lit(v).alias("version"))
    store.commit({"nodes": key(b, 1)})
    store.commit({"nodes": key(edited(b), 2)})
    return store


SECOND = "second AS (SELECT o.doc_id, o.block, coalesce(e.text, o.text) AS text, CASE WHEN e.doc_id IS NULL THEN 1 ELSE 2 END AS version FROM blocks o LEFT JOIN edited e ON o.doc_id = e.doc_id AND o.block = e.block)"
LONGEST = "(SELECT arg_max(doc_id, (n, doc_id)) FROM (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id))"


@query(f"WITH {EDITED}, {SECOND} SELECT doc_id, block, text, version FROM second WHERE doc_id = {LONGEST}")
def lookup_document(spark, sf_dir):
    """The nodes of one document, the one with the most blocks: one bucket of each run of a stored corpus is read."""
    longest = blocks_of(spark, sf_dir).agg(F.max_by("doc_id", F.struct("block", "doc_id")).alias("d")).first()["d"]
    return two_versions(spark, sf_dir).of_document("nodes", longest).select("doc_id", "block", "text", "version")


@query(f"WITH {EDITED}, {SECOND} SELECT doc_id || '/' || block AS node_id, text FROM second WHERE doc_id = {LONGEST} AND block > 1")
def lookup_children(spark, sf_dir):
    """The later siblings of a document's first node, which is found by its own id first."""
    longest = blocks_of(spark, sf_dir).agg(F.max_by("doc_id", F.struct("block", "doc_id")).alias("d")).first()["d"]
    store = two_versions(spark, sf_dir)
    first = store.by_key("nodes", "node_id", f"{longest}/1").first()
    return store.of_document("nodes", first["doc_id"]).where((F.col("parent_id") == first["parent_id"]) & (F.col("block") > first["block"])).select("node_id", "text")


@query(f"WITH {BLOCKS} SELECT doc_id, block, text || repeat('!', ((doc_id + block) % 9)::INT) AS text, ((doc_id + block) % 9)::INT AS version FROM blocks")
def corpus_levels(spark, sf_dir):
    """Nine commits, each of which edits some of the blocks again; runs are merged on the way and the last rows read."""
    store = stored_corpus(spark, "corpus")
    b = blocks_of(spark, sf_dir).withColumn("last", ((F.col("doc_id") + F.col("block")) % 9).cast("int"))
    for v in range(9):
        text = F.concat("text", F.repeat(F.lit("!"), F.lit(v)))
        store.commit({"nodes": b.where(F.col("last") >= v).select(F.concat_ws("/", "doc_id", "block").alias("node_id"), "doc_id", "block", text.alias("text"), F.lit(v).alias("version"))})
    return store.table("nodes").drop("node_id")


@query(f"WITH {QUOTED}, n AS (SELECT *, {NOW_TEXT} AS now FROM q), t AS (SELECT doc_id, item_id, quote, CASE WHEN substr(now, pos + 1, length(quote)) = quote THEN 'active' WHEN contains(now, quote) THEN 'active_partial' ELSE 'orphan' END AS status FROM n) SELECT doc_id || '/' || item_id AS annotation_id, doc_id, item_id AS target_id, quote AS exact, status FROM t WHERE status <> 'active'")
def lost_annotations(spark, sf_dir):
    """Quotes that an edit of their document moved or removed."""
    status = anchor_status(spark, sf_dir)
    held = status.join(quoted(spark, sf_dir).select("doc_id", "item_id", "quote"), ["doc_id", "item_id"])
    return discover.open_questions(held.select(F.concat_ws("/", "doc_id", "item_id").alias("annotation_id"), "doc_id", F.col("item_id").alias("target_id"), F.col("quote").alias("exact"), "status"))


@query(f"WITH {BLOCKS}, h AS (SELECT doc_id, block, item_id, l.text, b.text AS quote FROM blocks l JOIN benchmark b ON b.text <> '' AND contains(l.text, b.text)), m AS (SELECT DISTINCT doc_id, block, 'x ' || text AS text, (block + block % 4) * 1000.0 + 500 AS position, doc_id || '/' || block || '/new' AS node_id FROM h), r AS (SELECT h.doc_id, h.block, h.item_id, h.quote, m.text, m.node_id, row_number() OVER (PARTITION BY h.doc_id, h.block, h.item_id ORDER BY abs(m.position - h.block * 1000.0), m.position, m.node_id) AS k FROM h JOIN m ON m.doc_id = h.doc_id AND contains(m.text, h.quote)) SELECT doc_id || '/' || block || '/' || item_id AS annotation_id, node_id AS new_target, octet_length(encode(substr(text, 1, strpos(text, quote) - 1)))::BIGINT AS new_start, (octet_length(encode(substr(text, 1, strpos(text, quote) - 1))) + octet_length(encode(quote)))::BIGINT AS new_end, 0.6::DOUBLE AS confidence FROM r WHERE k = 1")
def reanchor_moved(spark, sf_dir):
    """Quotes whose block went away, found in the nearest block that has them now; the document's other blocks stay."""
    number = (F.col("block") * 1000).cast("double")
    held = shared_table(blocks_of(spark, sf_dir).select("doc_id", "block", F.concat_ws("/", "doc_id", "block").alias("node_id"), "text", number.alias("position")), "blocks")
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = shared_table(search.containing(held.select(F.col("node_id").alias("doc_id"), "text"), passages).select(F.col("doc_id").alias("node_id"), "item_id", "quote"), "hits")
    gone = held.join(hits.select("node_id").distinct(), "node_id", "left_semi")
    put = gone.withColumns({"node_id": F.concat("node_id", F.lit("/new")), "text": F.concat(F.lit("x "), "text"), "position": (F.col("block") + F.col("block") % 4) * 1000.0 + 500})
    rest = held.join(hits.select("node_id").distinct(), "node_id", "left_anti")
    after = gone.withColumn("status", F.lit("deleted")).unionByName(put.unionByName(rest).withColumn("status", F.lit("active"))).withColumns({"node_type": F.lit("paragraph"), "version": F.lit(2)})
    none = F.lit(None).cast("string")
    lost = hits.join(held.select("node_id", "doc_id"), "node_id").select(F.concat_ws("/", "node_id", "item_id").alias("annotation_id"), "doc_id", F.col("node_id").alias("target_id"), F.col("quote").alias("exact"), none.alias("prefix"), none.alias("suffix"))
    return annotations.moved(lost, after).drop("new_version")


@query(f"WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) SELECT lang AS format, count(*) AS n_docs, coalesce(sum(n + 1), 0)::BIGINT AS n_nodes, coalesce(sum(length(text)) FILTER (n IS NOT NULL), 0)::BIGINT AS n_chars FROM documents LEFT JOIN n USING (doc_id) GROUP BY lang")
def format_overview(spark, sf_dir):
    """Documents by language as a workspace shows them: how many, their nodes and the characters of their roots."""
    d = table(spark, sf_dir, "documents")
    b = blocks_of(spark, sf_dir)
    node = lambda x, path: x.select("doc_id", F.lit("active").alias("status"), path.alias("path"), "text")
    roots = node(d.join(b.select("doc_id").distinct(), "doc_id", "left_semi"), F.array().cast("array<int>"))
    held = node(b, F.array(F.col("block").cast("int"))).unionByName(roots)
    return discover.overview(d.select("doc_id", F.col("lang").alias("format"), F.expr(NOW).alias("ingested_at")), held).drop("first", "last")


TREE = "SELECT doc_id || '/' || block || '/' || n AS node_id, doc_id || '/' || block AS ancestor_id, 1 AS distance FROM sentences UNION ALL SELECT doc_id || '/' || block || '/' || n, doc_id::VARCHAR, 2 FROM sentences"


@query(f"WITH {SENTENCES} {TREE}")
def sentence_ancestors(spark, sf_dir):
    """Block and document of every sentence, found by their paths."""
    s = structure.sentences(blocks_of(spark, sf_dir)).select("doc_id", "block", "n")
    number = lambda *c: F.array(*(F.col(x).cast("int") for x in c)).cast("array<int>")
    at = lambda *c: F.concat_ws("/", *c)
    leaves = s.select("doc_id", at("doc_id", "block", "n").alias("node_id"), number("block", "n").alias("path"))
    inner = s.select("doc_id", "block").distinct().select("doc_id", at("doc_id", "block").alias("node_id"), number("block").alias("path"))
    roots = s.select("doc_id").distinct().select("doc_id", at("doc_id").alias("node_id"), number().alias("path"))
    return provenance.ancestors(leaves.unionByName(inner).unionByName(roots), leaves)


@query(f"WITH {EDGES}, most AS (SELECT arg_max(source_id, (n, source_id)) AS s FROM (SELECT source_id, count(*) AS n FROM edges GROUP BY source_id)), often AS (SELECT arg_max(target_id, (n, target_id)) AS t FROM (SELECT target_id, count(*) AS n FROM edges GROUP BY target_id)) SELECT source_id, target_id, 'out' AS side FROM edges, most WHERE source_id = s UNION ALL SELECT source_id, target_id, 'in' FROM edges, often WHERE target_id = t")
def edges_of_node(spark, sf_dir):
    """The edges out of the document that quotes most, and into the passage that is quoted most."""
    held = shared_table(edges(spark, sf_dir), "edges")
    top = lambda c: held.groupBy(c).agg(F.count("*").alias("n")).agg(F.max_by(c, F.struct("n", c)).alias("x")).first()["x"]
    out, into = anchors.by_source(held, top("source_id")), anchors.by_target(held, top("target_id"))
    return out.select("source_id", "target_id", F.lit("out").alias("side")).unionByName(into.select("source_id", "target_id", F.lit("in").alias("side")))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id = (SELECT max(doc_id) FROM labels) AND toxic <> 1")
def annotations_of_document(spark, sf_dir):
    """The labels of the last labelled document as its annotations; toxic ones count as deleted."""
    rows = table(spark, sf_dir, "labels")
    last = rows.agg(F.max("doc_id").alias("d")).first()["d"]
    held = rows.withColumn("status", F.when(F.col("toxic") == 1, "deleted").otherwise("active"))
    return annotations.for_document(held, last).select("doc_id", "quality", "toxic")


ITEM_EDGES = "e AS (SELECT item_id AS a, (item_id * 3 + 1) % (SELECT count(*) FROM benchmark) AS b FROM benchmark UNION SELECT item_id, item_id // 2 FROM benchmark WHERE item_id % 5 = 0)"


def item_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example edges between benchmark items, as no table holds any; every fifth item has two."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    n = items.count()
    one = items.select(F.col("item_id").alias("source_id"), ((F.col("item_id") * 3 + 1) % n).alias("target_id"))
    return one.unionByName(items.where("item_id % 5 = 0").select(F.col("item_id").alias("source_id"), F.floor(F.col("item_id") / 2).alias("target_id")))


@query(f"WITH RECURSIVE {ITEM_EDGES}, reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT r.a AS node, max(r.b) AS component, count(DISTINCT r.b) AS size FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a")
def edge_components(spark, sf_dir):
    """Strongly connected items: each leads to every other of its component."""
    return anchors.components(item_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {QUOTED}, {ITEM_EDGES}, ties AS (SELECT 'd' || doc_id AS child, 'i' || item_id AS parent FROM q UNION SELECT 'i' || a, 'i' || b FROM e WHERE a <> b), walk AS (SELECT child, parent AS ancestor, 1 AS depth FROM ties WHERE child[1] = 'd' UNION SELECT w.child, t.parent, w.depth + 1 FROM walk w JOIN ties t ON t.child = w.ancestor WHERE w.depth < (SELECT count(*) + 1 FROM benchmark)) SELECT child, ancestor, min(depth)::INT AS depth FROM walk GROUP BY child, ancestor")
def provenance_chain(spark, sf_dir):
    """What each quoting document comes from, over activities whose outputs are the inputs of others, however many lie between."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    made = edges(spark, sf_dir).select(F.array(name("i", "target_id")).alias("input_ids"), F.array(name("d", "source_id")).alias("output_ids"))
    made = made.unionByName(item_edges(spark, sf_dir).select(F.array(name("i", "target_id")).alias("input_ids"), F.array(name("i", "source_id")).alias("output_ids")))
    ties = provenance.links(made)
    return provenance.lineage(ties, ties.where("child like 'd%'").select("child"))


@query(f"WITH {SENTENCES}, o AS (SELECT doc_id, block, unnest(range(0, octet_length(encode(text)), 97)) AS place FROM blocks) SELECT doc_id || '/' || block AS node_id, place AS \"offset\", n::INT AS n, place - char_start AS inside FROM o JOIN sentences USING (doc_id, block) WHERE char_start <= place AND place < char_end")
def span_at_offset(spark, sf_dir):
    """The sentence that holds each ninety-seventh byte of every block."""
    b = blocks_of(spark, sf_dir)
    node = F.concat_ws("/", "doc_id", "block").alias("node_id")
    spans = structure.sentences(b).select(node, F.col("char_start").cast("long").alias("flat_start"), F.col("char_end").cast("long").alias("flat_end"), F.col("n").cast("int").alias("n"))
    asked = b.select(node, F.explode(F.sequence(F.lit(0).cast("long"), (F.octet_length("text") - 1).cast("long"), F.lit(97).cast("long"))).alias("offset"))
    return nodes.at_offset(spans, asked, ("n",))
