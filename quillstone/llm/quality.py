"""Quality rules: fixed heuristics and a hashed n-gram log-likelihood ratio, in Spark's own expressions only.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets, one of the trusted
documents and one of the whole corpus, give each bucket a log ratio; a document's score is the mean ratio of its n-grams.
A document is kept if it passes the fixed rules and its score is not below a threshold, which is a low quantile of the
trusted documents' own scores: the rule is the same for every document and involves no chance.

The corpus counts cover every row, and those of the trusted every trusted row, however many there are. Their ids come to
the rows as bitmaps of `BITS` bits an id, so no text is shuffled for them; what a bitmap takes for trusted by chance is found
by a join of ids alone. The quantile of their scores is exact whatever the partitioning; the weights are one array of
`BUCKETS` numbers.

Defined cases: a null text has no words and fails; empty texts likewise; without trusted documents all weights are 0 and
only the fixed rules decide; repeated rows count each; an empty table gives an empty result; other columns pass through or
are ignored, whatever their names. Three-word windows are compared by 64-bit hash within a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import col, shared_table

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: A quarter of a percent of the trusted documents may fall below the threshold, which then goes down by MARGIN.
QUANTILE = 0.0025
MARGIN = 0.1
#: Bits of the bitmaps for each trusted id, of which it sets HASHES: by these about 1 in 400 of the other ids is taken for one.
BITS, HASHES = 16, 4
#: Bits of one bitmap of Spark's bitmap functions.
MAP = 32768
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def with_hashes(rows: DataFrame, words: str) -> DataFrame:
    """Add __one, the hash of each word, and __two, that of each pair of neighbours. Rules and scores share them."""
    rows = rows.withColumn("__one", F.transform(words, lambda w: F.xxhash64(w)))
    pairs = F.transform(F.slice("__one", 1, F.size("__one") - 1), lambda a, i: F.xxhash64(a, F.get("__one", i + 1)))
    return rows.withColumn("__two", F.when(F.size("__one") < 2, F.array().cast("array<bigint>")).otherwise(pairs))


def with_repeat_words(rows: DataFrame, name: str) -> DataFrame:
    """Add the number of words that lie in a three-word window which occurs twice or more.

    Each step is a column that the next one names several times, so that Spark computes it once for a row and not once
    for each element. Sorted by hash, equal windows are neighbours; only documents that repeat one are sorted at all.
    """
    two, h, t, p = F.col("__two"), F.col("__h"), F.col("__t"), F.col("__p")
    hashes = F.transform(F.slice(two, 1, F.size(two) - 1), lambda a, i: F.xxhash64(a, F.get(two, i + 1)))
    rows = rows.withColumn("__h", F.when(F.size(two) < 3, F.array().cast("array<bigint>")).otherwise(hashes))
    tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__t", F.when(F.size(F.array_distinct(h)) < F.size(h), tagged).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twin = lambda x, k: F.coalesce(x["h"] == F.get(t, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(t, k + 1)["h"], F.lit(False))
    rows = rows.withColumn("__p", F.sort_array(F.transform(F.filter(t, twin), lambda x: x["i"])))
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return rows.withColumn(name, F.aggregate(gaps, F.lit(0), lambda n, g: n + g).cast("long"))


def with_rules(rows: DataFrame, text: str, words: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with hashes."""
    whole, w = F.coalesce(F.col(text), F.lit("")), F.col(words)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.withColumn("__lines", lines).withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    out = with_repeat_words(out, "n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def grams() -> Column:
    """Hashes of each word, then of each pair of neighbours."""
    return F.concat("__one", "__two")


def bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def mean_ratio(weights: Column) -> Column:
    total = F.aggregate(grams(), F.lit(0.0), lambda s, x: s + F.get(weights, bucket(x)))
    return F.when(F.size("__one") > 0, total / (2 * F.size("__one") - 1)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class QualityModel:
    """The weights as a JSON array of BUCKETS numbers, which Spark folds into one literal, and the threshold."""

    json: str
    threshold: float

    def weights(self) -> Column:
        return F.from_json(F.lit(self.json), "array<double>")


def exact_quantile(values: DataFrame, name: str, share: float) -> float | None:
    """As F.percentile gives it, but no task holds all values: the least ones up to the share are sorted, and two are fetched."""
    # stored first: a condition would be pushed below what the values are made of, and have it worked out again
    held = shared_table(values.select(name), "scores").where(F.col(name).isNotNull())
    place = share * (held.count() - 1)
    if place < 0:
        return None
    k = int(place)
    found = [r[name] for r in held.orderBy(name).offset(k).limit(2).collect()]
    return found[0] if place == k else (k + 1 - place) * found[0] + (place - k) * found[1]


def with_trusted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Add t: whether __id is among the distinct __trusted of `ids`. Only ids are shuffled, and no list of all of them is broadcast."""
    kind = rows.select("__id").union(ids.select("__trusted")).schema["__id"].dataType
    maps = max(1, -(-ids.count() * BITS // MAP))
    number = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(maps))
    place = lambda c, k: F.pmod(F.xxhash64(F.col(c).cast(kind), F.lit(k)), F.lit(MAP))
    placed = ids.select(number("__trusted").alias("__map"), F.explode(F.array(*(place("__trusted", k) for k in range(HASHES)))).alias("__place"))
    bits = F.broadcast(shared_table(placed.groupBy("__map").agg(F.bitmap_construct_agg("__place").alias("__bits")), "bitmaps"))
    byte = lambda at: F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("__id").isNotNull()
    for k in range(HASHES):
        at = place("__id", k)
        hit = hit & (F.bit_get(byte(at), (at % 8).cast("int")) == 1)
    marked = lambda x: x.join(bits, number("__id") == F.col("__map"), "left").withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__map", "__bits")
    chance = marked(rows.select("__id")).where("__hit").join(ids, F.col("__id") == F.col("__trusted"), "left_anti").select(F.col("__id").alias("__chance")).distinct()
    out = marked(rows).join(F.broadcast(shared_table(chance, "chance")), F.col("__id") == F.col("__chance"), "left")
    return out.withColumn("t", F.col("__hit") & F.col("__chance").isNull()).drop("__hit", "__chance")


def fit(documents: DataFrame, text: str, doc_id: str, trusted: DataFrame) -> QualityModel:
    """Weights from all of `documents` and the trusted ids among them; then the threshold from the trusted scores."""
    spark = documents.sparkSession
    rows = documents.select(col(doc_id).alias("__id"), col(text).alias("__text"))
    chosen = shared_table(trusted.select(col(trusted.columns[0]).alias("__trusted")).where("__trusted is not null").distinct(), "trusted")
    rows = with_trusted(rows, chosen)
    marked = rows.select(word_array(F.col("__text")).alias("__words"), F.col("t").cast("int").alias("t"))
    gathered = with_hashes(marked, "__words").select("t", F.explode(grams()).alias("x")).groupBy(bucket(F.col("x")).alias("b"))
    counts = gathered.agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    totals = Window.partitionBy()
    # every bucket has a row, so from here on there are BUCKETS rows
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(F.broadcast(shared_table(counts, "counts")), "b", "left").na.fill(0)
    a, n = SMOOTHING, SMOOTHING * BUCKETS
    all_good, all_raw = F.sum("good").over(totals), F.sum("raw").over(totals)
    ratio = F.log((F.col("good") + a) / (all_good + n)) - F.log((F.col("raw") + a) / (all_raw + n))
    ratios = every.select("b", F.when(all_good > 0, F.round(ratio, 6)).otherwise(0.0).alias("r"))
    array = F.transform(F.array_sort(F.collect_list(F.struct("b", "r"))), lambda x: x["r"])
    weights = QualityModel(ratios.agg(F.to_json(array).alias("j")).first()["j"], 0.0)
    scored = rows.where("t").select(word_array(F.col("__text")).alias("__words")).where(F.size("__words") >= MIN_WORDS)
    low = exact_quantile(with_hashes(scored, "__words").select(mean_ratio(weights.weights()).alias("s")), "s", QUANTILE)
    return QualityModel(weights.json, float("-inf") if low is None else low - MARGIN)


def judged(documents: DataFrame, text: str, model: QualityModel) -> DataFrame:
    """The columns of `documents` under the private names __own0, __own1, ..., and ADDED.

    The added columns come out of a generator, which the optimizer pushes no condition through: a filter on them would
    else be pushed below the projections, and each array be worked out again for each place that names it. Conditions on
    the input's own columns still reach the scan.
    """
    own = [f"__own{k}" for k in range(len(documents.columns))]
    rows = documents.select(*(col(c).alias(k) for k, c in zip(own, documents.columns, strict=True)), col(text).alias("__text"), word_array(col(text)).alias("__words"))
    rows = with_rules(with_hashes(rows, "__words"), "__text", "__words")
    rows = rows.withColumn("score", mean_ratio(model.weights()))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
    return rows.select(*own, F.inline(F.array(F.struct(*ADDED))))


def judge(documents: DataFrame, text: str, model: QualityModel) -> DataFrame:
    """Add the rules' columns, score and kept to all rows of `documents`; columns of the input with these names are replaced."""
    own = [F.col(f"__own{k}").alias(c) for k, c in enumerate(documents.columns) if c not in ADDED]
    return judged(documents, text, model).select(*own, *ADDED)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled of good quality and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def filtered(documents: DataFrame, text: str, model: QualityModel) -> DataFrame:
    """The kept rows of `documents` with its own columns, whatever their names."""
    return judged(documents, text, model).where("kept").select(*(F.col(f"__own{k}").alias(c) for k, c in enumerate(documents.columns)))
