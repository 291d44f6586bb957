"""Mixing sources to target weights by iterative proportional fitting, in Spark's own expressions only.

Documents fall into cells (source, language, topic). The token weights of the cells are raked until their sums over each
of the three dimensions have the target shares. The probability of a document is that of its cell: the raked weight over
the tokens there are, times a factor that makes the expected sample as large as asked for, and 1 at most. A hash of the
id decides, so that the same documents are drawn whatever the partitioning.

The targets of a dimension may be given as shares of its categories; they are brought to sum to 1 over the categories that have
tokens, and a category without a share is not drawn. Where none are given, they are the sizes to the power `TEMPER`.

Sweeps are repeated until no dimension's sums are off their targets by more than `TOLERANCE`, or by no less than the time
before, where cells that are missing make the targets contradict each other; `MOST_SWEEPS` end it in any case. If the sums
are then off by more than `TOLD`, a warning says by how much.

There is one row for each combination of categories, whatever the number of documents. Up to `CELLS_AT_ONCE` of them are
counted first and then swept in one task without a shuffle; beyond, each step is a grouped sum and a join on stored tables.
Documents are summed by partial aggregation, and whether a table is small enough to be broadcast is Spark's to check.

Defined cases: a null category counts as `unknown`; a null text has no tokens, and a cell without tokens keeps
probability 0; repeated rows and equal ids get the same decision; an empty table gives an empty sample; a column of topics
is used if `topic` names it, else a text's register stands in (`register_of`); other columns pass through, but for names
like those that are added (__tokens, __source, __lang, __topic, __p), which are replaced.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import col, drop_table, shared_table

DIMENSIONS = ("source", "lang", "topic")
TOLERANCE = 1e-12
TOLD = 1e-6
MOST_SWEEPS = 200
#: Sweeps between two looks at the sums.
LOOK = 5
CELLS_AT_ONCE = 50_000
#: Targets are the sizes to this power, made to sum to 1: large categories are lowered, small ones raised.
TEMPER = 0.7
#: The expected sample holds this share of all tokens.
BUDGET = 0.5
SPACE = "[ \t\n\r]+"
ADDED = ("__tokens", "__source", "__lang", "__topic", "__p")


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def register_of(text: Column, tokens: Column) -> Column:
    """A text's register by its form: brief notes, tables, lists, long and ordinary prose."""
    lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n"))
    bars = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[|]"))
    return F.when(tokens < 64, "brief").when(bars * 8 > tokens, "table").when(lines * 12 > tokens, "list").when(tokens >= 1000, "long").otherwise("prose")


def measured(documents: DataFrame, text: str, source: str, lang: str, topic: str | None = None) -> DataFrame:
    """All columns of `documents` and __tokens, __source, __lang and __topic."""
    unknown = lambda c: F.coalesce(col(c).cast("string"), F.lit("unknown"))
    rows = documents.withColumns({"__tokens": token_count(col(text)), "__source": unknown(source), "__lang": unknown(lang)})
    return rows.withColumn("__topic", unknown(topic) if topic else register_of(col(text), F.col("__tokens")))


def target_shares(cells: DataFrame, key: str, given: Mapping[str, float] | None, temper: float) -> DataFrame:
    """key and its share: as given, or by the categories' sizes; they sum to 1 over the categories that are there."""
    sizes = cells.groupBy(key).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("s"))
    if given is not None:
        if not all(math.isfinite(x) and x >= 0 for x in given.values()) or not any(given.values()):
            raise ValueError("target weights are finite, not negative and not all 0")
        wanted = cells.sparkSession.createDataFrame([(str(k), float(x)) for k, x in given.items() if x > 0], "k string, s double")
        sizes = sizes.select(key).join(wanted, F.col(key) == F.col("k")).select(key, "s")
    total = sizes.agg(F.sum("s")).first()[0] or 1.0
    return sizes.select(key, (F.col("s") / total).alias(f"{key}_target"))


def rake(rows: DataFrame, temper: float = TEMPER, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The cells that may be drawn: __source, __lang, __topic, tokens, weight and p."""
    if set(targets or ()) - set(DIMENSIONS):
        raise ValueError(f"targets are for {', '.join(DIMENSIONS)}")
    keys = [f"__{d}" for d in DIMENSIONS]
    cells = shared_table(rows.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")).where("tokens > 0"), "cells")
    at_once = cells.count() <= CELLS_AT_ONCE
    whole = cells
    for d, k in zip(DIMENSIONS, keys, strict=True):
        whole = whole.join(target_shares(cells, k, (targets or {}).get(d), temper), k)
    whole = stored(whole.withColumn("weight", F.col("tokens").cast("double")), at_once)
    off = float("inf")
    for _ in range(0, MOST_SWEEPS, LOOK):
        before, last = whole, off
        whole = swept(whole, keys, at_once)
        drop_table(before)
        off = deviation(whole, keys)
        # where targets contradict each other, sweeps go on in a circle
        if off <= TOLERANCE or off >= last:
            break
    if off > TOLD:
        warnings.warn(f"the mix is off its targets by up to {off:.2g} of their size, as cells that they need are missing", stacklevel=2)
    # p = min(1, f * weight / tokens), where f makes the expected tokens the budget: what f would take whole, is
    tokens, ratio = F.sum("tokens"), F.col("weight") / F.col("tokens")
    wanted, f = budget * float(cells.agg(tokens).first()[0] or 0), 0.0
    while True:
        taken = ratio * f > 1
        sums = whole.agg(F.sum(F.when(taken, F.col("tokens"))).alias("t"), F.sum(F.when(~taken, F.col("weight"))).alias("w")).first()
        better = (wanted - (sums["t"] or 0)) / sums["w"] if sums["w"] else f
        if better <= f:
            break
        f = better
    return shared_table(whole.select(*keys, "tokens", "weight", F.round(F.least(F.lit(1.0), ratio * f), 6).alias("p")), "mix")


def stored(cells: DataFrame, at_once: bool) -> DataFrame:
    return shared_table(cells.coalesce(1) if at_once else cells, "sweep")


def swept(cells: DataFrame, keys: list[str], at_once: bool) -> DataFrame:
    """LOOK sweeps: in each, the weights are brought to the targets of one dimension after the other."""
    if at_once:
        cells = cells.coalesce(1)
        for _ in range(LOOK):
            for k in keys:
                cells = cells.withColumn("weight", F.col("weight") * F.col(f"{k}_target") / F.sum("weight").over(Window.partitionBy(k)))
        return stored(cells, True)
    for _ in range(LOOK):
        for k in keys:
            sums = cells.groupBy(k).agg(F.sum("weight").alias("w"))
            before, cells = cells, stored(cells.join(sums, k).withColumn("weight", F.col("weight") * F.col(f"{k}_target") / F.col("w")).drop("w"), False)
            drop_table(before)
    return cells


def deviation(cells: DataFrame, keys: list[str]) -> float:
    """How far the sums are off their targets at most, in proportion."""
    worst = 0.0
    for k in keys:
        sums = cells.groupBy(k).agg(F.sum("weight").alias("w"), F.first(f"{k}_target").alias("t"))
        worst = max(worst, sums.agg(F.max(F.abs(F.col("w") / F.col("t") - 1))).first()[0] or 0.0)
    return worst


def uniform(doc_id: Column) -> Column:
    """A number from [0, 1) that the id alone decides: 13 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sample(rows: DataFrame, cells: DataFrame, doc_id: str) -> DataFrame:
    """The drawn rows of measured documents with __p; cells is small by construction, and Spark checks its size."""
    keys = [f"__{d}" for d in DIMENSIONS]
    return rows.join(cells.select(*keys, F.col("p").alias("__p")), keys).where(uniform(col(doc_id)) < F.col("__p"))


def drawn(documents: DataFrame, text: str, doc_id: str, source: str, lang: str, topic: str | None, budget: float, targets: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """The drawn rows: the columns of `documents` under the private names __own0, __own1, ..., and ADDED."""
    private = {c: f"__own{k}" for k, c in enumerate(documents.columns)}
    rows = documents.select(*(col(c).alias(k) for c, k in private.items()))
    rows = measured(rows, private[text], private[source], private[lang], topic and private[topic])
    return sample(rows, rake(rows, budget=budget, targets=targets), private[doc_id])


def mix(documents: DataFrame, text: str, doc_id: str, source: str, lang: str, topic: str | None = None, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Measure, rake and draw; adds ADDED. The text is read twice rather than stored: once for the sums, once for the sample.

    `targets` may give the shares of the categories of "source", "lang" and "topic", each or any of them.
    """
    own = [F.col(f"__own{k}").alias(c) for k, c in enumerate(documents.columns) if c not in ADDED]
    return drawn(documents, text, doc_id, source, lang, topic, budget, targets).select(*own, *ADDED)


def mixed(documents: DataFrame, text: str, doc_id: str, source: str, lang: str, topic: str | None = None, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The drawn rows of `documents` with its own columns, whatever their names."""
    own = [F.col(f"__own{k}").alias(c) for k, c in enumerate(documents.columns)]
    return drawn(documents, text, doc_id, source, lang, topic, budget, targets).select(*own)
