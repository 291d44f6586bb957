"""URL filters: fixed rules first, then the purity of path templates.

Per host, a tree over the path's segments grows level by level, as deep as labels disagree: a node is split while its
labelled pages have both verdicts, and what lies below a node that agrees, or has no label, is one template (`/**`). At a
split, a labelled segment stays literal where its rate differs from its siblings' by `MIN_Z` standard errors; labelled
segments that are statistically similar are merged into the wildcard `*`, and so are rare ones without labels, as variable
parts. A common segment without labels stays literal, so that its siblings' labels do not speak for it.

A template's share of blocked labels, smoothed towards its host's and that towards the corpus's, decides: it is rejected
from `REJECT` on. Labels are the rules' own verdicts, or a column of the caller's beside them.

All sums are grouped aggregations over (host, node, segment) of distinct paths, so that a host or a page that holds a
third of all rows is summed before it is shuffled, and no host is gathered. Only segments that could stay literal are
compared with their node; the rest become wildcards without being looked up.

Defined cases: a null url or one without `://` has empty host and path and its own labels, else the corpus's rate decide;
repeated rows count each; a kept column with the name of an added one gives way; other columns are ignored; without any
label all is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import col, shared_table

#: (verdict, host and path); a rule holds for its host and all subdomains.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
WILDCARD, REST = "*", "/**"
#: A common segment has at least this many pages and this share of its node's.
MIN_PAGES = 8
MIN_SHARE = 0.01
#: A segment is told from its siblings at this many standard errors.
MIN_Z = 2.0
STRENGTH = 8.0
REJECT = 0.6
ADDED = ("host", "path", "rule", "verdict", "template", "purity")
COUNTS = ("n", "blocked", "labelled")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        own, rest = text.split("/", 1)
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def literals(child: DataFrame) -> DataFrame:
    """host, t and s of the segments that stay literal, out of each node's segments with their counts."""
    sums = [F.sum(c).alias(f"all_{c}") for c in COUNTS]
    node = child.groupBy("host", "t").agg(F.count("*").alias("kinds"), *sums)
    # no other segment can be common, be told from its siblings or be the only one
    asked = child.where((F.col("labelled") > 0) | (F.col("n") >= MIN_PAGES)).join(node, ["host", "t"])
    pooled = (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
    others = (F.col("all_blocked") - F.col("blocked") + pooled) / (F.col("all_labelled") - F.col("labelled") + 1)
    off = F.abs(F.col("blocked") - others * F.col("labelled")) / F.sqrt(F.col("labelled") * pooled * (1 - pooled))
    common = F.col("n") >= F.greatest(F.lit(float(MIN_PAGES)), MIN_SHARE * F.col("all_n"))
    stays = (F.col("kinds") == 1) | F.when(F.col("labelled") > 0, off >= MIN_Z).otherwise(common)
    return asked.where(stays).select("host", "t", "s", F.lit(True).alias("literal"))


def templates(paths: DataFrame) -> DataFrame:
    """host, segments, counts and template t of paths. A level takes one grouped sum, one small join and one stored table."""
    rows, k = paths.withColumns({"t": F.lit(""), "done": F.lit(False)}), 0
    while True:
        sums = [F.sum(c).alias(f"all_{c}") for c in COUNTS]
        ended = F.col("done") | (F.size("segments") <= k)
        # nodes whose labels disagree; the others' paths end here
        mixed = rows.where(~ended).groupBy("host", "t").agg(*sums).where("all_blocked > 0 and all_blocked < all_labelled").select("host", "t", F.lit(True).alias("split"))
        mixed = shared_table(mixed, "mixed")
        if mixed.isEmpty():
            break
        rows = rows.join(mixed, ["host", "t"], "left")
        live = ~ended & F.col("split").isNotNull()
        rows = rows.withColumn("t", F.when(~ended & F.col("split").isNull(), F.concat("t", F.lit(REST))).otherwise(F.col("t"))).withColumn("done", ~live).withColumn("s", F.when(live, F.get("segments", k))).drop("split")
        rows = shared_table(rows, "level")
        chosen = literals(rows.where("not done").groupBy("host", "t", "s").agg(*(F.sum(c).alias(c) for c in COUNTS)))
        step = F.concat("t", F.lit("/"), F.when(F.col("literal"), F.col("s")).otherwise(F.lit(WILDCARD)))
        rows = rows.join(chosen, ["host", "t", "s"], "left").withColumn("t", F.when(F.col("done"), F.col("t")).otherwise(step)).drop("s", "literal")
        k += 1
    open_end = ~F.col("done") & (F.size("segments") > k)
    return shared_table(rows.select("host", "segments", *COUNTS, F.when(open_end, F.concat("t", F.lit(REST))).otherwise(F.col("t")).alias("t")), "templates")


def judge(pages: DataFrame, url: str, keep: list[str], rules: tuple[tuple[str, str], ...] = RULES, blocked: str | None = None) -> DataFrame:
    """`keep`, host, path, rule, verdict, template and purity (share of blocked labels after smoothing).

    `blocked` names a column of labels: true, false or null. A rule's verdict comes before it.
    """
    if not {verdict for verdict, _ in rules} <= {"allow", "block"}:
        raise ValueError("a rule's verdict is allow or block")
    keep = [c for c in keep if c not in ADDED]
    by_rule = reduce(lambda out, r: F.when(F.col("rule") == r[1], F.lit(r[0])).otherwise(out), rules, F.lit(None).cast("string"))
    given = F.when(col(blocked), "block").when(~col(blocked), "allow") if blocked else F.lit(None).cast("string")
    rows = pages.select(*(col(c).alias(f"__k{k}") for k, c in enumerate(keep)), host(col(url)).alias("host"), path(col(url)).alias("path"), given.alias("given"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).withColumn("label", F.coalesce(by_rule, "given"))
    rows = rows.withColumn("segments", F.split(F.regexp_replace("path", "^/", ""), "/"))
    paths = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("blocked"), F.count("label").alias("labelled"))
    tree = templates(shared_table(paths, "paths"))
    corpus = tree.agg(F.coalesce((F.sum("blocked") + 0.0) / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("g")).first()["g"]
    sums = [F.sum(c).alias(c) for c in ("blocked", "labelled")]
    of_host = tree.groupBy("host").agg(*sums).select("host", ((F.col("blocked") + STRENGTH * corpus) / (F.col("labelled") + STRENGTH)).alias("h"))
    of_template = tree.groupBy("host", "t").agg(*sums).join(of_host, "host").select("host", "t", ((F.col("blocked") + STRENGTH * F.col("h")) / (F.col("labelled") + STRENGTH)).alias("purity"))
    known = tree.select("host", "segments", "t").join(of_template, ["host", "t"])
    verdict = F.coalesce("label", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.join(known, ["host", "segments"], "left").select(*(F.col(f"__k{k}").alias(c) for k, c in enumerate(keep)), "host", "path", "rule", verdict.alias("verdict"), F.col("t").alias("template"), "purity")
