"""Annotations and edges: anchoring of quotes, status after edits, staleness, cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.stored import drop_table, shared_table

#: The accepted edge predicates.
PREDICATES = ("transcludes", "cites", "derives-from", "references", "extends", "refutes", "translates", "summarizes")


def occurrences(text: Column, quote: Column) -> Column:
    """Character offsets of the non-overlapping occurrences, from the lengths of the pieces between them; one pass over the text."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), quote, F.lit(r"\E")), -1)
    # offsets as text: strings grow in place of an array that each step would copy
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(quote)).alias("at"), F.concat(a["s"], F.lit(" "), (a["at"] + F.length(p)).cast("string")).alias("s"))
    found = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), state, step, lambda a: F.ltrim(a["s"]))
    return F.when(F.size(pieces) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.split(found, " "), lambda x: x.cast("int")))


def anchor_status(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """active: the quote is where it was; active_partial: it is elsewhere in the text; orphan: it is gone."""
    there = F.substring(text, start + 1, end - start) == quote
    return F.when((start < end) & there, "active").when((quote != "") & F.contains(text, quote), "active_partial").otherwise("orphan")


def stale(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """Live edges whose target has a later version than the one they were made for."""
    return edges.join(versions, "target_id").where("status = 'live' and version_at_include < version")


def create(requests: DataFrame, nodes: DataFrame, now: Column, predicates: tuple[str, ...] = PREDICATES) -> tuple[DataFrame, DataFrame]:
    """Edges and rejects of requests (source_id, target_id, predicate).

    An edge keeps its target's version. A predicate beyond the list is INVALID_PREDICATE, an end that is no node is
    NODE_NOT_FOUND, and an edge from a node to itself is SELF_EDGE; of several faults the first of these is named.
    """
    end = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("doc_id").alias(f"{side}_doc"), F.col("version").alias(f"{side}_version"))
    rows = requests.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    error = F.when(~F.coalesce(F.col("predicate").isin(*predicates), F.lit(False)), "INVALID_PREDICATE").when(F.col("source_version").isNull() | F.col("target_version").isNull(), "NODE_NOT_FOUND").when(F.col("source_id") == F.col("target_id"), "SELF_EDGE")
    rows = rows.withColumn("error", error)
    made = rows.where("error is null").select(
        F.sha2(F.concat_ws("|", "source_id", "predicate", "target_id"), 256).alias("edge_id"), "predicate", "source_id", "source_doc", "target_id", "target_doc",
        F.col("target_version").alias("version_at_include"), F.lit("live").alias("status"), now.alias("created_at"),
    )
    return made, rows.where("error is not null").select("source_id", "target_id", "predicate", "error")


def by_source(edges: DataFrame, node_id: object) -> DataFrame:
    return edges.where(F.col("source_id") == F.lit(node_id))


def by_target(edges: DataFrame, node_id: object) -> DataFrame:
    return edges.where(F.col("target_id") == F.lit(node_id))


def refreshed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their present status: a live one is orphaned if its target is gone or deleted, and stale if that is newer."""
    now = nodes.select(F.col("node_id").alias("target_id"), F.col("version").alias("__version"), (F.col("status") == "deleted").alias("__gone"))
    both = edges.join(now, "target_id", "left")
    gone = F.coalesce(F.col("__gone"), F.lit(True))
    status = F.when(F.col("status") != "live", F.col("status")).when(gone, "orphaned").when(F.col("__version") > F.col("version_at_include"), "stale").otherwise("live")
    return both.withColumn("status", status).select(edges.columns)


def cycles(edges: DataFrame) -> DataFrame:
    """node and length of the shortest cycle through it, for every node that is on one; edges are source_id and target_id.

    Nodes without an edge in or out are on no cycle and go first, round by round. From each node that stays, walks grow by
    one edge a round, each node being reached once, until the start is met or nothing new is; no depth bounds them. Every
    round is stored, so plans stay small. Repeated edges count once; edges without one of their ends are ignored.
    """
    core = shared_table(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a is not null and b is not null").distinct(), "cycle-edges")
    n, before = core.count(), None
    while n and n != before:
        both = core.select(F.col("a").alias("x")).intersect(core.select(F.col("b").alias("x")))
        core = core.join(both.withColumnRenamed("x", "a"), "a", "left_semi").join(both.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b")
        core = shared_table(core, "cycle-edges")
        n, before = core.count(), n
    walks = shared_table(core.select(F.col("a").alias("node"), F.col("b").alias("at"), F.lit(1).alias("length")), "cycle-walks")
    reached, length, grown = walks, 1, n
    while grown:
        length += 1
        met = reached.where("node = at").select("node")
        ends = walks.join(met, "node", "left_anti").select("node", F.col("at").alias("a"))
        step = ends.join(core, "a").select("node", F.col("b").alias("at")).distinct().join(reached, ["node", "at"], "left_anti")
        walks = shared_table(step.withColumn("length", F.lit(length)), "cycle-walks")
        reached, grown = reached.unionByName(walks), walks.count()
        if length % 8 == 0:
            reached = shared_table(reached, "cycle-reached")
    return reached.where("node = at").select("node", "length")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its largest node) and size of the strongly connected components that hold a cycle.

    Edges are source_id and target_id; repeated ones count once, those without an end are ignored. Nodes with one edge out,
    then ones with one edge in, are taken out by chains (see `unchained`), as long as that removes a tenth of the edges.
    `coloured` finds the components of the rest, and the chains are put back, the last ones first. Every round is stored
    and holds a row for each node or edge; a chain costs rounds as the logarithm of its length.
    """
    core = shared_table(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a is not null and b is not null").distinct(), "edges")
    turned = lambda x: x.select(F.col("b").alias("a"), F.col("a").alias("b"))
    core, found, undo, n = core.where("a <> b"), None, [], None
    while n is None or (core.count() < 0.9 * n and not core.isEmpty()):
        n = core.count()
        for turn in (lambda x: x, turned):
            rest, rings, back = unchained(turn(core))
            found = rings if found is None else found.unionByName(rings)
            undo.append(back)
            core = turn(rest)
    found = shared_table(found.unionByName(coloured(core)), "components")
    for back in reversed(undo):
        found = shared_table(found.unionByName(back(found)), "components")
    # a component goes by the name of a node of it, until all are there
    named = found.groupBy("component").agg(F.max("node").alias("largest"), F.count("*").alias("size"))
    out = found.join(named, "component").where("size > 1").select("node", F.col("largest").alias("component"), "size")
    loops = edges.where("source_id = target_id").select(F.col("source_id").alias("node")).distinct().join(out, "node", "left_anti")
    return out.unionByName(loops.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size")))


def unchained(core: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Edges without the nodes of one edge out, the components among those nodes, and what puts the others back.

    A node with one edge out leads to its chain's end, the next node with several or none; edges into the chain go there
    instead, and nothing else is lost, as the chain has no other way out. Ends are found by doubling: after k rounds each
    node knows the one that is 2^k steps on. A chain without an end runs into a ring, a component of its own. A node of a
    chain is in the component of the chain's end if an edge out of that component enters the chain before it.
    """
    degree = core.groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("next"))
    single = shared_table(degree.where("n = 1").select(F.col("a").alias("node"), "next"), "chains")
    at = shared_table(single.select("node", F.col("next").alias("to"), F.greatest("node", "next").alias("top")).join(single.select(F.col("node").alias("to"), F.lit(True).alias("goes")), "to", "left").select("node", "to", "top", F.col("goes").isNotNull().alias("goes")), "steps")
    steps, span, most = [at], 1, single.count()
    while span <= most and not at.where("goes").isEmpty():
        on = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("top").alias("other"), F.col("goes").alias("on"))
        both = at.join(on, "to", "left")
        at = shared_table(both.select("node", F.coalesce("next", "to").alias("to"), F.greatest("top", "other").alias("top"), F.coalesce("on", F.lit(False)).alias("goes")), "steps")
        steps.append(at)
        span *= 2
    # what still goes on after as many steps as there are nodes is where rings are, with their largest nodes
    rings = shared_table(at.where("goes").select(F.col("to").alias("node")).distinct().join(at.select("node", F.col("top").alias("component")), "node"), "rings")
    ends = at.where("not goes").select(F.col("node").alias("b"), F.col("to").alias("end"))
    outer = core.join(single.select(F.col("node").alias("a")), "a", "left_anti")
    lost = at.where("goes").select(F.col("node").alias("b"))
    entered = shared_table(outer.join(lost, "b", "left_anti").join(ends, "b", "left").select("a", "b", "end"), "edges")
    dead = entered.select(F.coalesce("end", "b").alias("x")).distinct().join(entered.select(F.col("a").alias("x")), "x", "left_anti")
    rest = entered.select("a", F.coalesce("end", "b").alias("b")).where("a <> b").distinct()
    rest = shared_table(rest.join(dead.withColumnRenamed("x", "b"), "b", "left_anti").select("a", "b"), "edges")

    def back(found: DataFrame) -> DataFrame:
        of = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
        met = entered.where("end is not null").join(of("a", "from"), "a", "left").join(of("end", "into"), "end", "left")
        live = met.where(F.coalesce("from", "a") == F.coalesce("into", "end")).select(F.col("b").alias("node")).distinct()
        for step in steps:
            onward = step.join(live, "node", "left_semi").select(F.col("to").alias("node"))
            onward = onward.join(single.select("node"), "node", "left_semi")
            live = shared_table(live.unionByName(onward).distinct(), "live")
        members = live.join(at.select("node", "to"), "node").join(of("to", "into"), "to", "left").select("node", F.coalesce("into", "to").alias("component"), "to")
        # an end that had no component yet is one now, by its own name
        alone = members.select(F.col("to").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        return members.select("node", "component").unionByName(alone)

    return rest, rings, back


def coloured(core: DataFrame) -> DataFrame:
    """node and component of edges (a, b), round by round.

    Nodes without an edge in or out are trimmed. Then each node takes the largest node that leads to it as its colour, and
    the nodes of a colour that lead back to the node it is named after, along nodes of that colour, are its component; they
    go, and the rest begins again.
    """
    found = core.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    while True:
        core = trimmed(core)
        if core.isEmpty():
            break
        colours = shared_table(core.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
        colours = spread(colours, core, lambda old, new: F.greatest(old, new))
        own = core.join(colours.select(F.col("node").alias("a"), "colour"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").where("colour = other")
        # backwards from the node that each colour is named after
        back = shared_table(own.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        reached = shared_table(colours.where("node = colour").select("node", F.col("colour").alias("component")), "reached")
        while True:
            step = back.join(reached.select(F.col("node").alias("a"), "component"), "a").select(F.col("b").alias("node"), "component").distinct().join(reached, "node", "left_anti")
            step = shared_table(step, "reached")
            if step.isEmpty():
                break
            before, reached = reached, shared_table(reached.unionByName(step), "reached")
            drop_table(before)
        found = shared_table(found.unionByName(reached), "components")
        gone = reached.select("node")
        rest = core.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        core = shared_table(rest, "edges")
    return found


def trimmed(core: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that have an edge in and one out, round by round."""
    n, before = core.count(), None
    while n and n != before:
        both = core.select(F.col("a").alias("x")).intersect(core.select(F.col("b").alias("x")))
        last = core
        core = shared_table(core.join(both.withColumnRenamed("x", "a"), "a", "left_semi").join(both.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b"), "edges")
        drop_table(last)
        n, before = core.count(), n
    return core


def spread(colours: DataFrame, core: DataFrame, better: Callable[[Column, Column], Column]) -> DataFrame:
    """Colours handed on along the edges until none changes."""
    while True:
        along = core.join(colours.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("new"))
        step = colours.join(along, "node", "left").select("node", better(F.col("colour"), F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved"))
        step = shared_table(step, "colours")
        drop_table(colours)
        colours = step.select("node", "colour")
        if step.where("moved").isEmpty():
            return colours
