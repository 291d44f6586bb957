"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts with method-C escapes. The statistics are frozen after training,
so the cost of a byte depends on the bytes before it alone and a text's exact code length is a sum of table entries. The
language with the shortest code wins. A byte value that training never saw costs the same eight bits in every language.

The languages' trees are laid over each other as one automaton, whose state is the longest context of any of them; in a
language whose own tree ends earlier a state costs what its shorter form does. Texts are cut into pieces, each of which
starts from the state that the few bytes before it determine, and all pieces take their steps together: so a text of any
length is read whole, in time linear in its bytes and with memory for a few numbers a piece.

Bounds of the model, all parameters: about `train_bytes` of text are trained on for each language, in rows chosen by a hash
of the id; a language keeps its `max_contexts` most frequent contexts, all of them with their shorter forms, or an equal part
of `ALL_CONTEXTS` where there are more languages than that allows. There may be any number of languages: automata hold
`TOGETHER_LANGUAGES` each and add one block of columns after the other. Counts are summed and cut by Spark; what the driver
gathers is a row for each language, the kept contexts, and a tally of their counts. Prediction reads every byte of every text
and nothing else.

Defined cases: a null text or one without a letter is `und` with score 0; equal code lengths go to the language first
in alphabetical order; without any labelled training row all are `und`; repeated rows get equal answers; a kept column with
the name of an added one gives way; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from quillstone.llm.common import bound_batches, col, map_column, shared_table, slices, utf8

ORDER = 4
UNDETERMINED = "und"
#: Contexts of all languages together, which bounds the model, and languages of one automaton.
ALL_CONTEXTS = 160_000
TOGETHER_LANGUAGES = 8
MIN_COUNT = 2
#: Bytes that take their steps one after the other, and bytes whose pieces are stepped together.
PIECE = 512
TOGETHER = 16 << 20
#: Stands for what precedes a text.
START = 256


@dataclass(frozen=True)
class PpmModel:
    """All languages in alphabetical order, and the automata that hold them one block after the other."""

    langs: tuple[str, ...]
    parts: tuple[Automaton, ...]


@dataclass(frozen=True)
class Automaton:
    """langs; rank of each byte value among those seen; edge[state, rank] is the edge that a byte takes: at the state itself or at the longest shorter form that knows the byte.

    after[edge] is the next state; cost[edge, language] are the bits of the byte from the root's point of view, and
    escape[state, language] those of leaving all longer forms: their sum is the byte's cost in the state.
    """

    langs: tuple[str, ...]
    rank: np.ndarray
    edge: np.ndarray
    after: np.ndarray
    cost: np.ndarray
    escape: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the code of the four symbols before it and of itself, of nine bits each; a text is preceded by START."""
    own = data.astype(np.int64)
    starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    code = own.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(own), START, np.int64)
        before[k:] = own[:-k]
        for j in range(k):
            at = starts + j
            before[at[at < len(own)]] = START
        code |= before << (9 * k)
    return code


def train(documents: DataFrame, text: str, lang: str, doc_id: str, train_bytes: int = 4 << 20, max_contexts: int = 12_000) -> PpmModel | None:
    """Fit on about `train_bytes` of each language. The counts are made on the executors and summed by Spark."""
    spark = documents.sparkSession
    bound_batches(spark)
    labelled = documents.select(col(doc_id).alias("i"), col(text).alias("t"), col(lang).cast("string").alias("g")).where("g is not null and t is not null and t <> ''")
    sizes = labelled.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).collect()
    if not sizes:
        return None
    langs = tuple(sorted(r["g"] for r in sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["g"], min(1.0, train_bytes / r["b"]))])
    drawn = F.pmod(F.xxhash64(F.col("i"), F.lit(7)), F.lit(1 << 40)) < share[F.col("g")] * (1 << 40)
    chosen = labelled.where(drawn).select("t", "g")
    place = {g: k for k, g in enumerate(langs)}
    max_contexts = max(1, min(max_contexts, ALL_CONTEXTS // len(langs)))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = np.array([place[g] for g in b.column(1).to_pylist()])
            for tag in np.unique(tags):
                data, offsets = utf8(b.column(0).filter(pa.array(tags == tag)))
                for lo, hi in slices(offsets, TOGETHER):
                    code, n = np.unique(grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), tag, np.int32)), pa.array(code), pa.array(n)], ["g", "c", "n"])

    whole = shared_table(chosen.mapInArrow(count_grams, "g int, c long, n long").groupBy("g", "c").agg(F.sum("n").alias("n")), "grams")
    known = F.array(*[F.lit(k) for k in range(ORDER + 1)])
    rows = whole.select("g", "n", F.col("c").bitwiseAND(F.lit(511)).alias("s"), F.shiftright("c", 9).alias("h"), F.explode(known).alias("k"))
    # a context of k symbols, unless the text began within them
    context = F.expr("h & (shiftleft(1L, 9 * k) - 1)")
    inside = F.expr(f"k = 0 or shiftright(h, 9 * (k - 1)) & 511 <> {START}")
    counted = shared_table(rows.where(inside).select("g", "k", context.alias("x"), "s", "n").groupBy("g", "k", "x", "s").agg(F.sum("n").alias("n")), "contexts")
    totals = counted.groupBy("g", "k", "x").agg(F.sum("n").alias("m")).where(f"k = 0 or m >= {MIN_COUNT}")
    # how many contexts have each count: a row for each count there is, so a few thousand for a language at most. What
    # does not fit has the count of the first context beyond the bound or less; the rest is closed under shorter and
    # earlier forms
    least = dict.fromkeys(range(len(langs)), 0)
    room = dict.fromkeys(range(len(langs)), max_contexts)
    for r in sorted(totals.groupBy("g", "m").agg(F.count("*").alias("some")).collect(), key=lambda r: -r["m"]):
        room[r["g"]] -= r["some"]
        if room[r["g"]] < 0 and not least[r["g"]]:
            least[r["g"]] = r["m"]
    bar = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    kept = totals.where((F.col("k") == 0) | (F.col("m") > bar[F.col("g")])).select("g", "k", "x")
    found = counted.join(kept, ["g", "k", "x"]).select("g", "k", "x", "s", "n").toArrow()
    rows = [found[c].to_numpy() for c in ("g", "k", "x", "s", "n")]
    parts = []
    for at in range(0, len(langs), TOGETHER_LANGUAGES):
        own = (rows[0] >= at) & (rows[0] < at + TOGETHER_LANGUAGES)
        parts.append(build(langs[at : at + TOGETHER_LANGUAGES], rows[0][own] - at, *(c[own] for c in rows[1:])))
    return PpmModel(langs, tuple(parts))


def build(langs: tuple[str, ...], tag: np.ndarray, order: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Automaton:
    """The automaton from counts: of each symbol after each kept context of each language."""
    n_langs = len(langs)
    seen = np.unique(symbol)
    # every byte value has a rank; those that were never seen share the last one
    rank = np.full(256, len(seen), np.int64)
    rank[seen] = np.arange(len(seen))
    width = len(seen) + 1
    # states, the shorter ones first: the root is 0
    code = (order.astype(np.int64) << 40) | context
    states, state = np.unique(code, return_inverse=True)
    state_order, state_context = states >> 40, states & ((1 << 40) - 1)
    shorter = np.searchsorted(states, (np.maximum(state_order - 1, 0) << 40) | (state_context & ((np.int64(1) << (9 * np.maximum(state_order - 1, 0))) - 1)))
    pair = state.astype(np.int64) * width + rank[symbol]
    edges, edge = np.unique(pair, return_inverse=True)
    counts = np.zeros((len(edges), n_langs))
    np.add.at(counts, (edge, tag), n)
    owner, byte = edges // width, edges % width
    total, kinds = np.zeros((len(states), n_langs)), np.zeros((len(states), n_langs))
    np.add.at(total, owner, counts)
    np.add.at(kinds, owner, counts > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        own = np.log2((total[owner] + kinds[owner]) / counts)
    escape = np.zeros((len(states), n_langs))
    table = np.full((len(states), width), -1, np.int64)
    table[owner, byte] = np.arange(len(edges))
    cost = np.zeros((len(edges) + width, n_langs))
    # what no context knows costs eight bits beside the escapes; its edges come after the others and lead to the root
    cost[len(edges) :] = 8.0
    table[0] = np.where(table[0] < 0, len(edges) + np.arange(width), table[0])
    for k in range(ORDER + 1):
        here = np.flatnonzero(state_order == k)
        escape[here] = leave[here] + (escape[shorter[here]] if k else 0.0)
        if k:
            table[here] = np.where(table[here] < 0, table[shorter[here]], table[here])
        mine = np.flatnonzero(state_order[owner] == k)
        # in a language that does not know the byte here, it costs the escape and what it does in the shorter form
        up = shorter[owner[mine]]
        if k:
            below = cost[table[up, byte[mine]]] + escape[up] + leave[owner[mine]]
        else:
            below = 8.0 + leave[owner[mine]]
        cost[mine] = np.where(counts[mine] > 0, own[mine], below) - escape[owner[mine]]
    after = np.zeros(len(edges) + width, np.int32)
    longer = (state_context[owner] << 9) | seen[np.minimum(byte, len(seen) - 1)]
    for k in range(ORDER, 0, -1):
        wanted = (np.int64(k) << 40) | (longer & ((np.int64(1) << (9 * k)) - 1))
        at = np.minimum(np.searchsorted(states, wanted), len(states) - 1)
        hit = (states[at] == wanted) & (state_order[owner] >= k - 1) & (after[: len(edges)] == 0)
        after[: len(edges)][hit] = at[hit]
    return Automaton(langs, rank.astype(np.uint8 if width <= 256 else np.int64), table.astype(np.int32), after, cost, escape)


def code_lengths(model: PpmModel, data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Bits of each text in each language, in double precision."""
    return np.hstack([lengths(part, data, offsets, piece) for part in model.parts])


def lengths(model: Automaton, data: np.ndarray, offsets: np.ndarray, piece: int) -> np.ndarray:
    """Bits of each text in each language of one automaton."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    width = model.edge.shape[1]
    edge = model.edge.reshape(-1)
    sizes = np.diff(offsets)
    per = -(-sizes // piece)
    text = np.repeat(np.arange(len(sizes)), per)
    first = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[:-1][text] + first * piece
    end = np.minimum(begin + piece, offsets[1:][text])
    for at in range(0, len(text), max(1, TOGETHER // piece)):
        whose, a, z = (x[at : at + max(1, TOGETHER // piece)] for x in (text, begin, end))
        # longest pieces first, so that those still going are the first ones
        order = np.argsort(a - z, kind="stable")
        whose, a, z = whose[order], a[order], z[order]
        size = z - a
        state = np.zeros(len(a), np.int64)
        lead = np.minimum(ORDER, a - offsets[:-1][whose])
        for k in range(ORDER, 0, -1):
            some = np.flatnonzero(lead >= k)
            state[some] = model.after[edge[state[some] * width + model.rank[data[a[some] - k]]]]
        bits = np.zeros((len(a), len(model.langs)))
        live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for k, n in enumerate(live.tolist()):
            now = state[:n]
            took = edge[now * width + model.rank[data[a[:n] + k]]]
            bits[:n] += model.cost[took]
            bits[:n] += model.escape[now]
            state[:n] = model.after[took]
        np.add.at(out, whose, bits)
    return out


def predict(documents: DataFrame, model: PpmModel | None, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang_pred and score (the winner's probability, all languages being equally likely before)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(column: pa.Array) -> list[pa.Array]:
        ppm, n = shared.value, len(column)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if ppm is None:
            return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n))]
        bits = code_lengths(ppm, *utf8(column))
        gap = bits - bits.min(1, keepdims=True)
        names = np.where(letters, np.array(ppm.langs, object)[bits.argmin(1)] if n else [], UNDETERMINED)
        score = np.where(letters, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
        return [pa.array(names, pa.string()), pa.array(score)]

    return map_column(documents, keep, col(text), [StructField("lang_pred", StringType()), StructField("score", DoubleType())], label)
