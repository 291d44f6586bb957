"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the smallest distance,
and are rotated at random. Lists come from k-means on a sample; every vector is in a list. How many lists a query probes
is learned: the sampled vectors' true neighbours among each other are known, and the fewest lists are taken that hold
`TARGET_RECALL` of them. Where vectors have no structure that is most lists, and the tests below have to save the work.

Within a probed list, distances grow by column blocks. After d of D rotated columns a pair is abandoned if its partial
distance refutes, at `EPSILON` deviations, the hypothesis that the whole one is within the query's radius, which is that
of its (k + 1)-th nearest vector among `BOUND` sampled ones; so at least k entries other than its own are as near. Pairs
that stay are gathered once they are few, so the later columns are read for them alone. Survivors are scored exactly, in
double precision, on the original vectors. The nearest lists that hold k + 1 entries together are measured whole, so no
query is left with fewer than k.

Equal vectors are one entry with their smallest `k + 1` ids, which is all that a result can show; so neither a very
common vector nor its queries are scanned twice. They are told by two 64-bit hashes of different seeds. Neighbouring lists
are dealt to tasks in bundles; a long list is dealt in blocks, and so are a bundle's queries, whatever their number.

Bounds of the index: at most `SAMPLE` vectors and `SAMPLE_BYTES` are sampled, lists are at most `MAX_LISTS`, so with more
than `MAX_LISTS * LIST_ROWS` vectors they grow longer in proportion. Every vector is in the index and is a candidate.

Defined cases: vectors that are null, zero, of another than the most common length, or hold null or non-finite
components take no part, nor do rows without an id; ids are of any type with an order; ties go to the smaller id; repeated
rows are queries and candidates each; with fewer than k candidates all are returned; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillstone.llm.common import bound_batches, shared_table

SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
#: Sampled vectors that set the radius, and that ask for lists when the number of probes is learned.
BOUND = 4096
ASKED = 256
MAX_LISTS = 1024
LIST_ROWS = 100
TARGET_RECALL = 0.98
#: Bytes of the entries and of the queries that a task holds at a time.
BLOCK_BYTES = 1 << 20
CHUNK = 512
COLUMNS = 16
#: Deviations of the hypothesis test.
EPSILON = 2.1
#: Below this share of pairs alive, they are gathered and read one by one.
FEW = 1 / 16
SEED = 20


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T


def list_order(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The n nearest lists of each vector, nearest first; rows are compared in slices, so memory has a bound."""
    out = []
    for at in range(0, len(x), CHUNK):
        d = (centre**2).sum(1) - 2 * x[at : at + CHUNK] @ centre.T
        own = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centre) else np.broadcast_to(np.arange(n), d.shape)
        out.append(np.take_along_axis(own, np.argsort(np.take_along_axis(d, own, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = list_order(x, c, 1)[:, 0]
        sums, counts = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    # lists that lie near each other are neighbours, so that a query's lists are in few bundles
    spread = c - c.mean(0)
    return c[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]


def learned_probes(raw: np.ndarray, data: np.ndarray, asked: np.ndarray, centre: np.ndarray, k: int, target: float) -> int:
    """The fewest lists that hold the target share of the true neighbours of sampled vectors among each other."""
    picked = np.random.default_rng(SEED).permutation(len(raw))[:ASKED]
    if len(raw) <= k:
        return len(centre)
    score = raw[picked] @ raw.T
    score[np.arange(len(picked)), picked] = -np.inf
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    own = list_order(data, centre, 1)[:, 0]
    order = list_order(asked[picked], centre, len(centre))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centre))[None], 1)
    needed = np.sort(np.take_along_axis(place, own[true], 1), axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def column_ends(dim: int) -> list[int]:
    return [*range(COLUMNS, dim - COLUMNS // 2, COLUMNS), dim]


def scan(q: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) that no test abandons, and how many columns of pairs were needed for that."""
    dim, at, read = x.shape[1], 0, 0
    part, alive, i, j = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool), None, None
    for end in column_ends(dim):
        share = 1.0 if end == dim else min(1.0, end / dim * (1 + EPSILON / np.sqrt(end)) ** 2)
        limit = radius * share * (1 + 1e-6) + 1e-12
        if i is None and alive.mean() < FEW:
            i, j = np.nonzero(alive)
            part = part[i, j]
        if i is None:
            read += int(alive.sum()) * (end - at)
            part += distances(q[:, at:end], x[:, at:end])
            alive &= part <= limit[:, None]
        else:
            read += len(i) * (end - at)
            part += ((q[i, at:end] - x[j, at:end]) ** 2).sum(1)
            stay = part <= limit[i]
            i, j, part = i[stay], j[stay], part[stay]
        at = end
    return (*(np.nonzero(alive) if i is None else (i, j)), read)


def usable(vector: Column, dim: int) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """h1, h2, v and ids: the k + 1 smallest, found in salted groups first."""
    first = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    then = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(then)).where(F.col("r") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))


class Index:
    """What every task needs to know: the rotation, the lists, the sample that sets the radius, and the probes."""

    def __init__(self, sample: np.ndarray, top: float, rows: int, k: int, target: float) -> None:
        self.top, self.k, self.turn = top, k, rotation(sample.shape[1] + 1)
        data = self.lifted(sample, False)
        self.centre = centroids(data, int(min(MAX_LISTS, max(1, rows // LIST_ROWS))))
        self.probes = learned_probes(sample, data, self.lifted(sample, True), self.centre, k, target)
        self.bound = sample[np.random.default_rng(SEED + 1).permutation(len(sample))[:BOUND]]
        self.sizes = np.zeros(len(self.centre), np.int64)
        self.bundle = np.zeros(len(self.centre), np.int64)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        # a query's length does not change its order of candidates; at the common norm, lists are ranked by direction
        square = (x**2).sum(1)
        if query:
            x = x * np.sqrt(self.top / square)[:, None]
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top - square))
        return np.column_stack([x, extra]) @ self.turn

    def fill(self, sizes: dict[int, int], block: int) -> None:
        """Take the lists' numbers of entries, and deal neighbouring lists to bundles of about a block."""
        self.sizes[list(sizes)] = list(sizes.values())
        self.bundle = np.cumsum(np.maximum(self.sizes, 1)) // block

    def floor(self, x: np.ndarray) -> np.ndarray:
        """The score of each query's (k + 1)-th best vector of the sample; no result scores less."""
        if len(self.bound) <= self.k:
            return np.full(len(x), -np.inf)
        return np.partition(x @ self.bound.T, len(self.bound) - self.k - 1, axis=1)[:, len(self.bound) - self.k - 1]

    def radius(self, x: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The squared distance from the lifted query at which a candidate has that score."""
        return np.maximum(0, 2 * self.top - 2 * floor * np.sqrt(self.top / (x**2).sum(1)))

    def probed(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each query; those to be measured whole as -1 - list."""
        order = list_order(self.lifted(x, True), self.centre, len(self.centre))
        held = np.cumsum(self.sizes[order], axis=1)
        whole = (held < self.k + 1).sum(1) + 1
        out = []
        for row, w in zip(order, whole.tolist(), strict=True):
            row = row[: max(w, self.probes)].copy()
            row[:w] = -1 - row[:w]
            out.append(row)
        return out


def search(vectors: DataFrame, id_column: str, vector: str, is_query: Column, k: int = 20, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    kind = rows.schema["id"].dataType
    nothing = spark.createDataFrame([], StructType([StructField("query_id", kind), StructField("rank", IntegerType()), StructField("vec_id", kind), StructField("score", DoubleType())]))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None or common["d"] == 0:
        return nothing
    dim = common["d"]
    rows = shared_table(rows.where(usable(F.col("v"), dim)).select("id", "v", "q", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")), "vectors")
    unique = shared_table(distinct_vectors(rows, k), "unique")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    about = unique.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    if not about["n"]:
        return nothing
    wanted = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))
    share = F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1 << 40)) < int(min(1.0, wanted / about["n"]) * (1 << 40))
    picked = unique.where(share).select("h1", "h2", "v").toArrow()
    picked = picked if picked.num_rows else unique.orderBy("h1", "h2").limit(1).select("h1", "h2", "v").toArrow()

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    index = Index(matrix(picked.sort_by([("h1", "ascending"), ("h2", "ascending")])["v"].combine_chunks()), float(about["m"]), about["n"], k, target)
    block = max(64, BLOCK_BYTES // (8 * dim))
    lists = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list_order(lists.value.lifted(matrix(b.column(3)), False), lists.value.centre, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], ["h1", "h2", "own", "v", "l"])

    known = unique.select("h1", "h2", F.col("ids")[0].alias("own"), "v")
    entry = known.schema
    entries = shared_table(known.mapInArrow(assign, StructType([*entry, StructField("l", IntegerType())])), "entries")
    # a row for each list, so at most MAX_LISTS
    index.fill({r["l"]: r["n"] for r in entries.groupBy("l").agg(F.count("*").alias("n")).collect()}, block)
    full = spark.sparkContext.broadcast(index)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "v", "floor", "g", "l"]
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                x = matrix(part.column(2))
                floor, row, g, own = full.value.floor(x), [], [], []
                for n, found in enumerate(full.value.probed(x)):
                    bundle = full.value.bundle[np.where(found < 0, -1 - found, found)]
                    order = np.argsort(bundle, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(bundle[order])) + 1):
                        row.append(n), g.append(bundle[some[0]]), own.append(found[some])
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in part.columns), pa.array(floor).take(taken), pa.array(g, pa.int32()), pa.array(own, pa.list_(pa.int32()))], names)

    asked = known.join(rows.where("q").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")
    asked = asked.mapInArrow(ask, "h1 long, h2 long, v array<double>, floor double, g int, l array<int>")
    # two small tables, of a row for each bundle: how many blocks its entries and its queries are dealt in
    held = np.bincount(index.bundle, index.sizes).astype(int).tolist()
    queries = {r["g"]: r["n"] for r in asked.groupBy("g").agg(F.count("*").alias("n")).collect()}
    dealt = spark.createDataFrame([(g, -(-n // block) or 1, -(-queries.get(g, 0) // (4 * block))) for g, n in enumerate(held)], "g int, nb int, nq int")
    of_list = spark.createDataFrame([(n, int(g)) for n, g in enumerate(index.bundle)], "l int, g int")
    entries = entries.join(F.broadcast(of_list), "l").join(F.broadcast(dealt.where("nq > 0")), "g")
    entries = entries.select("g", "l", "h1", "h2", "own", "v", F.expr("cast(pmod(xxhash64(h1), nb) as int) as b"), F.expr("explode(sequence(0, nq - 1)) as s"))
    asked = asked.join(F.broadcast(dealt), "g").select("g", "l", "h1", "h2", "v", "floor", F.expr("explode(sequence(0, nb - 1)) as b"), F.expr("cast(pmod(xxhash64(h1), nq) as int) as s"))
    result = ["q1", "q2", "h1", "h2", "own", "score"]
    schema = StructType([*(StructField(n, entry["h1"].dataType) for n in result[:4]), StructField("own", kind), StructField("score", DoubleType())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by([("l", "ascending"), ("own", "ascending")])
            x_raw, l = matrix(right["v"].combine_chunks()), right["l"].to_numpy()
            x = full.value.lifted(x_raw, False)
            bounds = [0, *(np.flatnonzero(np.diff(l)) + 1).tolist(), len(l)]
            for at in range(0, left.num_rows, CHUNK):
                out.append(compared(left.slice(at, CHUNK), right, x_raw, x, l, bounds))
        return pa.concat_tables(out) if out else empty(right)

    def empty(right: pa.Table) -> pa.Table:
        own = right["own"].slice(0, 0)
        none = pa.array([], pa.int64())
        return pa.table([none, none, none, none, own, pa.array([], pa.float64())], result)

    def compared(part: pa.Table, right: pa.Table, x_raw: np.ndarray, x: np.ndarray, l: np.ndarray, bounds: list[int]) -> pa.Table:
        q_raw, floor = matrix(part["v"].combine_chunks()), part["floor"].to_numpy()
        q, radius = full.value.lifted(q_raw, True), full.value.radius(q_raw, floor)
        asked = part["l"].combine_chunks()
        whose = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy())
        which = asked.flatten().to_numpy()
        whole, which = which < 0, np.where(which < 0, -1 - which, which)
        found = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mine = which == l[a]
            if mine.any():
                row, every = whose[mine], whole[mine]
                i, j, _ = scan(q[row], x[a:b], np.where(every, np.inf, radius[row]))
                score = np.einsum("ij,ij->i", q_raw[row[i]], x_raw[a + j])
                ok = every[i] | (score >= floor[row[i]] - 1e-9 * np.abs(floor[row[i]]))
                found.append((row[i[ok]], a + j[ok], score[ok]))
        if not found:
            return empty(right)
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        # the smaller id first among equal scores
        place = np.empty(len(l), np.int64)
        place[np.argsort(right["own"].to_numpy(), kind="stable")] = np.arange(len(l))
        order = np.lexsort((place[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) <= k
        i, j, score = pa.array(i[best]), pa.array(j[best]), score[best]
        return pa.table([part["h1"].take(i), part["h2"].take(i), right["h1"].take(j), right["h2"].take(j), right["own"].take(j), pa.array(score)], result)

    near = asked.groupBy("g", "b", "s").cogroup(entries.groupBy("g", "b", "s")).applyInArrow(compare, schema)
    # an entry's smallest id breaks ties, so that equal scores of different vectors do not hide a smaller id
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "own")
    cut = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).join(unique.select("h1", "h2", "ids"), ["h1", "h2"])
    flat = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))))
    found = cut.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.slice(F.sort_array(flat), 1, k + 1).alias("a"))
    asked_ids = rows.where("q").select("id", "h1", "h2").join(found, ["h1", "h2"])
    # the query's own row is left out, once: another row that repeats it is a candidate
    own = F.coalesce(F.array_position(F.transform("a", lambda x: x["i"]), F.col("id")), F.lit(0))
    others = asked_ids.select(F.col("id").alias("query_id"), F.slice(F.filter("a", lambda _, n: n + 1 != own), 1, k).alias("a"))
    return others.select("query_id", F.posexplode("a").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
