"""Best-fit packing of token pieces into sequences by exact-complement hashing.

All decisions are made on the histogram of piece lengths, which has at most `capacity` entries whatever the corpus
holds: sums of one, two and three available lengths are indexed, combinations that exactly fill a gap are consumed in
bulk under the counts of what is left, and the rest is packed best-fit, longest first. The plan is a list of runs
(length, first rank, pieces a sequence, first sequence, offset); each piece finds its place by its rank among the
pieces of its length. Ranks are counted in salted groups, so that a length which holds a third of all rows is spread.

Defined cases: a null text is empty, and an empty text is one piece that holds the end token alone; longer texts than
the capacity are cut into full pieces and a last, shorter one; repeated rows are packed each on its own; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillstone.llm.common import bound_batches, col, shared_table
from quillstone.llm.tokens import described, encoder_of

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked by one task at a time.
GROUP_ROWS = 1000


def token_pieces(documents: DataFrame, text: str, keep: list[str], tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: `keep`, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian bytes."""
    bound_batches(documents.sparkSession)
    rows = documents.select(*(col(c) for c in keep), F.coalesce(col(text), F.lit("")).alias("__text"))
    schema = StructType(rows.schema.fields[: len(keep)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    tail = int(end_id).to_bytes(4, "little")
    description = documents.sparkSession.sparkContext.broadcast(described(tokenizer))
    names = [f.name for f in schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(description.value).encode
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, t in enumerate(b.column(len(keep)).to_pylist()):
                whole = encode(t) + tail
                for p, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    row.append(k), piece.append(p), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            taken = pa.array(row, pa.int64())
            columns = [b.column(k).take(taken) for k in range(len(keep))]
            columns += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    return rows.mapInArrow(cut, schema)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs for a histogram (counts[l] pieces of length l): rows (length, first rank, pieces a sequence, first sequence, offset, sequences)."""
    left = counts.astype(np.int64).copy()
    patterns = exact_fills(left, capacity) + best_fit(left, capacity)
    rank, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for times, parts in patterns:
        offset = 0
        for size, each in parts:
            runs.append((size, rank[size], each, sequence, offset, times))
            rank[size] += times * each
            offset += size * each
        sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def exact_fills(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Consume, longest piece first, what one to three other pieces complete to exactly `capacity`."""
    out = []
    if left[capacity]:
        out.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    pairs = pair_index(left)
    for size in range(capacity - 1, 0, -1):
        while left[size] > 0:
            fill = complement(left, pairs, size, capacity - size)
            if fill is None:
                break
            parts: dict[int, int] = {}
            for x in (size, *fill):
                parts[x] = parts.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in parts.items())
            for x, k in parts.items():
                left[x] -= times * k
            out.append((times, sorted(parts.items(), reverse=True)))
            if any(left[x] < 2 for x in parts):
                pairs = pair_index(left)
    return out


def pair_index(left: np.ndarray) -> np.ndarray:
    """For each sum, whether two available lengths make it (one length twice only if two pieces are left)."""
    n = len(left)
    have = (left > 0).astype(np.float64)
    width = 1 << (2 * n - 1).bit_length()
    sums = np.rint(np.fft.irfft(np.fft.rfft(have, width) ** 2, width)[:n]).astype(np.int64)
    once = np.flatnonzero(left == 1)
    once = once[2 * once < n]
    sums[2 * once] -= 1
    return sums > 0


def complement(left: np.ndarray, pairs: np.ndarray, size: int, gap: int) -> tuple[int, ...] | None:
    """Available lengths, at most three and none above `size`, that sum to `gap`; fewest first, then with the longest."""
    top = min(size, gap)
    if gap <= size and left[gap] > (gap == size):
        return (gap,)
    lengths = np.flatnonzero(left[: top + 1] > 0)[::-1]
    if pairs[gap]:
        a = lengths[2 * lengths >= gap]
        a = a[(a < gap) & (left[gap - a] > 0)]
        for x in a.tolist():
            if enough(left, size, x, gap - x):
                return x, gap - x
    a = lengths[lengths < gap]
    a = a[pairs[gap - a]]
    for x in a.tolist():
        rest = gap - x
        b = lengths[(2 * lengths >= rest) & (lengths < rest) & (lengths <= x)]
        for y in b[left[rest - b] > 0].tolist():
            if enough(left, size, x, y, rest - y):
                return x, y, rest - y
    return None


def enough(left: np.ndarray, *sizes: int) -> bool:
    return all(left[x] >= sizes.count(x) for x in set(sizes))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack what is left, longest first, each into the fullest sequence with room; equal sequences are handled as one."""
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        left[size] = 0
        while n:
            gap = min((g for g in open_bins if g >= size), default=None)
            if gap is None:
                times, parts, gap = n, [], capacity
            else:
                times, parts = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
            each = min(gap // size, n)
            used = min(times, n // each)
            if times > used and parts:
                open_bins.setdefault(gap, []).append((times - used, parts))
            open_bins.setdefault(gap - size * each, []).append((used, [*parts, (size, each)]))
            n -= used * each
    return [x for g in sorted(open_bins) for x in open_bins[g]]


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces. `order` names what tells the pieces of a length apart."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy(F.col(length).alias("__l")).agg(F.count("*").alias("__n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["__l"]] = r["__n"]
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    # at most `capacity` rows, so broadcasting them is safe at any size
    split = spark.createDataFrame([(r["__l"], -(-r["__n"] // GROUP_ROWS)) for r in sizes], "__l long, __s long")
    salted = pieces.withColumn("__l", F.col(length).cast("long")).join(F.broadcast(split), "__l").withColumn("__g", F.pmod(F.xxhash64(*order), F.col("__s")))
    ranked = salted.withColumn("__k", F.row_number().over(Window.partitionBy("__l", "__g").orderBy(*order)))
    groups = salted.groupBy("__l", "__g").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("__l").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("__l", "__g", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__f"))
    placed = ranked.join(first, ["__l", "__g"]).select(*pieces.columns, "__l", (F.col("__f") + F.col("__k") - 1).alias("__r"))
    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    n = len(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        key = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            size, rank = b.column(n).to_numpy(), b.column(n + 1).to_numpy()
            run = table[np.searchsorted(key, (size << 48) + rank, "right") - 1]
            k = rank - run[:, 1]
            # a run deals its pieces sequence by sequence
            sequence, offset = run[:, 3] + k // run[:, 2], run[:, 4] + k % run[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(n)), pa.array(sequence), pa.array(offset)], [f.name for f in schema])

    return placed.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, text: str, doc_id: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents. The pieces are stored once, as their lengths are needed twice."""
    pieces = token_pieces(documents.select(col(doc_id).alias("doc_id"), col(text).alias("text")), "text", ["doc_id"], tokenizer, capacity)
    return pack(shared_table(pieces, "pieces"), "length", ("doc_id", "piece", "start", "ids_crc32"), capacity)
