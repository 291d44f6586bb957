"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter, and the form each one leads to.

Words that are one edit apart keep one half whole, so the index is dealt to tasks by halves: a word of length L stands under
its halves as the longer of a pair (level L) and as the shorter one (level L + 1). A group that is too large for one task is
refined: the part that may differ is halved once more, until it is one letter and the group as large as the alphabet. No
group is dropped, cut or compared block by block.

Within a group, the bigrams around the part that may differ are posted by gram and position. A word's posting lists are
heap-merged; positions must agree, or differ by the one letter that the shorter word lacks. One edit touches Q grams at most,
so a candidate must share all but Q of the longer one's grams. Candidates over that bound are verified. A pair is reported in
the group that holds the last place where its edit may be, which is one group alone.

Counting is done by text: a document's equal runs are one entry, a batch's equal words one row, and Spark sums them up.

Defined cases: a null text has no words, and a null id counts as the empty id; repeated rows count again; an empty table gives
an empty result; other columns are ignored, whatever their names. Words of any length take part. Words with one edit between
them are near whatever their counts; chains of forms end, as each form occurs twice as often as the word before it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillstone.llm.common import bound_batches, col, drop_table, shared_table

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One in so many runs of a document loses a letter.
DAMAGE = 97
Q = 2
#: A group of more rows than this is refined by Spark, one of more than SMALL within its task.
LARGE = 20_000
SMALL = 64
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
LOWER = {c: c + 32 for c in range(65, 91)}

POSTING = StructType([StructField("key", StringType()), StructField("r", IntegerType()), StructField("o", IntegerType()), StructField("longer", IntegerType()), StructField("word", StringType()), StructField("n", LongType())])
PAIR = StructType([*POSTING.fields, StructField("near", StringType()), StructField("near_n", LongType())])


def runs_of(doc_id: str | None, text: str) -> Counter[str]:
    """How often each word of at least LEAST_LETTERS is in a text, damaged runs as what is left of them."""
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in Counter(m[0] for m in RUN.finditer(text)).items():
        word = run.lower() if run.isascii() else run.translate(LOWER)
        h = zlib.crc32(word.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LETTERS:
                continue
        out[word] += n
    return out


def count_words(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """word and n of every word that occurs LEAST_COUNT times or more."""
    bound_batches(documents.sparkSession)
    rows = documents.where(col(text).isNotNull()).select(col(doc_id).cast("string").alias("id"), col(text).alias("text"))
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[str] = Counter()
            for d, t in zip(b.column(0), b.column(1), strict=True):
                seen.update(runs_of(d.as_py(), t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema.names)

    return rows.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def refined(postings: DataFrame) -> DataFrame:
    """Each posting under either half of its rest: the first half stays and the other may differ, or the other way round.

    `r` is the length of the rest in the longer word of a pair and `o` where it begins; in the shorter one it lacks a letter.
    """
    have = F.col("r") - F.when(F.col("longer") == 1, 0).otherwise(1)
    half = F.floor(F.col("r") / 2).cast("int")
    rest = F.substring("word", F.col("o") + 1, have)
    first = F.struct(F.concat("key", F.lit("<"), F.substring(rest, F.lit(1), half)).alias("key"), (F.col("r") - half).alias("r"), (F.col("o") + half).alias("o"))
    second = F.struct(F.concat("key", F.lit(">"), F.substring(rest, have - (F.col("r") - half) + 1, F.col("r") - half)).alias("key"), half.alias("r"), F.col("o"))
    # a rest of one letter cannot be halved
    halves = F.when(F.col("r") > 1, F.array(first, second)).otherwise(F.array(F.struct("key", "r", "o")))
    return postings.select(F.explode(halves).alias("x"), "longer", "word", "n").select("x.key", "x.r", "x.o", "longer", "word", "n")


def postings(words: DataFrame) -> DataFrame:
    """Every word under its halves, as the longer and as the shorter word of a pair."""
    size = F.length("word")
    roles = F.array(*(F.struct((size + 1 - k).alias("r"), F.lit(k).alias("longer")) for k in (1, 0)))
    whole = words.select(F.explode(roles).alias("x"), "word", "n")
    return refined(whole.select(F.col("x.r").cast("string").alias("key"), "x.r", F.lit(0).alias("o"), "x.longer", "word", "n"))


Entry = tuple[str, int, bool]  # word, n, whether it is the longer


def halves(members: list[Entry], r: int, o: int) -> Iterator[tuple[list[Entry], int, int]]:
    """The same refinement within a task."""
    half = r // 2
    for first in (True, False):
        found = defaultdict(list)
        for e in members:
            end = o + r - (not e[2])
            found[e[0][o : o + half] if first else e[0][end - (r - half) : end]].append(e)
        for group in found.values():
            if len(group) > 1:
                yield group, *((r - half, o + half) if first else (half, o))


def near(members: list[Entry], r: int, o: int) -> Iterator[tuple[Entry, Entry]]:
    """Pairs one edit apart among the members of a group, of which one at least is a longer word."""
    if len(members) > SMALL and r > 1:
        for group, s, p in halves(members, r, o):
            yield from near(group, s, p)
        return
    longer = [e for e in members if e[2]]
    if not longer or len(members) < 2:
        return
    left = max(0, o - 1)
    windows = [w[left : o + r + 1] for w, _, _ in longer]
    least = len(windows[0]) - (Q - 1) - Q  # grams of the longer word, but for those that one edit touches
    index: dict[tuple[str, int], list[int]] = defaultdict(list)
    if least > 0:
        for k, w in enumerate(windows):
            for p in range(len(w) - Q + 1):
                index[w[p : p + Q], p].append(k)
    place = 0
    for e in members:
        w, _, is_longer = e
        if least > 0:
            own = w[left : o + r + is_longer]
            lists = []
            for p in range(len(own) - Q + 1):
                gram = own[p : p + Q]
                lists += [index[gram, at] for at in ((p,) if is_longer else (p, p + 1)) if (gram, at) in index]
            found: Iterator[int] = (k for k, same in groupby(merge(*lists)) if sum(1 for _ in same) >= least)
        else:
            found = iter(range(len(longer)))
        for k in found:
            if is_longer and k >= place:
                break
            if one_edit(longer[k][0], w, r, o):
                yield longer[k], e
        place += is_longer


def one_edit(a: str, b: str, r: int, o: int) -> bool:
    """Whether b, as long as a or a letter shorter, is one edit from a, the last place for it being in a[o : o + r].

    The words agree beyond that part.
    """
    end, shorter = o + r, len(a) - len(b)
    at = o
    while at < end and at < len(b) and a[at] == b[at]:
        at += 1
    return at < end and a[at + 1 : end] == b[at + 1 - shorter : end - shorter] and (at < len(b) or shorter == 1)


def search_groups(rows: DataFrame) -> DataFrame:
    """Both directions of each near pair; the postings of a group that is too large come back with no `near`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, large, out = None, False, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key:
                    out += solved(held)
                    held, key, large = [], row[0], False
                if large:
                    out.append((*row, None, None))
                else:
                    held.append(row)
                    if len(held) > LARGE and row[1] > 1:
                        out += [(*x, None, None) for x in held]
                        held, large = [], True
                if len(out) >= 1 << 14:
                    yield batch(out)
                    out = []
        yield batch(out + solved(held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, PAIR)


def solved(held: list[tuple]) -> list[tuple]:
    if len(held) < 2:
        return []
    _, r, o, _, _, _ = held[0]
    out = []
    for a, b in near([(w, n, bool(x)) for _, _, _, x, w, n in held], r, o):
        out += [(None, None, None, None, a[0], a[1], b[0], b[1]), (None, None, None, None, b[0], b[1], a[0], a[1])]
    return out


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], PAIR.names)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near and near_n: a row for either direction of each pair of `words` (word, n) that is one edit apart."""
    found, open_rows = None, postings(words)
    while True:
        part = shared_table(search_groups(open_rows), "near")
        pairs = part.where("near is not null").select("word", "n", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
        too_large = part.where("near is null").select(*POSTING.names)
        if too_large.isEmpty():
            return found
        open_rows = refined(too_large)


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form: pointers are doubled until none moves; each round is stored."""
    up = shared_table(forms.select("word", F.col("form").alias("up")), "roots")
    while True:
        over = up.select(F.col("word").alias("w"), F.col("up").alias("further"))
        step = shared_table(up.join(over, up["up"] == over["w"], "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_table(up)
        up = step
        if up.where("moved").isEmpty():
            return up.select("word", F.col("up").alias("root"))


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word."""
    rank = F.struct((-F.col("near_n")).alias("minus"), F.col("near"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(rank).alias("b"))
    strong: Column = -F.col("b.minus") >= 2 * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("b.near")).alias("form"), F.when(strong, -F.col("b.minus")).alias("form_n"),
    )
    rows = shared_table(rows, "forms")
    led = roots(rows.where("form is not null"))
    return rows.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The words of all texts with their forms and roots."""
    return forms(shared_table(count_words(documents, text, doc_id), "words")).select("word", "form", "root", "n", "n_near", "form_n")
