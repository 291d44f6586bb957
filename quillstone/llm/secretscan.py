"""Secrets: exact base patterns, and further tokens that pass a battery of randomness tests.

Base spans (assign, access, hex) follow fixed patterns and always stay. Other runs of token characters, and their pieces
between separators, are candidates. The smallest alphabet that holds a candidate is its inferred encoding, and each is tested
against two hypotheses. Drawn evenly from the encoding, it must not be refuted by any of four tests: chi-squared over the
symbols and over their classes, the number of runs of classes, and the serial correlation of neighbouring symbols. Ordinary,
it must be refuted by what two tests say together: more changes of class than words and identifiers have, and letters unlike
the corpus's own. Fisher's sum of the two gives its p-value; where the classes hardly change, the first alone does.

Longer tokens tell more than short ones, so false discoveries are controlled by encoding and band of length: within each of
these, the Benjamini-Hochberg rule at `FALSE_SHARE` over all candidates of the corpus sets the threshold. P-values are counted
in hundredths of a decimal digit, rounded up, so a table of bounded size gives the same thresholds however rows are dealt.

The corpus's symbol counts and class changes are sums over every text. Each text is scanned in time linear in it.

Defined cases: a null text is empty and has no spans; repeated rows get equal rows; an empty table gives an empty result; a
kept column with the name of an added one gives way to it; other columns pass through or are ignored, whatever their names.
Numbers without a letter are no candidates. A candidate that a base span touches is left to that span.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quillstone.llm.common import bound_batches, col, fresh, map_column, shared_table, slices, utf8

#: Kinds of span; the last one is added by the tests.
KINDS = ("assign", "access", "hex", "random")
LEAST = 16
#: Lengths at which a band begins.
BANDS = (16, 20, 24, 32, 48)
FALSE_SHARE = 0.01
#: A test refutes randomness below this.
REFUTED = 0.0025
#: Changes of class between neighbours that identifiers may have, whatever the corpus has.
ORDINARY_CHANGES = 0.2
#: An ordinary token may be mixed of classes, but a change test above this says that it is not.
TELLING = 0.25
#: Share of letters that words of an unknown kind draw evenly.
UNKNOWN = 0.2
#: Letters of a word depend on each other: the variance of their sum is taken this much larger.
DEPENDENCE = 2.0
#: Hundredths of decimal digits of the smallest p-value that is told apart.
MOST_SCORE = 30_000

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The encodings, the smaller alphabets first; each is given by its classes of symbols.
ENCODINGS = (
    (DIGIT, "abcdef"), (DIGIT, "ABCDEF"), (LOWER,), (UPPER,), (UPPER, "234567"), (LOWER, DIGIT), (UPPER, DIGIT), (LOWER, UPPER), (LOWER, UPPER, DIGIT),
    (LOWER, UPPER, DIGIT, "+/"), (LOWER, UPPER, DIGIT, "-_"),
)
CODES = LOWER + UPPER + DIGIT + "+/-_"

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
PIECE = re.compile(rf"[A-Za-z0-9]{{{LEAST},}}")
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, tokens: list[re.Match[str]]) -> list[Span]:
    """The fixed patterns' matches, leftmost and non-overlapping for each kind; `tokens` are the runs that may hold the last two."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if ":" in text or "=" in text else []
    for t in tokens:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, t.start(), t.end()) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, t.start(), t.end())]
    return sorted(out)


def candidates(text: str, tokens: list[re.Match[str]], base: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs without their padding, and the pieces between separators, that no base span touches."""
    starts, ends = sorted(a for a, _, _ in base), sorted(b for _, _, b in base)
    for m in tokens:
        whole = m[0].rstrip("=")
        spans = {(m.start(), m.start() + len(whole)), *((p.start(), p.end()) for p in PIECE.finditer(text, m.start(), m.end()))}
        for a, b in sorted(spans):
            if b - a >= LEAST and bisect_left(starts, b) == bisect_right(ends, a):
                yield a, b


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi_squared_tail(x: float, df: int) -> float:
    """Probability of a larger value, by the cube root's closeness to a normal."""
    return normal_tail(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def two_sided(p: float) -> float:
    return min(1.0, 2 * min(p, 1 - p))


def binomial_tail(n: int, k: int, p: float) -> float:
    """Probability of k or more of n, as a natural logarithm of its sum's terms from k on."""
    if k <= 0:
        return 1.0
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    total, j = 0.0, k
    while j <= n:
        term = math.exp(log(j))
        total += term
        if term <= total * 1e-12 and j > n * p:
            break
        j += 1
    return min(1.0, total)


def infer(token: str) -> int | None:
    """The first encoding whose alphabet holds the token; none for bare numbers and for mixtures."""
    held = frozenset(token)
    if held <= frozenset(DIGIT):
        return None
    return next((k for k, classes in enumerate(ENCODINGS) if held <= frozenset("".join(classes))), None)


def refutes_randomness(token: str, classes: tuple[str, ...]) -> bool:
    """Whether a test of the battery finds the token unlike even draws from the alphabet."""
    alphabet = "".join(classes)
    size, length = len(alphabet), len(token)
    counts = Counter(token)
    symbols = size / length * sum(n * n for n in counts.values()) - length
    found = [two_sided(chi_squared_tail(max(symbols, 1e-9), size - 1))]
    place = {c: k for k, c in enumerate(alphabet)}
    # one class is halved, so that it has runs as well
    cut = classes if len(classes) > 1 else (alphabet[: size // 2], alphabet[size // 2 :])
    kind = {c: k for k, own in enumerate(cut) for c in own}
    shares = [len(own) / size for own in cut]
    kinds = [kind[c] for c in token]
    by_kind = Counter(kinds)
    found.append(chi_squared_tail(max(1e-9, sum((by_kind[k] - length * s) ** 2 / (length * s) for k, s in enumerate(shares))), len(cut) - 1))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    q = 1 - sum(s * s for s in shares)
    linked = sum(s * (1 - s) ** 2 for s in shares) - q * q
    spread = math.sqrt((length - 1) * q * (1 - q) + 2 * (length - 2) * linked)
    found.append(two_sided(normal_tail((changes - (length - 1) * q) / spread)))
    mean, variance = (size - 1) / 2, (size * size - 1) / 12
    values = [place[c] - mean for c in token]
    serial = sum(a * b for a, b in zip(values, values[1:], strict=False)) / ((length - 1) * variance)
    found.append(two_sided(normal_tail(serial * math.sqrt(length - 1))))
    return min(found) < REFUTED


@dataclass(frozen=True)
class Ordinary:
    """How the corpus's words use symbols: counts in the order of CODES, and the share of neighbours that change class."""

    counts: tuple[int, ...]
    changes: float

    def p_value(self, token: str, encoding: int) -> float:
        """How likely an ordinary token is as unlike words: Fisher's sum of both tests, or that of changes alone if it says nothing."""
        classes = ENCODINGS[encoding]
        letters = [c.lower() for c in token if c.isalpha()]
        alphabet = sorted({c.lower() for own in classes for c in own if c.isalpha()})
        seen = {c: self.counts[CODES.index(c)] + self.counts[CODES.index(c.upper())] for c in alphabet}
        total, size = sum(seen.values()), len(alphabet)
        share = {c: (1 - UNKNOWN) * (n / total if total else 1 / size) + UNKNOWN / size for c, n in seen.items()}
        weight = {c: -math.log(size * p) for c, p in share.items()}
        mean = sum(p * weight[c] for c, p in share.items())
        variance = sum(p * (weight[c] - mean) ** 2 for c, p in share.items())
        z = (sum(weight[c] for c in letters) - len(letters) * mean) / math.sqrt(DEPENDENCE * len(letters) * variance + 1e-12)
        symbols = max(normal_tail(z), 1e-300)
        if len(classes) == 1:
            return symbols
        kind = {c: k for k, own in enumerate(classes) for c in own}
        changes = sum(kind[a] != kind[b] for a, b in zip(token, token[1:], strict=False))
        mixed = max(binomial_tail(len(token) - 1, changes, max(self.changes, ORDINARY_CHANGES)), 1e-300)
        if mixed > TELLING:
            return mixed
        both = math.log(symbols) + math.log(mixed)
        return min(1.0, math.exp(both) * (1 - both))

    def judged(self, token: str) -> tuple[int, int] | None:
        """Stratum and score of a candidate; a score of 0 if it is not random."""
        encoding = infer(token)
        if encoding is None:
            return None
        stratum = encoding * len(BANDS) + bisect_right(BANDS, len(token)) - 1
        if refutes_randomness(token, ENCODINGS[encoding]):
            return stratum, 0
        p = max(self.p_value(token, encoding), 1e-300)
        return stratum, min(MOST_SCORE, int(-100 * math.log10(p)))


def ordinary(documents: DataFrame, text: str) -> Ordinary:
    """Sums over every text: each task's counts are one row."""
    bound_batches(documents.sparkSession)
    code = np.full(256, len(CODES), np.uint8)
    code[list(CODES.encode())] = np.arange(len(CODES))
    kind = np.full(256, 4, np.uint8)
    for k, own in enumerate((LOWER, UPPER, DIGIT, "+/-_")):
        kind[list(own.encode())] = k
    schema = StructType([StructField("counts", ArrayType(LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(CODES) + 2, np.int64)
        for b in batches:
            raw, ends = utf8(b.column(0))
            for first, last in slices(ends, 1 << 20):
                for at in range(int(ends[first]), int(ends[last]), 1 << 20):
                    # one byte more, for the pair across the cut; texts are apart by chance only, which no share feels
                    part = raw[at : min(at + (1 << 20) + 1, int(ends[last]))]
                    total[: len(CODES)] += np.bincount(code[part[: 1 << 20]], minlength=len(CODES) + 1)[: len(CODES)]
                    k = kind[part]
                    within = (k[:-1] < 4) & (k[1:] < 4)
                    total[-2] += int(within.sum())
                    total[-1] += int((within & (k[:-1] != k[1:])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], schema.names)

    parts = documents.select(F.coalesce(col(text), F.lit("")).alias("t")).mapInArrow(count, schema)
    sums = {r["k"]: r["n"] for r in parts.select(F.posexplode("counts").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("n")).collect()}
    counts = [int(sums.get(k, 0)) for k in range(len(CODES) + 2)]
    return Ordinary(tuple(counts[:-2]), counts[-1] / counts[-2] if counts[-2] else 0.0)


def scan(text: str, model: Ordinary) -> tuple[list[Span], list[tuple[int, int, int, int]]]:
    """Base spans, and start, end, stratum and score of the candidates; of those that overlap the one with the best score."""
    tokens = list(TOKEN.finditer(text))
    base = base_spans(text, tokens)
    found = []
    for a, b in candidates(text, tokens, base):
        known = model.judged(text[a:b])
        if known:
            found.append((a, b, *known))
    kept: list[tuple[int, int, int, int]] = []
    for c in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0])):
        k = bisect_left(kept, (c[0],))
        if not (k and kept[k - 1][1] > c[0]) and not (k < len(kept) and kept[k][0] < c[1]):
            kept.insert(k, c)
    return base, kept


SPAN = StructType([StructField("start", IntegerType()), StructField("kind", IntegerType()), StructField("end", IntegerType())])
CANDIDATE = StructType([*(StructField(c, IntegerType()) for c in ("start", "end", "stratum", "score"))])
ADDED = [*(StructField(f"n_{k}", LongType()) for k in KINDS[:3]), StructField("base_sha256", StringType()), StructField("base", ArrayType(SPAN)), StructField("found", ArrayType(CANDIDATE))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(documents: DataFrame, text: str, keep: list[str], model: Ordinary) -> DataFrame:
    """`keep` and ADDED."""
    span = pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN]))
    candidate = pa.list_(pa.struct([(f.name, pa.int32()) for f in CANDIDATE]))

    def make(column: pa.Array) -> list[pa.Array]:
        found = [scan(t.as_py(), model) for t in column]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
        digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        bases = pa.array([[dict(zip(SPAN.names, s, strict=True)) for s in base] for base, _ in found], span)
        return [*counts, digests, bases, pa.array([[dict(zip(CANDIDATE.names, c, strict=True)) for c in more] for _, more in found], candidate)]

    return map_column(documents, keep, F.coalesce(col(text), F.lit("")), ADDED, make)


def thresholds(rows: DataFrame, share: float = FALSE_SHARE) -> list[int]:
    """The least score of a discovery in each stratum; rows are scanned ones. One grouped count, of bounded size, is gathered."""
    counted = rows.select(F.explode("found").alias("c")).groupBy("c.stratum", "c.score").agg(F.count("*").alias("n")).collect()
    out = [MOST_SCORE + 1] * (len(ENCODINGS) * len(BANDS))
    for stratum in range(len(out)):
        mine = sorted(((r["score"], r["n"]) for r in counted if r["stratum"] == stratum), reverse=True)
        whole, rank = sum(n for _, n in mine), 0
        for score, n in mine:
            rank += n
            if score > 0 and 10 ** (-score / 100) <= share * rank / whole:
                out[stratum] = score
    return out


def discovered(least: list[int]) -> Column:
    """The candidates of a scanned row that are discoveries, as spans."""
    limits = F.array(*map(F.lit, least))
    good = F.filter("found", lambda c: c["score"] >= F.get(limits, c["stratum"]))
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))


def annotate(documents: DataFrame, text: str, keep: list[str], share: float = FALSE_SHARE) -> DataFrame:
    """`keep`, n_assign, n_access, n_hex, base_sha256, n_random and spans. What a scan finds is stored, texts are not."""
    added = [*(f.name for f in ADDED), "n_random", "spans"]
    keep = [c for c in keep if c not in added]
    private = documents.select(*(col(c).alias(f"__k{n}") for n, c in enumerate(keep)), col(text).alias("__text"))
    rows = shared_table(scanned(private, "__text", [f"__k{n}" for n in range(len(keep))], ordinary(documents, text)), "secrets")
    more = discovered(thresholds(rows, share))
    every = F.array_sort(F.concat("base", more))
    names = F.array(*map(F.lit, KINDS))
    shown = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(*(F.col(f"__k{n}").alias(c) for n, c in enumerate(keep)), *(f.name for f in ADDED[:4]), F.size(more).cast("long").alias("n_random"), shown.alias("spans"))


def masked_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by one mark."""
    if text is None or not spans:
        return text
    out, end = [], 0
    for k, (a, _, b) in enumerate(spans):
        if k and a < end:
            end = max(end, b)
            continue
        out += [text[end:a], "[SECRET]"]
        end = b
    return "".join([*out, text[end:]])


def mask(documents: DataFrame, text: str, share: float = FALSE_SHARE) -> DataFrame:
    """`documents` with the same columns, secrets in `text` replaced by marks; a null text stays null."""
    model, whole = ordinary(documents, text), documents.columns
    name = fresh(whole, "__text")
    least = thresholds(scanned(documents.select(col(text).alias(name)), name, [], model), share)

    def clean(column: pa.Array) -> list[pa.Array]:
        out = []
        for t in column:
            raw = t.as_py()
            base, more = scan(raw or "", model)
            out.append(masked_text(raw, sorted([*base, *((a, len(KINDS) - 1, b) for a, b, k, s in more if s >= least[k])])))
        return [pa.array(out, pa.string())]

    return map_column(documents, whole, col(text), [StructField(text, StringType())], clean).select(*(col(c) for c in whole))
