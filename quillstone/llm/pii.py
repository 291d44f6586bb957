"""Personal data: exact base patterns, and spans that boosted trees select among high-recall candidates.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. On top of them, generators propose further,
overlapping spans in looser formats; for each kind, boosted trees look at the span's format and at the text around it,
a calibrated threshold decides, and of spans that overlap the most probable one stays. No labelled personal data exist here,
so the trees are fitted on a fixed number of examples that are written by rule (`EXAMPLES` of each kind), with look-alikes
such as dates, versions and order numbers; the tests hold other formats.

Every pattern is scanned in time linear in the text, whatever it holds. Defined cases: a null text is empty and has no
spans; empty texts and repeated rows likewise get equal rows; a kept column with the name of an added one gives way to it;
other columns are ignored or pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from quillstone.llm.boosting import BoostedTrees
from quillstone.llm.common import col, map_column

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 1200
#: A threshold is the lowest probability from which this share of the calibration examples above it is right.
PRECISION = 0.98
Span = tuple[int, int, int]  # start, kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@\]})]|::|\s(?:dot|DOT)\s|(?<=\s)(?:at|AT)\s+[A-Za-z0-9-]+\.")

HIDDEN_AT = re.compile(r"[\[({]\s?(?:at|AT)\s?[\])}]|(?<=\s)(?:at|AT)(?=\s)")
HIDDEN_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s|\s?\.\s?)[A-Za-z0-9-]{1,63})+")
HEX_GROUPS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,15}(?<![^:]:)(?![0-9A-Za-z:])")
#: Ends of mail domains that are common.
ENDS = frozenset("com org net edu gov info biz io de fr es uk it nl eu us ca ch at be pl se".split())
LOOSE_RUN = re.compile(r"\(?[0-9]++(?:[\x20().\-/]{1,2}[0-9]++)*+")
GROUP = re.compile(r"[0-9]++")
#: Digits of the longest card and of the longest phone number.
MOST_DIGITS = 19
BRACKETED = re.compile(r"[\[({]\s?(?:at|AT)\s?[\])}]")
DOTS = re.compile(r"\b(?:dot|DOT)\b")
CUES = (
    re.compile(r"(?:mail|contact|write|reach)\W*$", re.I),
    re.compile(r"(?:tel|phone|call|mobile|cell|fax|dial|whatsapp|sms)\w*\W*$", re.I),
    re.compile(r"(?:card|visa|master\w*|amex|credit|pay\w*|charge\w*)\W*$", re.I),
    re.compile(r"(?:ip|host|server|address|ping|ipv6)\W*$", re.I),
    re.compile(r"(?:order|invoice|no|nr|id|ref\w*|isbn|version|v|sku|ticket|page|serial|room|date|on|since|part)\W*$", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in PARTS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, at + size))
            at += size + 1
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PLUS.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: Sequence[Span] = ()) -> list[Span]:
    """Looser spans that may overlap each other, but no base span: hidden addresses, hexadecimal groups, and digit groups as card and as phone.

    Each run of digit groups gives the spans from every group to every later one within the digits of a number, so that
    neighbouring numbers don't hide each other. What would reach into a base span ends before it.
    """
    out: list[Span] = []
    starts, ends = sorted(a for a, _, _ in base), sorted(b for _, _, b in base)
    # base spans that begin before the end, and that end by the start: as many of both where none overlaps
    free = lambda a, b: bisect_left(starts, b) == bisect_right(ends, a)
    for m in HIDDEN_AT.finditer(text):
        k = bisect_left(starts, m.end())
        d = HIDDEN_DOMAIN.match(text, m.end(), starts[k] if k < len(starts) else len(text))
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        k = bisect_right(ends, start)
        first, least = start, ends[k - 1] if k else 0
        while first > least and start - first < 64 and text[first - 1] in LOCAL:
            first -= 1
        if d and first < start and free(first, d.end()):
            out.append((first, 0, d.end()))
    if ":" in text:
        out += [(m.start(), 1, m.end()) for m in HEX_GROUPS.finditer(text) if free(m.start(), m.end())]
    for m in LOOSE_RUN.finditer(text):
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            start, n = a - (text[a - 1 : a] == "("), 0
            for c, b in groups[i:]:
                n += b - c
                if n > MOST_DIGITS or bisect_left(starts, b) != bisect_right(ends, start):
                    break
                if n >= 12:
                    out.append((start, 2, b))
                if 7 <= n <= 15:
                    out.append((start, 3, b))
    return out


def features(text: str, span: Span) -> list[float]:
    start, _, end = span
    own, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    digits = "".join(c for c in own if c.isdigit())
    groups = [len(g) for g in re.findall(r"[0-9A-Fa-f]+", own)]
    year = bool(re.search(r"(?:19|20)[0-9]{2}(?![0-9])", own))
    return [
        len(digits), len(own), len(groups), max(groups, default=0), min(groups, default=0), float(bool(groups) and len(set(groups)) == 1),
        own.count(" "), own.count("-"), own.count("."), own.count("/"), own.count("("), own.count(":"), own.count("::"),
        float(bool(re.search("[a-fA-F]", own))), float(bool(BRACKETED.search(own))), len(DOTS.findall(own)), float(own.rpartition(" ")[2].rpartition(".")[2].lower() in ENDS), float(". " in own),
        float(len(digits) >= 2 and luhn(digits)), float(digits[:1] == "0"), float(digits[:1] in ("4", "5", "3", "6") and digits != ""), float(year),
        *(float(bool(c.search(before))) for c in CUES), float(before[-1:].isalnum() or before[-1:] in ("-", ".", "/")), float(after[:1].isalnum() or (after[:1] in ("-", ".", "/") and after[1:].isdigit())),
    ]


def examples(kind: int, n: int, seed: int) -> Iterator[tuple[str, Span, int]]:
    """Written cases: text, candidate span and whether it is personal data."""
    r = random.Random(1000 * seed + kind)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9)))
    cues = (("mail ", "contact: ", "write to "), ("server ", "IP ", "host "), ("card ", "Visa: ", "pay with "), ("tel. ", "phone: ", "call ", "mobile "))[kind]
    phone = lambda: r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"))
    wrong = ("order ", "invoice no. ", "id ", "version ", "on ", "ref ", "ISBN ", "page ", "ticket ", "")
    for _ in range(n):
        y = r.random() < 0.5
        lead = r.choice(cues) if r.random() < (0.7 if y else 0.04) else (r.choice(wrong) if r.random() < (0.03 if y else 0.8) else "")
        if kind == 0:
            end = r.choice(sorted(ENDS))
            if y:
                own = r.choice((f"{word()}[at]{word()}[dot]{end}", f"{word()}.{word()}[at]{word()}.{end}", f"{word()} at {word()} dot {end}", f"{word()}{digits(2)}[at]{word()} dot {end}"))
                own = own.replace("[at]", r.choice((" [at] ", "[at]", "(at)", " (at) ", " {at} "))).replace("[dot]", r.choice((" [dot] ", "[dot]", "(dot)", ".")))
            else:
                own = r.choice((f"{word()} (at) {word()}. {word()}", f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{end}", f"{word()} at {word()} dot {word()}", f"{word()} at {digits(1)}.{digits(2)}"))
        elif kind == 1:
            group = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
            n = r.randint(1, 4)
            if y:
                own = r.choice((":".join(group() for _ in range(8)), f"2001:{':'.join(group() for _ in range(n))}::{group()}", f"fe80::{':'.join(group() for _ in range(n))}", f"{group()}:{group()}:{group()}::{group()}"))
            else:
                own = r.choice((":".join(digits(2) for _ in range(r.choice((3, 4, 5, 6)))), f"{digits(1)}::{digits(1)}", f"{r.choice('abcdef')}::{r.choice('abcdef')}", f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(3)}", ":".join(group()[:2].rjust(2, "a") for _ in range(6))))
        elif kind == 2:
            cuts = r.choice(((4, 8, 12), (4, 8, 12), (4, 10)))
            body = r.choice("3456") + digits(14 if len(cuts) == 3 else 13)
            body += next(c for c in "0123456789" if luhn(body + c)) if y else r.choice([c for c in "0123456789" if not luhn(body + c)])
            sep = r.choice((".", " ", "-", "/", ""))
            own = sep.join(body[a:b] for a, b in zip((0, *cuts), (*cuts, len(body)), strict=True))
        elif y:
            a, b, c = digits(3), digits(3), digits(4)
            own = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)}/{digits(6)}", f"00{digits(2)} {digits(3)} {digits(6)}", f"0{digits(1)} " + " ".join(digits(2) for _ in range(4)), f"0{digits(3)} {digits(3)} {digits(3)}"))
        else:
            own = r.choice((f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}.0{digits(1)}.19{digits(2)}", digits(r.randint(7, 13)), f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(2)}", f"{digits(4)} {digits(4)}", f"{digits(1)}.{digits(2)}.{digits(5)}"))
        left = f"{word()} {word()}. {lead}"
        tail = f"{r.choice((' ', '. ', ', ', '; '))}{word()}"
        span = (len(left), kind, len(left) + len(own))
        if kind >= 2 and r.random() < 0.5:
            # numbers in a row: one of them whole is right, and a piece, or one with a part of its neighbour, is wrong
            other = r.choice((phone(), own if y else phone(), f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}.0{digits(1)}.19{digits(2)}"))
            first = r.random() < 0.5
            row = f"{own} {other}" if first else f"{other} {own}"
            at = len(left) + (0 if first else len(other) + 1)
            span, tail = (at, kind, at + len(own)), f"{row[len(own) :] if first else ''}{tail}"
            left = left if first else f"{left}{other} "
            if not y or r.random() < 0.5:
                beside = at + len(own) + 1 if first else at - len(other) - 1
                whole = {(at, at + len(own)), (beside, beside + len(other))}
                pieces = [c for c in candidates(left + own + tail) if c[1] == kind and (c[0], c[2]) not in whole]
                if pieces:
                    span, y = r.choice(pieces), False
        yield left + own + tail, span, int(y)


@lru_cache(maxsize=1)
def detector() -> tuple[tuple[BoostedTrees, float], ...]:
    """Trees and threshold of each kind; it takes a second or two, and each worker keeps what the driver sent."""
    out = []
    for kind in range(len(KINDS)):
        sets = []
        for seed in (1, 2):
            rows = list(examples(kind, EXAMPLES, seed))
            sets.append((np.array([features(t, s) for t, s, _ in rows]), np.array([y for _, _, y in rows], float)))
        trees = BoostedTrees(rounds=20).fit(*sets[0]).calibrate(*sets[1])
        p, y = trees.probability(sets[1][0]), sets[1][1]
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= PRECISION
        last = np.flatnonzero(good)
        out.append((trees, max(0.5, float(p[order][last[-1]])) if len(last) else 2.0))
    return tuple(out)


def find(texts: list[str], trees: tuple[tuple[BoostedTrees, float], ...]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base, proposed = [], []
    for k, t in enumerate(texts):
        if not HINT.search(t):
            base.append([])
            continue
        base.append(base_spans(t))
        # what a base span covers is redacted already
        proposed += [(k, s) for s in candidates(t, base[-1])]
    likely: dict[int, list[tuple[float, Span]]] = {}
    for kind, (model, threshold) in enumerate(trees):
        mine = [(k, s) for k, s in proposed if s[1] == kind]
        if mine:
            p = model.probability(np.array([features(texts[k], s) for k, s in mine]))
            for (k, s), x in zip(mine, p, strict=True):
                if x >= threshold:
                    likely.setdefault(k, []).append((float(x), s))
    return [(b, sorted({*b, *best_apart(likely[k])}) if k in likely else b) for k, b in enumerate(base)]


def best_apart(likely: list[tuple[float, Span]]) -> list[Span]:
    """Of spans that overlap, the most probable one; of equal ones the longer, then the earlier."""
    out: list[Span] = []
    for _, s in sorted(likely, key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
        k = bisect_left(out, (s[0],))
        if not (k and out[k - 1][2] > s[0]) and not (k < len(out) and out[k][0] < s[2]):
            out.insert(k, s)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the mark of its first span's kind."""
    out, end = [], 0
    for k, (a, kind, b) in enumerate(spans):
        if k and a < end:
            end = max(end, b)
            continue
        out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def annotate(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep`, n_email, n_ip, n_card, n_phone, base_sha256, spans and redacted (null where nothing is to be replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(detector())
    added = [*(StructField(f"n_{k}", LongType()) for k in KINDS), *(StructField(n, StringType()) for n in ("base_sha256", "spans", "redacted"))]

    def scan(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        found = find(texts, shared.value)
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        clean = [redacted(t, s) if s else None for t, (_, s) in zip(texts, found, strict=True)]
        return [*counts, pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string()), pa.array(clean, pa.string())]

    return map_column(documents, keep, F.coalesce(col(text), F.lit("")), added, scan)


def redact(documents: DataFrame, text: str) -> DataFrame:
    """`documents` with the same columns, personal data in `text` replaced by marks; a null text stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(detector())
    whole = documents.columns

    def clean(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        found = find([t or "" for t in texts], shared.value)
        return [pa.array([redacted(t, s) if t is not None and s else t for t, (_, s) in zip(texts, found, strict=True)], pa.string())]

    return map_column(documents, whole, col(text), [StructField(text, StringType())], clean).select(*(col(c) for c in whole))
