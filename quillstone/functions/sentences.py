"""Sentence boundaries by Unicode's default rules, and spans that keep off atomic ranges. All offsets are UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import regex

#: Fixed values of Unicode: the sentence-break properties that the default rules name, by one letter each.
PROPERTIES = {
    "R": "CR", "F": "LF", "S": "Sep", "P": "Sp", "L": "Lower", "U": "Upper", "O": "OLetter", "N": "Numeric",
    "A": "ATerm", "C": "SContinue", "T": "STerm", "E": "Close",
}
_KIND = {k: regex.compile(rf"\p{{Sentence_Break={v}}}") for k, v in PROPERTIES.items()}
_JOINED = regex.compile(r"[\p{Sentence_Break=Extend}\p{Sentence_Break=Format}]")
#: A terminator with what may follow it, or the end of a paragraph.
_STOP = regex.compile(r"(?P<term>[AT])X*+(?P<close>(?:EX*+)*+)(?P<space>(?:PX*+)*+)(?P<para>RF|[RFS])?|RF|[RFS]")
#: What lets a text go on after a full stop: a lower-case letter before any other letter, end or terminator.
_GOES_ON = regex.compile(r"[^OULRFSAT]*+L")


class _Kinds(dict):
    """The letter of each character's property, by its number; it fills itself as characters are met."""

    def __missing__(self, number: int) -> str:
        if len(self) > 100_000:
            self.clear()
        char = chr(number)
        self[number] = found = "X" if _JOINED.match(char) else next((k for k, p in _KIND.items() if p.match(char)), "-")
        return found


_KINDS = _Kinds()


def breaks(text: str) -> list[int]:
    """Character offsets at which a sentence ends, the last one being the text's end."""
    if not text:
        return []
    kinds = text.translate(_KINDS)
    out = []
    for m in _STOP.finditer(kinds):
        at = m.end()
        if at == len(kinds):
            break
        if m["term"] and not m["para"]:
            after = kinds[at]
            bare = not m["close"] and not m["space"]
            if after in "CAT":
                continue
            if m["term"] == "A":
                before = kinds[: m.start()].rstrip("X")[-1:] if kinds[m.start() - 1 : m.start()] == "X" else kinds[m.start() - 1 : m.start()]
                if bare and (after == "N" or (after == "U" and before in ("U", "L"))):
                    continue
                if _GOES_ON.match(kinds, at):
                    continue
        out.append(at)
    return [*out, len(text)]


def byte_offsets(text: str, at: Sequence[int]) -> list[int]:
    """Ascending character offsets as byte offsets."""
    if text.isascii():
        return list(at)
    out, last, size = [], 0, 0
    for k in at:
        size += len(text[last:k].encode())
        last = k
        out.append(size)
    return out


def pushed(boundary: int, atomic: Iterable[tuple[int, int]]) -> int:
    """A boundary inside an atomic range goes to its nearer edge, and to its end from the middle."""
    for start, end in atomic:
        if start < boundary < end:
            return start if boundary - start < end - boundary else end
    return boundary


def spans(text: str, atomic: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Byte spans of the sentences; they are contiguous, none is empty, and a blank text has none."""
    if not text.strip():
        return []
    out, start = [], 0
    ranges, k = sorted(atomic), 0
    for b in byte_offsets(text, breaks(text)):
        while k < len(ranges) and ranges[k][1] <= b:
            k += 1
        end = pushed(b, ranges[k : k + 1])
        if end > start:
            out.append((start, end))
            start = end
    return out
