"""Token ids of whole texts with a public tokenizer, made word by word where the tokenizer allows it.

A tokenizer that splits at white space before anything else gives a text the ids of its words in a row. Each worker then
keeps the ids of common short words as bytes and asks the tokenizer for the others only. Texts in which that shortcut
would not hold (special tokens' strings, control characters that Python alone takes for white space) are encoded whole,
and so is every text if the tokenizer's own description is not the one that the shortcut was made for.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from pathlib import Path

import numpy as np

#: Words kept by a worker; beyond it the table starts anew. Longer words than LONGEST are not kept.
KEPT_WORDS = 1_000_000
LONGEST = 48
WHOLE = re.compile("<\\||[\x1c-\x1f]")


#: What a description must say of splitting for the shortcut to hold: white space is one blank, case is lowered, and the
#: pieces between blanks are runs of letters, single digits and other runs.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def wordwise(description: dict) -> bool:
    """Whether the ids of a text are those of its words in a row."""
    before, split = description.get("normalizer") or {}, (description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = before.get("normalizers") == NORMALIZER and split[0].get("pattern") == {"Regex": PIECES} and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
    bytewise = len(split) == 2 and split[1].get("type") == "ByteLevel" and split[1].get("add_prefix_space") is False
    special = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in description.get("added_tokens") or [])
    return same and bytewise and special and description["model"].get("end_of_word_suffix") == "</w>" and description.get("post_processor") is None


class WordEncoder:
    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.wordwise = wordwise(json.loads(content))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id ends a word; a word of letters has exactly one such id, its last.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.wordwise or WHOLE.search(text):
            return self.whole([text])[0]
        words = text.split()
        found = list(map(self.kept.get, words))
        if None in found:
            new = self.learn({w for w, x in zip(words, found, strict=True) if x is None})
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """A word of letters before one full stop or comma has the ids of both parts, and case does not matter in ASCII."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        parts = {}
        for w in words:
            low = w.lower() if w.isascii() else w
            parts[w] = (low[:-1], low[-1]) if low[-1] in ".," and low[-2:-1] < "\u0100" and low[:-1].isalpha() else (low,)
        bases = {x for p in parts.values() for x in p}
        ids = {x: self.kept[x] for x in bases if x in self.kept}
        letters = [x for x in bases if x not in ids and x.isalpha()]
        others = [x for x in bases if x not in ids and not x.isalpha()]
        ids |= zip(others, self.whole(others), strict=True)
        if letters:
            together = np.frombuffer(self.whole([" ".join(letters)])[0], "<u4")
            cut = [0, *(4 * (np.flatnonzero(self.ends[together]) + 1)).tolist()]
            raw = together.tobytes()
            if len(cut) == len(letters) + 1:
                ids |= {x: raw[a:b] for x, a, b in zip(letters, cut[:-1], cut[1:], strict=True)}
            else:  # a letter whose lower case holds a mark, say, makes two words of one
                ids |= zip(letters, self.whole(letters), strict=True)
        new = {w: b"".join([ids[x] for x in p]) for w, p in parts.items()}
        self.kept.update((w, x) for w, x in (ids | new).items() if len(w) <= LONGEST)
        return new

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(content: str) -> WordEncoder:
    """The encoder of a tokenizer's description; a worker makes it once."""
    if content not in _ENCODERS:
        _ENCODERS[content] = WordEncoder(content)
    return _ENCODERS[content]


def described(path: str) -> str:
    """A tokenizer's description, which the driver reads and sends to the workers."""
    return Path(path).read_text(encoding="utf-8")


def encoder(path: str) -> WordEncoder:
    return encoder_of(described(path))
