"""String, hash and distance functions as Column expressions (no UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and aliases of the known formats.
FORMATS = {
    "md": "markdown", "markdown": "markdown", "mdown": "markdown", "mkd": "markdown", "docx": "docx", "tex": "latex", "latex": "latex",
    "html": "html", "htm": "html", "txt": "plain", "text": "plain", "plain": "plain", "rst": "rst", "org": "org", "epub": "epub", "json": "json",
    "adoc": "asciidoc", "asciidoc": "asciidoc", "textile": "textile", "dbk": "docbook", "docbook": "docbook", "opml": "opml", "jira": "jira",
    "wiki": "mediawiki", "mediawiki": "mediawiki",
}
SENTENCE = r"[^.!?]+[.!?]*\s*|[.!?]+\s*"
#: The same for Python, with white space as Java takes it.
SENTENCE_PATTERN = re.compile(SENTENCE, re.A)
WORD = r"[\p{L}\p{N}]+"


def normalize_text(text: Column) -> Column:
    """Line ends become \\n, trailing white space goes, and one \\n ends a text that is not empty."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?U)\s+\z", "")
    return F.when(t == "", t).otherwise(F.concat(t, F.lit("\n")))


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def structural_hash(text: Column) -> Column:
    return F.sha2(trim_white(text), 256)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """UTF-8 bytes [start, end) of a text, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Edit distance in characters over the longer length in bytes; null where both are empty."""
    return F.levenshtein(a, b) / F.nullif(F.greatest(F.octet_length(a), F.octet_length(b)), F.lit(0))


def is_fuzzy_match(a: Column, b: Column, threshold: float) -> Column:
    return F.levenshtein(a, b) <= F.floor(F.greatest(F.octet_length(a), F.octet_length(b)) * threshold)


def detect_format(path: Column, explicit: Column | None = None) -> Column:
    """A known alias or extension; an unknown explicit name passes through, an unknown extension gives null."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    by_path = F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return by_path if explicit is None else F.coalesce(F.try_element_at(table, F.lower(explicit)), F.lower(explicit), by_path)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
