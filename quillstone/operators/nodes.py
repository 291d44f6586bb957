"""Documents to the node table: one row for the document, each block and each sentence, with its place in the tree.

A node's path is the list of child numbers from the document down (the document's own is empty); positions are 1000 apart
in the order of reading. Identities come from content: the document, the node's type, the hash of its trimmed text and the
how-many-eth such node it is, so that they outlive moves and are the same on every run.

Defined cases: a null text, or one that is white space, gives an EMPTY_DOCUMENT reject; an unknown format or a broken
file, a reject with its code; a document without a block is its own node alone; repeated rows give repeated nodes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quillstone.functions import sentences
from quillstone.functions import text as T
from quillstone.sources import markup

STEP = 1000.0
#: Bytes of documents whose trees a task holds at a time; a longer document is alone.
PART = 1 << 20
COMPACT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
#: The kinds of node.
NODE_TYPES = ("document", "section", "paragraph", "heading", "sentence", "code_block", "list_item", "table", "blockquote", "thematic_break")
FIELDS = [
    StructField("node_id", StringType()), StructField("parent_id", StringType()), StructField("path", ArrayType(IntegerType())), StructField("node_type", StringType()),
    StructField("position", DoubleType()), StructField("text", StringType()), StructField("structural_hash", StringType()), StructField("has_content", BooleanType()),
    StructField("char_start", LongType()), StructField("char_end", LongType()), StructField("level", IntegerType()), StructField("ast", StringType()),
]


class Tree:
    """The rows of one document, in the order of reading."""

    def __init__(self, profile: str, table_text: bool) -> None:
        self.rows: list[dict] = []
        self.profile, self.table_text = profile, table_text

    def add(self, path: list[int], kind: str, text: str = "", content: dict | None = None, **more: object) -> dict:
        row = {"path": path, "node_type": kind, "position": STEP * len(self.rows), "text": text, "ast": content, **more}
        self.rows.append(row)
        return row

    def whole(self, blocks: list[dict]) -> list[dict]:
        root = self.add([], "document")
        self.inner(blocks, [])
        parents = {tuple(r["path"][:-1]) for r in self.rows if r["path"]}
        root["text"] = "\n".join(r["text"] for r in self.rows[1:] if tuple(r["path"]) not in parents and r["text"])
        return self.rows

    def inner(self, blocks: list[dict], path: list[int]) -> list[str]:
        """Add the blocks below `path`; their texts."""
        texts, k = [], 0
        for b in blocks:
            if b["t"] != "Null":
                texts.append(self.block(b, [*path, k]))
                k += 1
        return texts

    def block(self, b: dict, path: list[int]) -> str:
        kind, c = b["t"], b.get("c")
        if kind in ("Para", "Plain"):
            return self.paragraph(b, c, path)
        if kind == "Header":
            return self.add(path, "heading", markup.spoken(c[2])[0], b, level=c[0])["text"]
        if kind == "CodeBlock":
            return self.add(path, "code_block", c[1], b)["text"]
        if kind == "HorizontalRule":
            return self.add(path, "thematic_break", "", b)["text"]
        if kind == "Table":
            return self.add(path, "table", table_text(c) if self.table_text else "", b)["text"]
        if kind in ("OrderedList", "BulletList"):
            self.add(path, "list_item", "", b)
            for k, item in enumerate(c[1] if kind == "OrderedList" else c):
                own = self.add([*path, k], "list_item")
                own["text"] = " ".join(self.inner(item, [*path, k]))
            return ""
        if kind in ("BlockQuote", "Div", "Figure"):
            own = self.add(path, "blockquote" if kind == "BlockQuote" else "section", "", None if kind == "Div" else b)
            own["text"] = "\n".join(self.inner(c if kind == "BlockQuote" else c[-1], path))
            return own["text"]
        if kind == "LineBlock":
            return self.add(path, "paragraph", "\n".join(markup.spoken(x)[0] for x in c), b)["text"]
        if kind == "RawBlock":
            return self.add(path, "paragraph", c[1], b)["text"]
        if kind == "DefinitionList":
            return self.add(path, "paragraph", " ".join(markup.spoken(term)[0] for term, _ in c), b)["text"]
        return self.add(path, "paragraph", json.dumps(b), b)["text"]

    def paragraph(self, b: dict, content: list[dict], path: list[int]) -> str:
        text, atomic = markup.spoken(content)
        self.add(path, "paragraph", text, b)
        raw = text.encode()
        for k, (start, end) in enumerate(self.sentences(text, atomic)):
            self.add([*path, k], "sentence", raw[start:end].decode(), char_start=start, char_end=end)
        return text

    def sentences(self, text: str, atomic: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if self.profile == "uax29":
            return sentences.spans(text, atomic)
        out, at = [], 0
        for piece in T.SENTENCE_PATTERN.findall(text) if text.strip() else []:
            end = sentences.pushed(at + len(piece.encode()), atomic) if atomic else at + len(piece.encode())
            if not out or end > out[-1][1]:
                out.append((out[-1][1] if out else 0, end))
            at += len(piece.encode())
        return out


def table_text(content: list) -> str:
    rows = [*content[3][1], *(r for body in content[4] for r in (*body[2], *body[3])), *content[5][1]]
    cell = lambda c: " ".join(markup.spoken(b["c"])[0] for b in c[4] if b["t"] in ("Plain", "Para"))
    return "\n".join(" | ".join(cell(c) for c in r[1]) for r in rows)


def shaped(digest: str) -> str:
    """A digest in the form of an identity: version 8, as it is derived from content."""
    return f"{digest[:8]}-{digest[8:12]}-8{digest[13:16]}-{'89ab'[int(digest[16], 16) & 3]}{digest[17:20]}-{digest[20:32]}"


def identify(doc: str, rows: list[dict]) -> None:
    seen: dict[tuple[str, str], int] = {}
    ids: dict[tuple[int, ...], str] = {}
    for r in rows:
        r["structural_hash"] = hashlib.sha256(r["text"].strip().encode()).hexdigest()
        # a document keeps its identity whatever its text
        key = (r["node_type"], r["structural_hash"] if r["path"] else "")
        seen[key] = seen.get(key, 0) + 1
        r["node_id"] = shaped(hashlib.sha256("\0".join([doc, *key, str(seen[key])]).encode()).hexdigest())
        ids[tuple(r["path"])] = r["node_id"]
        r["parent_id"] = ids[tuple(r["path"][:-1])] if r["path"] else None


def tree(content: str | bytes | None, kind: str | None, doc: str, profile: str = "regex", table_text: bool = False, ast: bool = True) -> list[dict]:
    """The rows of one document; a ParseError names why there are none. Without `ast` that column is null."""
    if kind is None:
        raise markup.ParseError("UNSUPPORTED_FORMAT", "the format is not known")
    if content is None or not content.strip():
        raise markup.ParseError("EMPTY_DOCUMENT", "the document has no text")
    rows = Tree(profile, table_text).whole(markup.parse(content, kind))
    identify(doc, rows)
    for r in rows:
        r["has_content"] = r.get("ast") is not None
        r["ast"] = COMPACT(r["ast"]) if ast and r["has_content"] else None
    return rows


def few(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices (place, length) of up to 64 documents and about PART bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = size = 0
    for k, n in enumerate(sizes):
        if k > at and (k - at == 64 or size + n > PART):
            yield at, k - at
            at, size = k, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes) - at


def segment(documents: DataFrame, doc_id: str, content: Column, kind: Column, profile: str = "regex", table_text: bool = False, ast: bool = True) -> DataFrame:
    """doc_id, the node columns and error (null, or the reject's code on a row of its own). Documents are not shuffled.

    A reader that has no use for `ast` leaves it out, as it is many times as long as the text.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("key"), content.alias("content"), kind.alias("kind"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *FIELDS, StructField("error", StringType())])
    names = schema.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for b in batches:
            for at, length in few(b.column(2)):
                part = b.slice(at, length)
                taken, out = [], []
                for n, (key, text, form) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    try:
                        found = tree(text, form, key or "", profile, table_text, ast)
                    except markup.ParseError as e:
                        found = [{"error": e.code}]
                    taken += [n] * len(found)
                    out += found
                types = types or [pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(taken, pa.int64())), *(pa.array([r.get(c) for r in out], t) for c, t in zip(names, types, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def accepted(segmented: DataFrame) -> DataFrame:
    return segmented.where("error is null").drop("error")


def rejected(segmented: DataFrame) -> DataFrame:
    return segmented.where("error is not null").select("doc_id", "error")


def inline_spans(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, n, flat_start, flat_end, is_atomic and kinds (the way from the paragraph down) of the leaves of paragraphs and headings."""
    rows = nodes.where("node_type in ('paragraph', 'heading') and ast is not null").select("doc_id", "node_id", "ast")
    schema = StructType([rows.schema["doc_id"], StructField("node_id", StringType()), StructField("n", IntegerType()), StructField("flat_start", LongType()), StructField("flat_end", LongType()), StructField("is_atomic", BooleanType()), StructField("kinds", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, out = [], []
            for k, raw in enumerate(b.column(2).to_pylist()):
                one = json.loads(raw)
                content = one["c"][2] if one["t"] == "Header" else one["c"] if one["t"] in ("Para", "Plain") else []
                for n, (start, end, atomic, way) in enumerate(markup.flatten(content)[1]):
                    taken.append(k), out.append((n, start, end, atomic, "/".join(kind for _, _, kind in way)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


#: Bytes of a text that stand for one key of the join of offsets and spans.
BIN = 256


def at_offset(spans: DataFrame, offsets: DataFrame, columns: tuple[str, ...] = ("n", "kinds")) -> DataFrame:
    """node_id, offset, the span's columns and inside (bytes from its start), for each byte offset (node_id, offset) of a flattened text.

    Spans (node_id, flat_start, flat_end) stand under each stretch of BIN bytes that they touch, offsets under their own, so
    an offset meets the spans around it and not all of its node's; a long node is dealt to many tasks.
    """
    first, last = F.floor(F.col("flat_start") / BIN), F.floor((F.col("flat_end") - 1) / BIN)
    dealt = spans.where("flat_start < flat_end").select("node_id", "flat_start", "flat_end", *columns, F.explode(F.sequence(first, last)).alias("bin"))
    asked = offsets.where("offset >= 0").select("node_id", "offset", F.floor(F.col("offset") / BIN).alias("bin"))
    both = asked.join(dealt, ["node_id", "bin"]).where("flat_start <= offset and offset < flat_end")
    return both.select("node_id", "offset", *columns, (F.col("offset") - F.col("flat_start")).alias("inside"))
