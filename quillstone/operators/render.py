"""Nodes back to text: Markdown, plain text, or the tree itself as JSON, with sentence numbers if asked for."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, IntegerType, StringType, StructField, StructType

#: What stands around the text of an inline.
AROUND = {"Emph": "*", "Strong": "**", "Strikeout": "~~"}
FORMATS = {"markdown": "markdown", "md": "markdown", "plain": "plain", "txt": "plain", "text": "plain"}


def inline(content: list[dict]) -> str:
    """Inlines as Markdown; notes are left out, and kinds without a form of their own stay JSON."""
    out = []
    for i in content:
        kind, c = i["t"], i.get("c")
        if kind in ("Str", "Space", "SoftBreak", "LineBreak"):
            out.append(c if kind == "Str" else "\\\n" if kind == "LineBreak" else " ")
        elif kind in AROUND:
            out.append(f"{AROUND[kind]}{inline(c)}{AROUND[kind]}")
        elif kind == "Code":
            out.append(f"`{c[1]}`")
        elif kind == "Math":
            mark = "$$" if c[0]["t"] == "DisplayMath" else "$"
            out.append(f"{mark}{c[1]}{mark}")
        elif kind in ("Link", "Image"):
            out.append(f"{'!' * (kind == 'Image')}[{inline(c[1])}]({c[2][0]})")
        elif kind == "Quoted":
            mark = "'" if c[0]["t"] == "SingleQuote" else '"'
            out.append(f"{mark}{inline(c[1])}{mark}")
        elif kind == "Cite":
            out.append(inline(c[1]))
        elif kind != "Note":
            out.append(json.dumps(i, ensure_ascii=False, separators=(",", ":")))
    return "".join(out)


def entry(item: list[dict]) -> str:
    """A list item on one line, with its further blocks after two blanks each."""
    return "  ".join(markdown(b).strip() for b in item)


def markdown(b: dict) -> str:
    kind, c = b["t"], b.get("c")
    if kind == "Para":
        return f"{inline(c)}\n\n"
    if kind == "Plain":
        return f"{inline(c)}\n"
    if kind == "Header":
        return f"{'#' * c[0]} {inline(c[2])}\n\n"
    if kind == "CodeBlock":
        return f"```\n{c[1]}\n```\n\n"
    if kind == "BlockQuote":
        return "".join(f"> {line}\n" for inner in c for line in markdown(inner).split("\n")[:-1]) + "\n"
    if kind == "BulletList":
        return "".join(f"- {entry(item)}\n" for item in c) + "\n"
    if kind == "OrderedList":
        return "".join(f"{k}. {entry(item)}\n" for k, item in enumerate(c[1], 1)) + "\n"
    if kind == "HorizontalRule":
        return "---\n\n"
    if kind == "Div":
        return "".join(map(markdown, c[1]))
    return json.dumps(b, ensure_ascii=False, separators=(",", ":")) + "\n"


def plain(b: dict) -> str:
    """Block marks go but those of lists and rules; inlines look as in Markdown; other blocks give nothing."""
    kind, c = b["t"], b.get("c")
    if kind in ("Para", "Plain"):
        return f"{inline(c)}\n\n"
    if kind == "Header":
        return f"{inline(c[2])}\n\n"
    if kind == "CodeBlock":
        return f"{c[1]}\n\n"
    if kind in ("BlockQuote", "Div"):
        return "".join(map(plain, c if kind == "BlockQuote" else c[1]))
    if kind in ("BulletList", "OrderedList"):
        entries = c if kind == "BulletList" else c[1]
        return "".join(("- " if kind == "BulletList" else f"{k}. ") + "".join(map(plain, item)) for k, item in enumerate(entries, 1)) + "\n"
    return "---\n\n" if kind == "HorizontalRule" else ""


def rendered(blocks: list[dict], kind: str) -> str:
    """Blocks in a format; an unknown one gives the tree as JSON."""
    form = FORMATS.get(kind.lower())
    if form is None:
        return json.dumps({"blocks": blocks}, ensure_ascii=False, separators=(",", ":"))
    return "".join(map(markdown if form == "markdown" else plain, blocks))


def outermost(rows: list[dict]) -> list[dict]:
    """Rows with content, in order, that lie in no other row with content."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: r["position"]):
        if r["ast"] is not None and not (out and r["path"][: len(out[-1]["path"])] == out[-1]["path"]):
            out.append(r)
    return out


def marked(b: dict, path: list[int], sentences: dict[tuple[int, ...], list[str]]) -> dict:
    """A block with its paragraphs' text as numbered sentences."""
    kind, c = b["t"], b.get("c")
    if kind in ("Para", "Plain") and tuple(path) in sentences:
        return {"t": kind, "c": [{"t": "Str", "c": "".join(sentences[tuple(path)])}]}
    inner = lambda blocks: [marked(x, [*path, k], sentences) for k, x in enumerate(blocks)]
    if kind == "BlockQuote":
        return {"t": kind, "c": inner(c)}
    if kind in ("Div", "Figure"):
        return {"t": kind, "c": [*c[:-1], inner(c[-1])]}
    if kind in ("BulletList", "OrderedList"):
        entries = c if kind == "BulletList" else c[1]
        made = [[marked(x, [*path, n, k], sentences) for k, x in enumerate(item)] for n, item in enumerate(entries)]
        return {"t": kind, "c": made if kind == "BulletList" else [c[0], made]}
    return b


def project(nodes: DataFrame, kind: str = "markdown", markers: bool = False) -> DataFrame:
    """doc_id, format, text and marker_map (sentence number to node_id, null without markers) of every document with active nodes.

    One document's blocks are gathered, as its text is one value; sentences only if they are to be numbered.
    """
    rows = nodes.where("status = 'active'") if "status" in nodes.columns else nodes
    if not markers:
        rows = rows.where("ast is not null or size(path) = 0")
    fields = ["position", "path", "node_type", "ast", F.when(F.col("node_type") == "sentence", F.col("text")).alias("text"), "node_id"]
    whole = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    schema = StructType([whole.schema["doc_id"], StructField("format", StringType()), StructField("text", StringType()), StructField("marker_map", MapType(IntegerType(), StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, maps = [], []
            for some in b.column(1).to_pylist():
                number, sentences, ids = 0, {}, []
                for r in sorted(some, key=lambda r: r["position"]):
                    if markers and r["node_type"] == "sentence":
                        number += 1
                        sentences.setdefault(tuple(r["path"][:-1]), []).append(f"§{number} {r['text']}")
                        ids.append((number, r["node_id"]))
                blocks = [marked(json.loads(r["ast"]), r["path"], sentences) if markers else json.loads(r["ast"]) for r in outermost(some)]
                texts.append(rendered(blocks, kind))
                maps.append(ids if markers else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * b.num_rows), pa.array(texts), pa.array(maps, pa.map_(pa.int32(), pa.string()))], schema.names)

    return whole.mapInArrow(run, schema)
