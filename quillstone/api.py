"""A workspace of documents: what a user calls, and the same as commands in JSON lines.

A workspace is a corpus on disk. Taking in documents parses, matches, stores and logs them in one commit; batches of any
size are one Spark job, and a file that is already there unchanged is passed over. Rows that fail are rejects with a code,
never exceptions; what is looked up and not there is an ApiError.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import __version__
from quillstone.functions import text as T
from quillstone.operators import anchors, annotations, merge, nodes, provenance, render, search
from quillstone.config import Config
from quillstone.operators.corpus import Corpus
from quillstone.operators.index import StoredIndex
from quillstone.operators.index import tables as index_tables
from quillstone.sources import files
from quillstone.sources.stored import drop_table, shared_table

#: Bytes of the longest command line.
LONGEST_LINE = 1 << 20


class ApiError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def doc_id_of(path: Column) -> Column:
    """A document's identity: that of the place it came from."""
    return merge.shaped(F.sha2(path, 256))


class Workspace:
    def __init__(self, spark: SparkSession, root: str, threshold: float | None = None, profile: str = "uax29", mode: str = "set", config: Config | None = None) -> None:
        """A threshold that is given wins over that of the settings."""
        self.spark, self.corpus, self.config = spark, Corpus(spark, root), config or Config()
        self.index = StoredIndex(self.corpus)
        self.threshold = self.config.fuzzy_threshold if threshold is None else threshold
        self.profile, self.mode = profile, mode

    # ── taking in ──────────────────────────────────────────────────────────────────────────────────────────────────────

    def ingest(self, place: str, now: Column | None = None) -> DataFrame:
        """Take in a file or a folder of files. Returns doc_id, path, the counters of nodes and error."""
        return self.ingest_frame(files.read_files(self.spark, place), True, now)

    def ingest_text(self, text: str, kind: str, title: str = "untitled", now: Column | None = None) -> DataFrame:
        """Take in one text as a new document."""
        path = f"text:{title}:{time.time_ns()}"
        frame = self.spark.createDataFrame([(path, text.encode(), kind)], "path string, content binary, kind string")
        return self.ingest_frame(files.described(frame, F.lit(kind)).withColumn("title", F.lit(title)), False, now)

    def ingest_frame(self, described: DataFrame, merged: bool = True, now: Column | None = None) -> DataFrame:
        """Take in described files (see sources.files). With `merged`, a known path is a new version of its document."""
        now = F.current_timestamp() if now is None else now
        rows = described.withColumn("doc_id", doc_id_of(F.col("path")))
        old = self.corpus.table("documents") if self.corpus.has("documents") else None
        if merged and old is not None:
            rows = rows.join(old.select("doc_id", "import_hash"), ["doc_id", "import_hash"], "left_anti")
        rows = shared_table(rows, "ingest")
        text = F.when(F.col("format").isin(*files.BINARY), F.col("content").cast("string")).otherwise(T.normalize_text(F.col("content").cast("string")))
        plain = rows.where(~F.col("format").isin(*files.BINARY) | F.col("format").isNull())
        parsed = nodes.segment(plain, "doc_id", text, F.col("format"), self.profile).unionByName(nodes.segment(rows.where(F.col("format").isin(*files.BINARY)), "doc_id", F.col("content"), F.col("format"), self.profile))
        parsed = shared_table(parsed, "parsed")
        good = nodes.accepted(parsed)
        if merged and self.corpus.has("nodes"):
            held = self.corpus.table("nodes")
            whole = merge.merge(held.select(*good.columns, "version", "status"), good, self.threshold, self.mode)
        else:
            whole = good.withColumns({"version": F.lit(1), "status": F.lit("active"), "outcome": F.lit("new")})
        whole = shared_table(whole, "merged")
        documents = rows.join(nodes.rejected(parsed).select("doc_id", F.col("error").alias("reject")), "doc_id", "left").where("reject is null")
        edition = old.select("doc_id", F.col("version").alias("last")) if old is not None else self.spark.createDataFrame([], "doc_id string, last int")
        documents = documents.join(edition, "doc_id", "left").select("doc_id", "path", "title", "format", "import_hash", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), now.alias("created_at"), now.alias("ingested_at"))
        current = whole.where("status = 'active'").select("doc_id", "node_id", "position")
        activity = provenance.log(self.spark, "reingest" if merged and old is not None else "ingest", documents, current, "quillstone", provenance.config_json(None, merged, self.threshold), now)
        changes = {"documents": documents, "nodes": whole.drop("outcome").withColumn("created_at", now), "activities": activity, **self.index_changes(whole)}
        if self.corpus.has("annotations"):
            held = self.corpus.table("annotations")
            deleted = whole.where("status = 'deleted'")
            touched = held.join(deleted.select(F.col("node_id").alias("target_id")).distinct(), "target_id", "left_semi").select(held.columns)
            changes["annotations"] = self.placed(annotations.orphaned(touched, deleted), whole)
        self.corpus.commit(changes)
        self.index.settle()
        result = documents.select("doc_id", "path").join(merge.counts(whole), "doc_id", "left").withColumn("error", F.lit(None).cast("string"))
        rejects = nodes.rejected(parsed).join(rows.select("doc_id", "path"), "doc_id").select("doc_id", "path", "error")
        out = shared_table(result.unionByName(rejects, allowMissingColumns=True), "ingested")
        for table in (rows, parsed, whole):
            drop_table(table)
        return out

    def index_changes(self, whole: DataFrame) -> dict[str, DataFrame]:
        """What the index takes from nodes as they are now: those that are new, or have other text, kind or status than before."""
        now = whole.select("doc_id", "node_id", "node_type", "status", "text")
        if not self.corpus.has("nodes"):
            return index_tables(now)
        held = self.corpus.table("nodes")
        if not self.index.there():
            rest = held.join(now.select("node_id"), "node_id", "left_anti").select(now.columns)
            return index_tables(now.unionByName(rest))
        was = held.select("node_id", *(F.col(c).alias(f"was_{c}") for c in ("doc_id", "node_type", "status", "text")))
        both = shared_table(now.join(was, "node_id", "left").where("was_status is null or not (text <=> was_text and status <=> was_status and node_type <=> was_node_type)"), "changed")
        old = both.where("was_status is not null").select("node_id", *(F.col(f"was_{c}").alias(c) for c in ("doc_id", "node_type", "status", "text")))
        return index_tables(both.select(now.columns), old)

    # ── reading ────────────────────────────────────────────────────────────────────────────────────────────────────────

    def table(self, name: str, missing: str) -> DataFrame:
        if not self.corpus.has(name):
            raise ApiError(missing, f"there are no {name}")
        return self.corpus.table(name)

    def documents(self) -> DataFrame:
        """All documents, the last ingested first."""
        return self.table("documents", "DOCUMENT_NOT_FOUND").orderBy(F.desc("ingested_at"), "doc_id")

    def document(self, doc_id: str) -> DataFrame:
        self.table("documents", "DOCUMENT_NOT_FOUND")
        found = self.corpus.of_document("documents", doc_id)
        if found.isEmpty():
            raise ApiError("DOCUMENT_NOT_FOUND", f"document {doc_id} not found")
        return found

    def document_by_path(self, path: str) -> DataFrame:
        return self.table("documents", "DOCUMENT_NOT_FOUND").where(F.col("path") == path).orderBy("doc_id").limit(1)

    def node(self, node_id: str) -> DataFrame:
        """One node, whatever its status."""
        self.table("nodes", "NODE_NOT_FOUND")
        return self.corpus.by_key("nodes", "node_id", node_id)

    def content(self, node_id: str) -> str | None:
        """The stored tree of one node as JSON; null where the node has none or is not there."""
        row = self.node(node_id).where("has_content").select("ast").first()
        return row["ast"] if row else None

    def nodes(self, doc_id: str | None = None) -> DataFrame:
        rows = self.table("nodes", "DOCUMENT_NOT_FOUND")
        return rows.where("status = 'active'") if doc_id is None else self.corpus.of_document("nodes", doc_id).where("status = 'active'").orderBy("position")

    def delete(self, doc_id: str, now: Column | None = None) -> int:
        """Mark a document's nodes deleted and its annotations orphaned; the rows stay, searches no longer find them."""
        self.document(doc_id)
        whole = shared_table(self.nodes(doc_id).withColumn("status", F.lit("deleted")), "deleted")
        changes = {"nodes": whole, **self.index_changes(whole)}
        if self.corpus.has("annotations"):
            changes["annotations"] = annotations.orphaned(self.corpus.of_document("annotations", doc_id), whole)
        return self.corpus.commit(changes)

    def exists(self, node_id: str) -> bool:
        return self.corpus.has("nodes") and not self.node(node_id).isEmpty()

    def children(self, node_id: str) -> DataFrame:
        """The active children in order: the node says which document to look into."""
        row = self.node(node_id).select("doc_id").first()
        rows = self.nodes(row["doc_id"]) if row else self.nodes().where("false")
        return rows.where(F.col("parent_id") == node_id).orderBy("position")

    def nodes_by_hash(self, doc_id: str, structural_hash: str) -> DataFrame:
        return self.nodes(doc_id).where(F.col("structural_hash") == structural_hash).orderBy("position")

    def sentences(self, doc_id: str) -> DataFrame:
        """n (from 1), node_id and text."""
        rows = self.document(doc_id).select("doc_id").join(self.nodes(doc_id).where("node_type = 'sentence'"), "doc_id")
        order = F.sort_array(F.collect_list(F.struct("position", "node_id", "text")))
        return rows.groupBy("doc_id").agg(order.alias("s")).select(F.posexplode("s").alias("p", "x")).select((F.col("p") + 1).alias("n"), "x.node_id", "x.text")

    def toc(self, doc_id: str) -> DataFrame:
        """node_id, level, title and position of the headings, with dotted section numbers."""
        from quillstone.operators import structure

        self.document(doc_id)
        heads = self.nodes(doc_id).where(F.col("node_type") == "heading").withColumn("level", F.coalesce("level", F.lit(1)))
        return structure.section_path(heads, "doc_id", "position", "level", 6).select("node_id", "level", F.col("text").alias("title"), "section_path", "position").orderBy("position")

    def read(self, doc_id: str, kind: str = "plain", markers: bool = False) -> DataFrame:
        self.document(doc_id)
        return render.project(self.nodes(doc_id), kind, markers)

    def search(self, query: str, doc_id: str | None = None, k: int = search.MOST_HITS, level: str | None = None) -> DataFrame:
        """doc_id, node_id, node_type, frequency, score and snippet of the best hits, from the stored index."""
        rows = self.table("nodes", "SEARCH_ERROR")
        if not self.index.there():
            self.index.rebuild()
        hits = shared_table(self.index.search(query, doc_id, k, level), "hits")
        return search.snippets(hits, rows, query).select("doc_id", "node_id", "node_type", "frequency", "score", "snippet").orderBy("score", "doc_id", "node_id")

    # ── annotations, edges, history ────────────────────────────────────────────────────────────────────────────────────

    def annotate(self, requests: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Store annotations for requests (request_id, doc_id, node_id, quote, body, motivation); returns them and the rejects."""
        made, rejects = annotations.annotate(requests, self.nodes(), F.current_timestamp() if now is None else now)
        made = shared_table(made, "annotations")
        self.corpus.commit({"annotations": made})
        return made, rejects

    def transclude(self, requests: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Store edges for requests (source_id, target_id, predicate); returns them and the rejects."""
        made, rejects = anchors.create(requests, self.nodes(), F.current_timestamp() if now is None else now)
        made = shared_table(made, "edges")
        self.corpus.commit({"edges": made})
        return made, rejects

    def refresh_edges(self) -> int:
        """Bring the edges' status up to date; returns how many changed."""
        held = self.table("edges", "NODE_NOT_FOUND")
        now = anchors.refreshed(held, self.table("nodes", "NODE_NOT_FOUND"))
        changed = shared_table(now.join(held.select("edge_id", F.col("status").alias("was")), "edge_id").where("status <> was").drop("was"), "edges")
        n = changed.count()
        if n:
            self.corpus.commit({"edges": changed})
        return n

    def reanchor(self) -> DataFrame:
        """Find the annotations again in their nodes' present text, or in other nodes of their document, and store what changed; returns the resolution by node."""
        held, nodes = self.table("annotations", "ANNOTATION_ERROR"), self.table("nodes", "NODE_NOT_FOUND")
        found = shared_table(annotations.resolve(held, nodes), "resolution")
        self.corpus.commit({"annotations": self.placed(annotations.with_status(held, found), nodes)})
        return found

    def placed(self, held: DataFrame, nodes: DataFrame) -> DataFrame:
        """Annotations, the orphans among them at another node of their document where one has their quote."""
        held = shared_table(held, "annotations")
        lost = held.where("status = 'orphan'")
        return held if lost.isEmpty() else annotations.with_place(held, annotations.moved(lost, nodes))

    def activities(self, doc_id: str | None = None, activity: str | None = None, limit: int | None = None) -> DataFrame:
        return provenance.query(self.table("activities", "DOCUMENT_NOT_FOUND"), doc_id, activity, limit)


class Service:
    """Workspaces by name, and their commands: one JSON object in, one out."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.started = spark, time.time()
        self.workspaces: dict[str, tuple[Workspace, str, list]] = {}
        self.stopped = False

    def line(self, line: str) -> str:
        """A command line's answer; what is no command gives an error with its code."""
        if len(line.encode()) > LONGEST_LINE:
            return json.dumps(failure(None, "LINE_TOO_LONG", "the line is too long"))
        try:
            request = json.loads(line)
        except ValueError as e:
            return json.dumps(failure(None, "PARSE_ERROR", str(e)))
        return json.dumps(self.call(request), default=str, ensure_ascii=False)

    def call(self, request: object) -> dict:
        if not isinstance(request, dict) or not isinstance(request.get("id"), str) or not isinstance(request.get("cmd"), str):
            return failure(request.get("id") if isinstance(request, dict) else None, "BAD_CMD", "a command has id and cmd")
        known = COMMANDS.get(request["cmd"])
        if known is None:
            return failure(request["id"], "BAD_CMD", f"unknown command {request['cmd']}")
        run, needed, fallback = known
        params = request.get("params") or {}
        missing = [p for p in needed if not isinstance(params.get(p), str)]
        if missing:
            return failure(request["id"], "BAD_CMD", f"missing {', '.join(missing)}")
        try:
            return {"id": request["id"], "ok": True, "data": run(self, params)}
        except ApiError as e:
            return failure(request["id"], e.code, str(e))
        except Exception as e:  # whatever a command meets is its answer, so that the service goes on
            return failure(request["id"], fallback, str(e))

    def workspace(self, params: dict) -> Workspace:
        if params["workspace"] not in self.workspaces:
            raise ApiError("WORKSPACE_NOT_FOUND", f"workspace {params['workspace']} not found")
        return self.workspaces[params["workspace"]][0]

    def list(self, params: dict) -> dict:
        return {"workspaces": [{"name": n, "root": root, "status": "open"} for n, (_, root, _) in sorted(self.workspaces.items())]}

    def add(self, params: dict) -> dict:
        from quillstone.streaming import changes

        if params["name"] in self.workspaces:
            raise ApiError("WORKSPACE_EXISTS", f"workspace {params['name']} exists")
        one = Workspace(self.spark, params["data_dir"])
        one.corpus.version()
        watched = [changes.ingest_stream(one, folder, f"{params['data_dir']}/watch/{k}", once=False) for k, folder in enumerate(params.get("watch_dirs") or [])]
        self.workspaces[params["name"]] = one, params["root"], watched
        return {"name": params["name"]}

    def remove(self, params: dict) -> dict:
        if params["name"] not in self.workspaces:
            raise ApiError("WORKSPACE_NOT_FOUND", f"workspace {params['name']} not found")
        for query in self.workspaces.pop(params["name"])[2]:
            query.stop()
        return {"removed": params["name"]}

    def sync(self, wanted: dict[str, dict]) -> tuple[list[str], list[str]]:
        """Open and close workspaces until they are the wanted ones (parameters of workspace_add by name); what was opened and closed."""
        closed, opened = sorted(set(self.workspaces) - set(wanted)), sorted(set(wanted) - set(self.workspaces))
        for name in closed:
            self.remove({"name": name})
        for name in opened:
            self.add({"name": name, **wanted[name]})
        return opened, closed

    def ingest(self, params: dict) -> dict:
        one = self.workspace(params)
        from pyspark.errors import AnalysisException

        try:
            rows = one.ingest(params["path"]).collect()
        except AnalysisException as e:
            raise ApiError("IO_ERROR", f"cannot read {params['path']}: {e}") from None
        return ingested(one, rows, params["path"])

    def ingest_text(self, params: dict) -> dict:
        one = self.workspace(params)
        return ingested(one, one.ingest_text(params["text"], params["format"], params.get("title") or "untitled").collect(), None)

    def read(self, params: dict) -> dict:
        row = self.workspace(params).read(params["doc_id"], params.get("format") or "plain", bool(params.get("markers"))).first()
        return {"text": row["text"], "format": row["format"], **({"marker_map": row["marker_map"]} if row["marker_map"] is not None else {})}

    def annotate(self, params: dict) -> dict:
        schema = "request_id string, doc_id string, node_id string, quote string, body string, motivation string"
        request = self.spark.createDataFrame([(str(time.time_ns()), params["doc_id"], params["sentence_uuid"], params.get("quote"), params.get("body"), params.get("motivation"))], schema)
        made, rejects = self.workspace(params).annotate(request)
        bad = rejects.first()
        if bad:
            raise ApiError("SENTENCE_NOT_FOUND" if bad["error"] == "SENTENCE_NOT_FOUND" else "ANNOTATION_ERROR", bad["error"])
        return {"annotation_id": made.first()["annotation_id"]}

    def search(self, params: dict) -> dict:
        hits = self.workspace(params).search(params["query"], params.get("doc_id")).collect()
        return {"results": [{"doc_id": h["doc_id"], "node_id": h["node_id"], "node_type": h["node_type"], "snippet": h["snippet"], "score": h["score"]} for h in hits]}

    def toc(self, params: dict) -> dict:
        return {"toc": [r.asDict() for r in self.workspace(params).toc(params["doc_id"]).collect()]}

    def status(self, params: dict) -> dict:
        return {"version": __version__, "uptime": int(time.time() - self.started), "workspaces": len(self.workspaces)}

    def shutdown(self, params: dict) -> dict:
        for name in list(self.workspaces):
            self.remove({"name": name})
        self.stopped = True
        return {"message": "shutting down"}


def failure(ident: str | None, code: str, message: str) -> dict:
    return {"id": ident or "", "ok": False, "error": message, "code": code}


def ingested(one: Workspace, rows: list, path: str | None) -> dict:
    """The document of one file, or of the unchanged one that is there already; a reject is an error."""
    if rows and rows[0]["error"]:
        raise ApiError("INGEST_ERROR", rows[0]["error"])
    if rows:
        return {"doc_id": rows[0]["doc_id"], "documents": len(rows)}
    found = one.table("documents", "INGEST_ERROR").where(F.col("path").endswith(path or "")).first()
    return {"doc_id": found["doc_id"] if found else None, "documents": 0}


#: What each command runs, the strings it needs, and the code of what goes wrong in it.
COMMANDS: dict[str, tuple[Callable[[Service, dict], dict], tuple[str, ...], str]] = {
    "workspace_list": (Service.list, (), "WORKSPACE_OPEN_ERROR"),
    "workspace_add": (Service.add, ("name", "root", "data_dir"), "WORKSPACE_OPEN_ERROR"),
    "workspace_remove": (Service.remove, ("name",), "WORKSPACE_CLOSE_ERROR"),
    "ingest": (Service.ingest, ("workspace", "path"), "INGEST_ERROR"),
    "ingest_text": (Service.ingest_text, ("workspace", "text", "format"), "INGEST_ERROR"),
    "read": (Service.read, ("workspace", "doc_id"), "READ_ERROR"),
    "annotate": (Service.annotate, ("workspace", "doc_id", "sentence_uuid"), "ANNOTATION_ERROR"),
    "search": (Service.search, ("workspace", "query"), "SEARCH_ERROR"),
    "toc": (Service.toc, ("workspace", "doc_id"), "TOC_ERROR"),
    "status": (Service.status, (), "BAD_CMD"),
    "shutdown": (Service.shutdown, (), "BAD_CMD"),
}
