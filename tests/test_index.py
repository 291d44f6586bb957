"""The stored index against a scan of the texts, lookups that read one bucket, and runs that are merged."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillstone import api, config
from quillstone.operators import corpus, index, search


def node_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, node_id string, node_type string, status string, text string")


def random_nodes(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["running", "runs", "Élan", "the"]
    text = lambda: None if r.random() < 0.02 else " ".join(r.choice(words[: r.choice((5, 20, 44))]) for _ in range(r.choice((0, 1, 5, 30, 200))))
    return [(f"d{k % 17}", f"n{k}", r.choice(("sentence", "paragraph")), r.choice(("active", "active", "deleted")), text()) for k in range(n)]


def found(df):
    return [tuple(x) for x in df.collect()]


QUERIES = [("w1", {}), ("w1", {"k": 3}), ("runs", {"level": "sentence"}), ("w2 w1", {}), ("w1 w1", {}), ("ELAN", {"doc_id": "d3"}), ("w3 w4 w3", {"all_statistics": True}), ("w0", {"all_statistics": True, "k": 5}), ("none", {}), ("", {}), ("the w0", {"level": "paragraph", "doc_id": "d1"}), ("w4", {"k": 1000})]


def test_index_equals_a_scan_after_any_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "COMMON", 50)
    monkeypatch.setattr(index, "MOST_RUNS", 3)
    one = index.StoredIndex(corpus.Corpus(spark, str(tmp_path / "c")))
    now = {x[1]: x for x in random_nodes(1, 400)}
    one.update(node_rows(spark, list(now.values())), None)
    for step in range(5):
        whole = search.build_index(node_rows(spark, list(now.values())))
        for query, options in QUERIES if step in (0, 4) else QUERIES[:4]:
            got, want = found(one.search(query, **options)), found(search.search(whole, query, **options))
            assert got == want, (step, query, options)
        changed = {x[1]: x for x in random_nodes(10 + step, 460) if hash(x[1]) % 7 == step}
        old = [now[k] for k in changed if k in now]
        one.update(node_rows(spark, list(changed.values())), node_rows(spark, old))
        now |= changed
    assert len(one.corpus.manifest()["postings"]) <= 4
    one.rebuild(node_rows(spark, list(now.values())))
    assert found(one.search("w1 w2")) == found(search.search(search.build_index(node_rows(spark, list(now.values()))), "w1 w2"))


def test_a_search_reads_its_own_buckets_and_best_blocks(spark, tmp_path):
    rows = [("d", f"n{k}", "sentence", "active", ("fox " if k % 3 else "cat ") * (1 + k % 40) * (k % 5 < 2) + "pad " * (k % 90)) for k in range(20_000)]
    one = index.StoredIndex(corpus.Corpus(spark, str(tmp_path / "c")))
    one.update(node_rows(spark, rows), None)
    got = found(one.search("foxes", k=10))
    assert one.scored < 2000 and got == found(search.search(search.build_index(node_rows(spark, rows)), "fox", k=10))
    plan = one.of_terms("postings", ["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,fox)" in plan
    before = {p: len(list((tmp_path / "c" / p).glob("bucket=*/*.parquet"))) for p in one.corpus.manifest()["postings"]}
    one.update(node_rows(spark, [("d", "n5", "sentence", "active", "bird")]), node_rows(spark, [rows[5]]))
    assert one.corpus.manifest()["postings"][0] in before and one.corpus.runs("postings").where("v > 1").count() == 1


def shuffled_bytes(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_postings_are_shuffled_once_and_packed(spark, tmp_path, monkeypatch):
    """They were stored twice on the way and shuffled twice as plain rows, which took 11.8 times the input on 0.1 GB."""
    r = random.Random(3)
    rows = node_rows(spark, [(f"d{k // 50}", f"d{k // 50}/{k % 50}", "sentence", "active", " ".join(f"w{int(r.paretovariate(0.4)) % 5000}" for _ in range(40))) for k in range(4000)]).repartition(2).localCheckpoint()
    stored, store = [], index.shared_table
    monkeypatch.setattr(index, "shared_table", lambda df, tag: stored.append(tag) or store(df, tag))
    one = index.StoredIndex(corpus.Corpus(spark, str(tmp_path / "c")))
    before = shuffled_bytes(spark)
    one.rebuild(rows)
    shuffled, n = shuffled_bytes(spark) - before, one.corpus.runs("postings").count()
    assert n > 80_000 and not stored and shuffled < 15 * n, (n, stored, shuffled)
    segments = one.corpus.runs("postings").groupBy("term", "part").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"))
    assert segments.where(f"blocks > 1 + ceil(n / {index.BLOCK})").count() == 0
    want = search.search(search.build_index(rows), "w1 w2")
    assert found(one.search("w1 w2")) == found(want)


def test_a_search_for_one_term_finds_the_best_in_shared_blocks(spark, tmp_path, monkeypatch):
    """Segments share numbers of blocks, and a block may have two rows; nothing but bounds and scored postings is stored."""
    monkeypatch.setattr(index, "BLOCK", 8)
    stored, store = [], index.shared_table
    monkeypatch.setattr(index, "shared_table", lambda df, tag: stored.append(tag) or store(df, tag))
    rows = node_rows(spark, random_nodes(5, 900))
    one = index.StoredIndex(corpus.Corpus(spark, str(tmp_path / "c")))
    one.rebuild(rows)
    got = found(one.search("w3", k=20))
    assert got == found(search.search(search.build_index(rows), "w3", k=20)) and len(got) == 20
    assert stored == ["bounds", "scored"]


def test_an_update_stores_the_sums_of_what_went_alone(spark, tmp_path, monkeypatch):
    """Each commit stored its postings twice, once as found and once in blocks."""
    stored, store = [], index.shared_table
    monkeypatch.setattr(index, "shared_table", lambda df, tag: stored.append(tag) or store(df, tag))
    before = random_nodes(8, 300)
    now = [(d, n, t, s, "of the " + (x or "")) for d, n, t, s, x in before[:100]]
    one = index.StoredIndex(corpus.Corpus(spark, str(tmp_path / "c")))
    one.rebuild(node_rows(spark, before))
    one.update(node_rows(spark, now), node_rows(spark, before[:100]))
    assert stored == ["gone"]
    sums = one.corpus.runs("statistics").agg(F.sum("nodes"), F.sum("words")).first()
    texts = [x[4] or "" for x in now + before[100:]]
    assert tuple(sums) == (300, sum(len(search.sanitized(x)) for x in texts))
    whole = search.build_index(node_rows(spark, now + before[100:]))
    assert found(one.search("of the")) == found(search.search(whole, "of the"))


def test_common_terms_are_dealt_by_node_and_rounds_of_packets_join(spark, tmp_path, monkeypatch):
    """Every posting arrives once, whatever the number of slots and of rounds, and with its own node."""
    monkeypatch.setattr(index, "COMMON", 300)
    monkeypatch.setattr(index, "MOST", 500)
    rows = random_nodes(7, 1500)
    dealt = index.Dealt(index.terms_of(index.sampled(node_rows(spark, rows))).select("term"))
    assert dealt.rest >= 1 and (dealt.parts == 0) == (not dealt.common)
    dealt.common, dealt.parts, dealt.rest = {"w1", "w2", "elan"}, 16, 3
    df = index.texts(node_rows(spark, rows).repartition(3))
    got = dealt.run(df, index.found).localCheckpoint()
    again = dealt.run(got.select("term", *index.NODE, "places"), index.refound)
    key = lambda x: sorted((str(r["term"]), r["node_id"], r["doc_id"], r["node_type"], r["status"], r["words"], r["frequency"], tuple(r["places"])) for r in x.collect())
    want = []
    for d, n, t, s, text in rows:
        held = {}
        terms = index.stemming.terms(text or "")
        for k, term in enumerate(terms):
            held.setdefault(term, []).append(k)
        want += [(term, n, d, t, s, len(terms), len(p), tuple(p)) for term, p in held.items()]
    assert key(got) == sorted(want) == key(again)
    assert got.where("term in ('w1', 'w2', 'elan')").select("part").distinct().count() == 16 and got.where("part > 0 and term = 'w3'").count() == 0


def test_columns_come_back_from_a_packet():
    for column in (pa.array(["é", "", None, "abc", "\0"]), pa.array(["a"]), pa.array([5, -7, 2**62]), pa.array([5, None]), pa.array([1, 2], pa.int32()), pa.array([None, None], pa.string())):
        packet = index.unpacked(pa.py_buffer(index.ipc(index.thin("x", column))))
        assert index.thick("x", packet).equals(column)


def test_runs_are_merged_and_lookups_are_pruned(spark, tmp_path):
    store = corpus.Corpus(spark, str(tmp_path / "c"))
    want = {}
    r = random.Random(2)
    for step in range(23):
        rows = [(f"d{k % 5}", f"n{k}", str(step), step) for k in r.sample(range(60), 7)]
        store.commit({"nodes": spark.createDataFrame(rows, "doc_id string, node_id string, text string, created_at int")})
        for d, k, t, at in rows:
            want[k] = (d, k, t, want.get(k, (0, 0, 0, at))[3])
        assert len(store.manifest()["nodes"]) <= (corpus.FAN - 1) * 4
    assert sorted(found(store.table("nodes"))) == sorted(want.values()) and len(store.manifest()["nodes"]) <= 6
    assert sorted(found(store.of_document("nodes", "d3"))) == sorted(x for x in want.values() if x[0] == "d3")
    one = next(iter(want))
    assert found(store.by_key("nodes", "node_id", one)) == [want[one]] and store.of_document("nodes", "none").count() == 0
    plan = store.of_document("nodes", "d3")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "EqualTo(doc_id,d3)" in scan and "PartitionFilters: [isnotnull(bucket" in scan and "(bucket" in scan
    assert plan.index("Exchange") < plan.index("FileScan") and plan.count("Exchange") == 1
    assert "EqualTo(node_id,n7)" in store.by_key("nodes", "node_id", "n7")._jdf.queryExecution().executedPlan().toString()


def test_runs_are_small_on_disk(spark, tmp_path):
    """Each file's filter took 1 MB, however few its ids."""
    store = corpus.Corpus(spark, str(tmp_path / "c"))
    store.commit({"nodes": spark.range(2000).selectExpr("concat('d', id % 100) as doc_id", "concat('n', id) as node_id", "repeat('some text ', 9) as text")})
    files = list((tmp_path / "c").glob("tables/nodes/**/*.parquet"))
    assert files and max(f.stat().st_size for f in files) < 200_000
    assert store.by_key("nodes", "node_id", "n77").count() == 1 and store.table("nodes").count() == 2000


def test_columns_may_come_later(spark, tmp_path):
    store = corpus.Corpus(spark, str(tmp_path / "c"))
    store.commit({"nodes": spark.createDataFrame([("d", "a", 1)], "doc_id string, node_id string, x int")})
    store.commit({"nodes": spark.createDataFrame([("d", "b", "t")], "doc_id string, node_id string, y string")})
    assert sorted(found(store.table("nodes").select("node_id", "x", "y"))) == [("a", 1, None), ("b", None, "t")]


def test_workspace_searches_the_stored_index(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# Title\n\nThe quick foxes ran. It rained.\n\nLast words.\n")
    (folder / "b.md").write_text("A slow fox.\n")
    one = api.Workspace(spark, str(tmp_path / "data"), config=config.Config(fuzzy_threshold=0.3))
    assert one.threshold == 0.3 and api.Workspace(spark, str(tmp_path / "x"), 0.1).threshold == 0.1
    first = {r["path"].rpartition("/")[2]: r["doc_id"] for r in one.ingest(str(folder)).collect()}
    scan = lambda q, **o: found(search.search(search.build_index(one.table("nodes", "")), q, **o))
    assert [tuple(x)[:5] for x in one.search("fox").collect()] == scan("fox") and len(scan("fox")) > 3
    (folder / "a.md").write_text("# Title\n\nThe quick birds ran. It rained.\n\nLast words.\n")
    one.ingest(str(folder))
    for q in ("fox", "bird", "it rained", "last word"):
        assert [tuple(x)[:5] for x in one.search(q).collect()] == scan(q)
    assert {x["doc_id"] for x in one.search("fox").collect()} == {first["b.md"]}
    kept = one.nodes(first["a.md"]).where("text like 'Last%' and node_type = 'paragraph'").first()
    assert one.exists(kept["node_id"]) and [x["text"] for x in one.children(kept["node_id"]).collect()] == ["Last words."]
    assert one.children("none").count() == 0 and not one.exists("none")
    one.delete(first["b.md"])
    assert one.search("fox").count() == 0 and one.nodes(first["b.md"]).count() == 0 and scan("fox") == []
