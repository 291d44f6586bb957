import itertools
import random

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import anchors, diff, nodes, provenance, search, structure
from quillstone.plans import catalogue
from quillstone.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_normalize_and_hash(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="a\r\nb\rc 　\n\n") == "a\nb\nc\n"
    assert one(spark, T.normalize_text(F.col("t")), t=" \n") == ""
    assert one(spark, T.structural_hash(F.col("a")) == T.structural_hash(F.col("b")), a="  x ", b="x") is True


def test_distances(spark):
    assert one(spark, F.levenshtein("a", "b"), a="kitten", b="sitting") == 3
    assert one(spark, T.is_fuzzy_match(F.col("a"), F.col("b"), 0.43), a="kitten", b="sitting") is True
    assert one(spark, T.is_fuzzy_match(F.col("a"), F.col("b"), 0.34), a="kitten", b="sitting") is False
    assert one(spark, T.is_fuzzy_match(F.col("a"), F.col("b"), 0.2), a="", b="") is True


def test_formats(spark):
    rows = spark.createDataFrame([("a/b.MD", "x"), ("c.xyz", "x"), ("d.txt", " \n")], ["path", "text"])
    got = {r["path"]: (r["format"], r["error"]) for r in files.prepare(rows).collect()}
    assert got == {"a/b.MD": ("markdown", None), "c.xyz": (None, "UNSUPPORTED_FORMAT"), "d.txt": ("plain", "EMPTY_DOCUMENT")}


def test_sentences_cover_their_block(spark):
    text = "Éa b. C!? d\n\nno end"
    docs = spark.createDataFrame([(1, text), (2, "")], ["doc_id", "text"])
    b = structure.blocks(docs)
    s = structure.sentences(b).orderBy("block", "n").collect()
    assert [r["text"] for r in s] == ["Éa b. ", "C!? ", "d", "no end"]
    raw = text.split("\n")[0].encode()
    assert all(raw[r["char_start"] : r["char_end"]].decode() == r["text"] for r in s if r["block"] == 1)


def test_section_path(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, 2, 3, 2, 1, 2])], ["d", "k", "level"])
    got = [r["section_path"] for r in structure.section_path(rows, "d", "k", "level").orderBy("k").collect()]
    assert got == ["1", "1.1", "1.1.1", "1.2", "2", "2.1"]


def test_twins_lose_one(spark):
    nodes = lambda n: spark.createDataFrame([(1, k, "Warning!") for k in range(n)], ["doc_id", "block", "text"])
    got = [r["status"] for r in diff.exact(nodes(3), nodes(2)).collect()]
    assert sorted(got) == ["deleted", "kept", "kept"]


def test_phrase_and_score(spark):
    rows = spark.createDataFrame([(1, "a a a b"), (2, "c"), (3, None)], ["i", "t"])
    got = search.bm25(rows, "t", ["a", "a"]).select("i", "frequency").collect()
    assert [(r["i"], r["frequency"]) for r in got] == [(1, 2)]


def test_highlight_of_letters_in_either_case(spark):
    assert one(spark, search.highlight(F.col("t"), ["état", "élan"]), t="un État ÉLAN, états") == "un <mark>État ÉLAN</mark>, états"


def test_anchor(spark):
    status = anchors.anchor_status(F.col("t"), F.lit(0), F.lit(2), F.col("q"))
    assert [one(spark, status, t=t, q="ab") for t in ("abc", "xab", "x")] == ["active", "active_partial", "orphan"]
    assert one(spark, anchors.occurrences(F.col("t"), F.col("q")), t="ab.ab.ab", q="ab") == [0, 3, 6]


def test_fuzzy_diff_equals_rounds_of_mutual_bests(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def rounds(olds, news):
        for k in list(olds):  # equal texts go one to one first
            j = next((j for j in news if news[j] == olds[k]), None)
            if j is not None:
                del olds[k], news[j]
        size = {(i, j): max(len(a.encode()), len(b.encode())) for i, a in olds.items() for j, b in news.items()}
        pairs = {k: (d / z, d) for k, z in size.items() if (d := distance(olds[k[0]], news[k[1]])) / z <= 0.2}
        out = set()
        while pairs:
            best = [p for p in pairs if p == min((q for q in pairs if q[0] == p[0]), key=lambda q: (pairs[q][0], q[1])) and p == min((q for q in pairs if q[1] == p[1]), key=lambda q: (pairs[q][0], q[0]))]
            out |= {(*p, pairs[p][1]) for p in best}
            pairs = {q: v for q, v in pairs.items() if not any(q[0] == p[0] or q[1] == p[1] for p in best)}
        return out

    r = random.Random(4)
    old, new, want = [], [], set()
    for d in range(12):
        base = "".join(r.choice("aé日 x") for _ in range(r.choice((12, 30, 450))))
        edit = lambda t: "".join(r.choice("bß本") if r.random() < 0.06 else c for c in t)
        olds = {k: edit(base) for k in range(1, 6)}
        news = {k: r.choice((edit(base), olds[k])) for k in range(1, 6)}
        old += [(d, k, t) for k, t in olds.items()]
        new += [(d, k, t) for k, t in news.items()]
        want |= {(d, *x) for x in rounds(dict(olds), dict(news))}
    nodes = lambda rows: spark.createDataFrame(rows, "doc_id long, block long, text string")
    assert {tuple(x) for x in diff.fuzzy(nodes(old), nodes(new)).collect()} == want and len(want) > 12
    # the second pair is best only once the first is gone, and a kept node takes no part
    old, new = [(1, 1, "aaaaaaaaaa"), (1, 2, "aaaaaaaaab"), (1, 3, "zzzz")], [(1, 1, "aaaaaaaaac"), (1, 2, "aaaaaaaacc"), (1, 3, "zzzz")]
    assert {tuple(x) for x in diff.fuzzy(nodes(old), nodes(new)).collect()} == {(1, 1, 1, 1), (1, 2, 2, 2)}


def test_a_document_of_many_blocks_is_matched_by_several_tasks(spark):
    """Short, long, spread and odd texts of one document: the same pairs as all pairs of it, and grams that many tasks share."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(300)]
    olds = {k: " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 2, 4, 12, 60)))) for k in range(1500)}
    edit = lambda t, share: "".join(r.choice(("", "x", c + "y")) if r.random() < share else c for c in t)
    news = {k: edit(t, r.choice((0.0, 0.01, 0.05, 0.1, 0.25))) for k, t in olds.items() if r.random() < 0.9}
    rows = lambda x: spark.createDataFrame([(1, k, t) for k, t in x.items() if t], "doc_id long, block long, text string")
    a, b = rows(olds), rows(news)
    rest = diff.left_over(a, b).collect()
    free = [[(x["block"], x["text"]) for x in rest if x["is_new"] == k] for k in (0, 1)]
    both = spark.createDataFrame([(i, j, s, t) for i, s in free[0] for j, t in free[1] if abs(len(s) - len(t)) <= 0.2 * max(len(s), len(t))], "i long, j long, s string, t string")
    every = both.select("i", "j", F.levenshtein("s", "t").alias("d"), (F.levenshtein("s", "t") / F.greatest(F.octet_length("s"), F.octet_length("t"))).alias("q")).where("q <= 0.2").collect()
    want, taken = set(), (set(), set())
    for x in sorted(every, key=lambda x: (x["q"], x["i"], x["j"])):
        if x["i"] not in taken[0] and x["j"] not in taken[1]:
            taken[0].add(x["i"]), taken[1].add(x["j"])
            want.add((1, x["i"], x["j"], x["d"]))
    assert {tuple(x) for x in diff.fuzzy(a, b).collect()} == want and len(want) > 500


def test_kept_grams_are_shared_with_a_common_run():
    r = random.Random(7)
    for least, (gram, window) in diff.SCHEMES.items():
        for _ in range(200 if gram else 0):
            run = "".join(r.choice("ab é日") for _ in range(least))
            sides = [diff.sampled_grams(*(("".join(r.choice("ab") for _ in range(r.randint(0, 20))) + run + "".join(r.choice("ab") for _ in range(r.randint(0, 20)))), gram, window))[0] for _ in range(2)]
            assert set(sides[0].tolist()) & set(sides[1].tolist())


def test_cycles_of_any_length(spark):
    ring = [(100 + k, 100 + (k + 1) % 13) for k in range(13)]  # longer than ten, and no id below ten
    rows = [*ring, (1, 100), (105, 2), (2, 3), (50, 51), (51, 50), (51, 52), (52, 53), (53, 50), (7, 7), (7, 50), (100, 101), (None, 1), (1, None)]
    got = anchors.cycles(spark.createDataFrame(rows, "source_id long, target_id long")).collect()
    assert sorted(map(tuple, got)) == [(7, 1), (50, 2), (51, 2), (52, 4), (53, 4), *((100 + k, 13) for k in range(13))]
    assert anchors.cycles(spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long")).count() == 0


def test_edge_cycles_reads_every_edge(spark, tmp_path):
    spark.createDataFrame([(k, f"passage {k}") for k in range(14)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, f"a passage {k} b") for k in range(14)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    step, want = {k: (k * 3 + 1) % 10 for k in range(14)}, []
    for k in step:
        at, n = step[k], 1
        while at != k and n < 20:
            at, n = step[at], n + 1
        want += [(k, n)] * (at == k)
    assert sorted(map(tuple, catalogue.edge_cycles(spark, str(tmp_path)).collect())) == want and want


def test_every_sentence_is_loaded(spark, tmp_path):
    spark.createDataFrame([(1, "\u00c9a b. C!? d\n\nno end"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.load_sentence(spark, str(tmp_path)).collect()))
    assert got == [(1, 1, 1, "\u00c9a b. "), (1, 1, 2, "C!? "), (1, 1, 3, "d"), (1, 2, 1, "no end")]


def test_highlight_reads_documents_in_any_script(spark, tmp_path):
    texts = ["OF the x", "caf\u00e9 of\u00a0the \u65e5", "\u00e9of the", "of the\u00e9", "\u65e5, of, the.", None, "of them", "prof the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalogue.highlight(spark, str(tmp_path)).collect()))
    assert got == {0: "<mark>OF the</mark> x", 1: "caf\u00e9 <mark>of\u00a0the</mark> \u65e5", 4: "\u65e5, <mark>of, the</mark>."}


def test_components_equal_reachability(spark):
    r = random.Random(9)
    for n, m in ((12, 14), (30, 45), (40, 40)):
        rows = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(None, 1), (1, None), (3, 3)]
        ways = {a: {b for x, b in rows if x == a and b is not None} for a, _ in rows if a is not None}
        reach = {}
        for a in ways:
            seen, todo = set(), list(ways[a])
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += ways.get(b, ())
            reach[a] = seen
        want = {}
        for a in ways:
            own = {b for b in reach[a] if a in reach.get(b, ())}
            if own:
                want[a] = (max(own), len(own))
        got = anchors.components(spark.createDataFrame(rows, "source_id long, target_id long")).collect()
        assert {x["node"]: (x["component"], x["size"]) for x in got} == want and len(got) == len(want)
    assert anchors.components(spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long")).count() == 0


def test_components_of_long_rings_take_few_rounds(spark, monkeypatch):
    """Two rings of 300 nodes, joined one way by a chain, with a chain that leaves and comes back; a round for each node was stored."""
    ring = lambda first, n: [(first + k, first + (k + 1) % n) for k in range(n)]
    path = lambda *nodes: list(itertools.pairwise(nodes))
    rows = [*ring(0, 300), *ring(1000, 300), *path(10, *range(2000, 2050), 1005), *path(20, *range(3000, 3050), 15), *path(40, *range(4000, 4050)), *path(*range(5000, 5050), 30)]
    stored, made = anchors.shared_table, []
    monkeypatch.setattr(anchors, "shared_table", lambda rows, tag: made.append(tag) or stored(rows, tag))
    got = {(r["node"], r["component"], r["size"]) for r in anchors.components(spark.createDataFrame(rows, "source_id long, target_id long")).collect()}
    assert got == {(k, 3049, 350) for k in (*range(300), *range(3000, 3050))} | {(1000 + k, 1299, 300) for k in range(300)}
    assert len(made) < 150


def test_lineage_goes_any_way_up_and_ends_in_circles(spark):
    ties = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n20", "n15"), ("n3", "n9"), ("x", "n0"), (None, "n1"), ("y", None)], "child string, parent string")
    got = {(x["child"], x["ancestor"]): x["depth"] for x in provenance.lineage(ties, spark.createDataFrame([("n3",), ("x",), ("none",), (None,)], "child string")).collect()}
    assert got["n3", "n9"] == 1 and got["n3", "n8"] == 5 and got["n3", "n20"] == 12 and got["x", "n0"] == 1 and got["x", "n20"] == 16 and len(got) == 17 + 21
    made = spark.createDataFrame([(["a", "b"], ["c"]), (["c"], ["d", "c"]), (None, ["e"])], "input_ids array<string>, output_ids array<string>")
    assert {tuple(x) for x in provenance.links(made).collect()} == {("c", "a"), ("c", "b"), ("d", "c")}


def test_offsets_meet_the_spans_around_them(spark):
    r = random.Random(10)
    spans, at = [], 0
    for k in range(4000):
        size = r.choice((0, 1, 3, 40, 3000))
        spans.append(("n", at, at + size, k))
        at += size
    asked = [("n", r.randrange(-5, at + 5)) for _ in range(500)] + [("m", 1)]
    got = nodes.at_offset(spark.createDataFrame(spans, "node_id string, flat_start long, flat_end long, n int"), spark.createDataFrame(asked, "node_id string, offset long"), ("n",))
    want = sorted((o, k, o - a) for _, o in asked[:-1] for _, a, b, k in spans if a <= o < b)
    assert sorted((x["offset"], x["n"], x["inside"]) for x in got.collect()) == want
