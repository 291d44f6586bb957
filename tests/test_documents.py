"""Parsers, the node tree, versions, the corpus on disk, search, annotations, edges, rendering and the commands."""

import json
import random
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from quillstone import api, config
from quillstone.functions import sentences, stemming
from quillstone.operators import anchors, annotations, corpus, discover, merge, nodes, provenance, render, search
from quillstone.sources import files, markup
from quillstone.streaming import changes


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def kinds(text, form="markdown"):
    return [b["t"] for b in markup.parse(text, form)]


def test_markdown_blocks():
    text = "# T\n\nSub\n---\n\npara\nlazy\n\n- a\n- b\n  1. c\n\n> q\n> > r\n\n```py\nx\n```\n\n    code\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n***\n\n<div>x</div>\n\n| line\n| two\n"
    assert kinds(text) == ["Header", "Header", "Para", "BulletList", "BlockQuote", "CodeBlock", "CodeBlock", "Table", "HorizontalRule", "RawBlock", "LineBlock"]
    assert markup.parse("- a\n- b\n  - c", "markdown")[0]["c"][1][1]["t"] == "BulletList"
    assert kinds(">" * 3000 + " x") == ["BlockQuote"] and kinds("") == []


def test_markdown_inlines():
    flat = lambda t: markup.flatten(markup.inlines(t))
    text, leaves = flat("a *b **c** d* `e f` $x^2$ [g](http://h 't') ![i](j) ~~k~~ \\*l\\* &amp; <http://m.n> [^o] p_q_r *")
    assert text == "a b c d e f x^2 g i k *l* & http://m.n  p_q_r *"
    raw = text.encode()
    assert [raw[s:e].decode() for s, e, atomic, _ in leaves if atomic] == ["e f", "x^2", "i"]
    assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False)) and leaves[-1][1] == len(raw)
    assert flat("é  \nß")[0] == "é ß" and [k for _, _, k in flat("**_x_**")[1][0][3]] == ["Strong", "Emph", "Str"]
    for hostile in ("*a " * 30_000, "[" * 30_000, "`a``" * 10_000, "$ a" * 20_000):
        assert flat(hostile)[0]


def test_html_blocks():
    page = "<head><title>n</title></head><body><h2>T <em>x</em></h2>loose<p>a<p>b <b>c</b><ul><li>1<li>2<ol start=3><li>3</ol></ul><table><tr><td>x<td>y</table><pre>k\n l</pre><script>z</script><dl><dt>t<dd>d</dl><hr><blockquote>q</blockquote><figure><img alt=i></figure>"
    found = markup.parse(page, "html")
    assert [b["t"] for b in found] == ["Header", "Plain", "Para", "Para", "BulletList", "Table", "CodeBlock", "DefinitionList", "HorizontalRule", "BlockQuote", "Figure"]
    assert found[4]["c"][1][1]["c"][0][0] == 3 and '"z"' not in json.dumps(found)


def test_other_formats():
    import io
    import zipfile

    assert kinds("a\nb\n\n c", "plain") == ["Para", "Para"] and kinds('{"blocks": [{"t": "HorizontalRule"}]}', "json") == ["HorizontalRule"]
    for broken in ("{", '{"x": 1}', "[1]"):
        with pytest.raises(markup.ParseError):
            markup.parse(broken, "json")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>a b</w:t></w:r></w:p></w:body></w:document>')
    assert kinds(buffer.getvalue(), "docx") == ["Header", "Para"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="o/p.opf"/></container>')
        z.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p>two</p>"), z.writestr("o/b.xhtml", "<h1>one</h1>")
    assert kinds(buffer.getvalue(), "epub") == ["Header", "Para"]
    with pytest.raises(markup.ParseError):
        markup.parse(b"no zip", "docx")


DIALECT_PAGES = {
    "org": "#+TITLE: T\n* Head\n:PROPERTIES:\n:ID: x\n:END:\nSome *bold* /it/ [[http://u][link]] =c=.\n\n- a\n  - b\n\n#+BEGIN_SRC py\n* code\n#+END_SRC\n\n| a | b |\n|---+---|\n| 1 | 2 |\n",
    "rst": "Head\n====\n\nSub\n---\n\nSome **bold** *it* ``c`` `link <http://u>`_.\n\n* a\n* b\n\n.. code-block:: py\n\n   x = 1\n\n.. note:: mind\n\n+---+---+\n| a | b |\n+===+===+\n| 1 | 2 |\n+---+---+\n",
    "mediawiki": "== Head ==\nSome \'\'\'bold\'\'\' \'\'it\'\' [http://u link] [[Page|name]].<ref>no</ref>\n\n* a\n** b\n# c\n\n{|\n! a !! b\n|-\n| 1 || 2\n|}\n----\n<pre>\ncode\n</pre>\n",
    "textile": "h1. Head\n\nSome *bold* _it_ @c@ \"link\":http://u\n\n* a\n** b\n\nbq. quote\n\nbc. code\n\n|_. a|_. b|\n|1|2|\n",
    "asciidoc": "= Head\n\n== Sub\n\nSome *bold* _it_ `c` http://u[link].\n\n* a\n** b\n\nNOTE: mind\n\n----\ncode\n----\n\n|===\n|a |b\n|1 |2\n|===\n",
    "latex": "\\documentclass{a}\n\\title{T}\n\\begin{document}\n\\section{Head} % no\nSome \\textbf{bold} \\emph{it} $x$ \\href{http://u}{link}.\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{verbatim}\ncode\n\\end{verbatim}\n\\end{document}\n",
    "jira": "h1. Head\n\nSome *bold* _it_ {{c}} [link|http://u]\n\n* a\n** b\n\n{code:py}\ncode\n{code}\n\n{quote}\nq\n{quote}\n\n||a||b||\n|1|2|\n",
    "opml": "<opml><head><title>Head</title></head><body><outline text='a'><outline text='b' _note='n'/></outline></body></opml>",
    "docbook": "<article><title>Head</title><section><title>Sub</title><para>Some <emphasis>it</emphasis>.</para><itemizedlist><listitem><para>a</para></listitem></itemizedlist><programlisting>code</programlisting><note><para>mind</para></note></section></article>",
}


@pytest.mark.parametrize("form", DIALECT_PAGES)
def test_other_markup(form):
    rows = nodes.tree(DIALECT_PAGES[form], form, "d")
    found = {r["node_type"] for r in rows}
    assert any(r["node_type"] == "heading" and r["text"] == "Head" for r in rows) and "list_item" in found
    assert [r["text"] for r in rows if r["node_type"] == "code_block"] == {"org": ["* code"], "rst": ["x = 1"], "opml": []}.get(form, ["code"])
    assert form in ("latex", "opml", "docbook") or "table" in found
    if form not in ("opml", "docbook"):
        text = next(r["text"] for r in rows if r["node_type"] == "paragraph" and r["text"].startswith("Some"))
        assert text.startswith("Some bold it") and "link" in text and not any(x in text for x in ("*", "http", "\\", "no"))
    assert form not in ("rst", "asciidoc", "jira", "textile", "docbook") or "blockquote" in found
    with pytest.raises(markup.ParseError):
        markup.parse("<a", "opml")


def test_sentence_boundaries():
    cut = lambda t: [t.encode()[a:b].decode() for a, b in sentences.spans(t)]
    assert cut("Mr. smith went. He said \"Hi.\" then left? Yes! 3.5 is ok. U.S. law") == ["Mr. smith went. ", 'He said "Hi." then left? ', "Yes! ", "3.5 is ok. ", "U.S. law"]
    assert cut("a.\nB\r\nc d") == ["a.\n", "B\r\n", "c ", "d"] and cut(" \n") == [] and cut("日本。中国！") == ["日本。", "中国！"]
    assert sentences.pushed(25, [(4, 26)]) == 26 and sentences.pushed(6, [(4, 26)]) == 4 and sentences.pushed(15, [(4, 26)]) == 26 and sentences.pushed(4, [(4, 26)]) == 4
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice("aB1 .?!\")\n,é日́") for _ in range(r.randint(1, 30)))
        found = sentences.spans(t)
        assert not t.strip() or (found[0][0] == 0 and found[-1][1] == len(t.encode()) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)))


def test_tree():
    rows = nodes.tree("# T\n\nOne. Two `a. b` x.\n\n- a\n- b\n  - c\n\n> q\n\n---\n\n|a|b|\n|-|-|\n|1|2|\n", "markdown", "d")
    assert [r["node_type"] for r in rows] == ["document", "heading", "paragraph", "sentence", "sentence", "sentence", "list_item", "list_item", "paragraph", "sentence", "list_item", "paragraph", "sentence", "list_item", "list_item", "paragraph", "sentence", "blockquote", "paragraph", "sentence", "thematic_break", "table"]
    assert [r["position"] for r in rows] == [1000.0 * k for k in range(len(rows))] and rows[1]["level"] == 1 and rows[-1]["text"] == ""
    by_path = {tuple(r["path"]): r for r in rows}
    assert all(r["parent_id"] == by_path[tuple(r["path"][:-1])]["node_id"] for r in rows[1:]) and len({r["node_id"] for r in rows}) == len(rows)
    # a boundary in code moves off it, and sentences are their paragraph
    own = [r for r in rows if r["path"][:1] == [1] and r["node_type"] == "sentence"]
    assert [r["text"] for r in own] == ["One. ", "Two a. b", " x."] and "".join(r["text"] for r in own) == by_path[(1,)]["text"]
    assert nodes.tree("|a|b|\n|-|-|\n|1|2|", "markdown", "d", table_text=True)[1]["text"] == "a | b\n1 | 2"
    assert [r["node_id"] for r in nodes.tree("a\n\nb", "markdown", "d")][2] == [r["node_id"] for r in nodes.tree("x\n\na\n\nb", "markdown", "d")][4]


def frame(spark, texts, form="markdown"):
    return spark.createDataFrame([(k, t, form) for k, t in texts.items()], "doc_id string, text string, format string")


def segmented(spark, texts, form="markdown"):
    return nodes.segment(frame(spark, texts, form), "doc_id", F.col("text"), F.col("format"), "uax29")


def test_segment_and_rejects(spark):
    found = segmented(spark, {"a": "One. Two.", "b": " ", "c": None})
    assert nodes.accepted(found).count() == 4 and {tuple(r) for r in nodes.rejected(found).collect()} == {("b", "EMPTY_DOCUMENT"), ("c", "EMPTY_DOCUMENT")}
    spans = nodes.inline_spans(nodes.accepted(segmented(spark, {"a": "x **y** `z`"}))).orderBy("n").collect()
    assert [(r["flat_start"], r["flat_end"], r["is_atomic"], r["kinds"]) for r in spans] == [(0, 1, False, "Str"), (1, 2, False, "Space"), (2, 3, False, "Strong/Str"), (3, 4, False, "Space"), (4, 5, True, "Code")]


def versions(spark, before, after, mode="set", **more):
    old = nodes.accepted(segmented(spark, {"d": before})).withColumns({"version": F.lit(1), "status": F.lit("active")})
    new = nodes.accepted(segmented(spark, {"d": after}))
    return old.collect(), merge.merge(old, new, mode=mode, **more).collect()


@pytest.mark.parametrize("mode", ["set", "sequential"])
def test_merge(spark, mode):
    old, got = versions(spark, "# Head\n\nThe first paragraph here.\n\nWarning!\n\nWarning!\n\nWarning!\n\nGone for good.", "## Head\n\nWarning!\n\nThe first paragraph there.\n\nWarning!\n\nSomething else entirely, new.", mode)
    now = {r["position"]: r for r in got if r["status"] == "active"}
    before = {r["text"]: r for r in old if r["node_type"] != "document"}
    text = lambda t: [r for r in now.values() if r["text"] == t and r["node_type"] == "paragraph"]
    head = next(r for r in now.values() if r["node_type"] == "heading")
    assert head["node_id"] == before["Head"]["node_id"] and head["level"] == 2 and head["outcome"] == "kept" and head["version"] == 1
    moved = text("The first paragraph there.")[0]
    assert moved["outcome"] == "updated" and moved["version"] == 2 and moved["node_id"] in {r["node_id"] for r in old if r["text"] == "The first paragraph here."}
    assert [r["outcome"] for r in text("Warning!")] == ["kept", "kept"] and text("Something else entirely, new.")[0]["outcome"] == "new"
    deleted = [r for r in got if r["status"] == "deleted"]
    assert sorted(r["text"] for r in deleted) == sorted(["Warning!", "Warning!", "Gone for good.", "Gone for good."])
    ids = {r["node_id"] for r in now.values()}
    assert all(r["parent_id"] in ids for r in now.values() if r["path"]) and len(ids) == len(now)
    assert len({r["node_id"] for r in got}) == len(got)


def test_merge_counts_add_up(spark):
    r = random.Random(3)
    line = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(r.randint(1, 6)))
    before = {f"d{k}": "\n\n".join(line() for _ in range(6)) for k in range(6)}
    after = {d: "\n\n".join(x if r.random() < 0.6 else line() for x in t.split("\n\n") if r.random() < 0.9) or "x" for d, t in before.items()}
    old = nodes.accepted(segmented(spark, before)).withColumns({"version": F.lit(1), "status": F.lit("active")})
    new = nodes.accepted(segmented(spark, after))
    sizes = lambda df: {x["doc_id"]: x["n"] for x in df.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    a, b = sizes(old), sizes(new)
    for mode in ("set", "sequential"):
        for x in merge.counts(merge.merge(old, new, mode=mode)).collect():
            assert x["n_kept"] + x["n_updated"] + x["n_new"] == b[x["doc_id"]] and x["n_kept"] + x["n_updated"] + x["n_deleted"] == a[x["doc_id"]]


def test_merge_works_out_each_version_a_few_times(spark):
    """Each use of a version is a scan of its own."""
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(rows, total):
        def run(batches):
            for b in batches:
                total.add(b.num_rows)
                yield b

        return rows.mapInArrow(run, rows.schema)

    texts = ["one two three", "four five six seven eight", "nine ten"]
    rows = [(f"d{d}", f"d{d}/{k}", f"d{d}", [k] if k else [], "paragraph", 1000.0 * k, t, t) for d in range(5) for k, t in enumerate(["", *texts])]
    new = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, path array<int>, node_type string, position double, text string, structural_hash string")
    old = new.withColumn("text", F.when(F.col("position") == 2000, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumns({"version": F.lit(1), "status": F.lit("active")})
    got = merge.merge(counted(old, seen[0]), counted(new, seen[1])).collect()
    assert sorted((r["position"], r["outcome"]) for r in got) == sorted((k * 1000.0, "updated" if k == 2 else "kept") for k in range(4) for _ in range(5))
    assert all(t.value <= 6 * len(rows) for t in seen), [t.value / len(rows) for t in seen]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_sequential_equals_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    edit = lambda t: "".join(r.choice(["", c + "x", "y"]) if r.random() < 0.08 else c for c in t)
    before = {d: [" ".join(word() for _ in range(r.randint(0, 6))) for _ in range(25)] for d in range(4)}
    after = {d: [edit(t) if r.random() < 0.6 else t for t in r.choices(x, k=22)] for d, x in before.items()}
    frame = lambda x: spark.createDataFrame([(d, k, t) for d, ts in x.items() for k, t in enumerate(ts)], "doc_id long, block long, text string")
    want = set()
    for d, new in after.items():
        free = dict(enumerate(before[d]))
        for n, t in enumerate(new):
            equal = [o for o, x in free.items() if x.strip() == t.strip()]
            size = {o: max(len(x.encode()), len(t.encode())) for o, x in free.items()}
            near = [(plain_distance(x, t) / size[o], o) for o, x in free.items() if size[o]]
            found = equal[0] if equal else min((x for x in near if x[0] <= 0.2), default=(0, None))[1]
            if found is not None:
                want.add((d, found, n, "kept" if equal else "updated"))
                del free[found]
    assert {tuple(x) for x in merge.sequential(frame(before), frame(after), 0.2).collect()} == want
    assert {o for *_, o in want} == {"kept", "updated"}


def test_sequential_measures_long_lines_in_time(spark):
    r = random.Random(5)
    long = ["".join(r.choice("abcdefgh ") for _ in range(60_000)) for _ in range(2)]
    frame = lambda x: spark.createDataFrame([(1, k, t) for k, t in enumerate(x)], "doc_id long, block long, text string")
    start = time.perf_counter()
    got = merge.sequential(frame(long), frame(["z" + long[1][:30_000] + "z" + long[1][30_001:], long[0][::-1]]), 0.2).collect()
    assert [tuple(x) for x in got] == [(1, 1, 0, "updated")] and time.perf_counter() - start < 60


def test_cut_references_stay():
    text = lambda t: markup.flatten(markup.parse(f"<h1>{t}</h1>", "html")[0]["c"][2])[0]
    assert text("a &amp; b &lt;c&gt; &#233;&#xe9;&eacute;") == "a & b <c> éé" + "é"
    assert text("a&amp") == "a&amp" and text("&lt b &notit; &") == "&lt b &notit; &"


def test_trees_without_ast_and_in_few_bytes(spark):
    import pyarrow as pa

    whole = nodes.tree("# A *b*\n\n`c. d` e. F\n\n| x\n", "markdown", "d", "uax29")
    assert [{**r, "ast": None} for r in whole] == nodes.tree("# A *b*\n\n`c. d` e. F\n\n| x\n", "markdown", "d", "uax29", ast=False)
    assert list(nodes.few(pa.array(["x" * nodes.PART, "y", None, "z" * nodes.PART, "z"]))) == [(0, 1), (1, 2), (3, 1), (4, 1)]
    assert list(nodes.few(pa.array(["x"] * 130))) == [(0, 64), (64, 64), (128, 2)] and list(nodes.few(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("text", ["a *b* `c` d", "x ![p *q*](r) é $y$ <b>z</b> [l](m) ~~n~~ &amp; [^o]"])
def test_spoken_is_what_flatten_gives(text):
    content = markup.inlines(text)
    whole, leaves = markup.flatten(content)
    assert markup.spoken(content) == (whole, [(a, b) for a, b, atomic, _ in leaves if atomic])


def test_lineage_of_many_from_few(spark, monkeypatch):
    ties = [(f"d{k}", f"i{k % 3}") for k in range(40)] + [("d0", "i2"), ("i0", "i1"), ("i1", "i2"), ("i2", "i0"), ("i2", "j"), ("j", "d1")]
    up, want = {}, {}
    for a, b in ties:
        up.setdefault(a, set()).add(b)
    for d in (f"d{k}" for k in range(40)):
        depth, front = 0, {d}
        while front:
            depth += 1
            front = {p for x in front for p in up.get(x, ())} - {a for c, a in want if c == d}
            want |= {(d, a): depth for a in front}
    frame = spark.createDataFrame(ties, "child string, parent string")
    rows = []
    monkeypatch.setattr(provenance, "closure", lambda new, known, own=provenance.closure: rows.append(new.count()) or own(new, known))
    got = provenance.lineage(frame, frame.select("child").where("child like 'd%'"))
    assert {(r["child"], r["ancestor"]): r["depth"] for r in got.collect()} == want and rows == [4]


def test_corpus_versions(spark, tmp_path):
    store = corpus.Corpus(spark, str(tmp_path / "c"))
    rows = lambda *x: spark.createDataFrame(list(x), "node_id string, text string, created_at int")
    assert store.version() == 0 and not store.has("nodes")
    store.commit({"nodes": rows(("a", "1", 5), ("b", "1", 5)), "activities": rows(("x", "log", 1))})
    store.commit({"nodes": rows(("b", "2", 9), ("c", "2", 9)), "activities": rows(("x", "log", 1))})
    want = [("a", "1", 5), ("b", "2", 5), ("c", "2", 9)]
    assert sorted(map(tuple, store.table("nodes").collect())) == want and store.table("activities").count() == 2
    assert sorted(map(tuple, store.table("nodes", 1).collect())) == [("a", "1", 5), ("b", "1", 5)]
    assert store.compact("nodes") == 3 and sorted(map(tuple, store.table("nodes").collect())) == want
    late = corpus.Corpus(spark, str(tmp_path / "c"))
    late.version = lambda: 2
    with pytest.raises(corpus.ConflictError):
        late.commit({"nodes": rows(("z", "3", 1))})
    assert sorted(map(tuple, corpus.upsert(rows(("a", "1", 5)), rows(("a", "2", 6), ("b", "2", 6)), "node_id").select("node_id", "text", "created_at").collect())) == [("a", "2", 5), ("b", "2", 6)]


def test_stems_equal_sqlite():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll by say cry oddly running flies dogs Café".split()
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    base.execute("create virtual table v using fts5vocab(t, row)")
    for w in words:
        base.execute("delete from t"), base.execute("insert into t values (?)", (w,))
        assert [r[0] for r in base.execute("select term from v")] == stemming.terms(w), w


def test_search_equals_sqlite(spark):
    r = random.Random(2)
    vocabulary = ["dog", "dogs", "Café", "cafe", "running", "run", "the", "tree's", "x-ray", "naïve"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12))) for _ in range(60)]
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    for k, t in enumerate(texts):
        base.execute("insert into t(rowid, x) values (?, ?)", (k + 1, t))
    rows = spark.createDataFrame([("d" if k % 2 else "e", str(k + 1), "sentence", "active", t) for k, t in enumerate(texts)], "doc_id string, node_id string, node_type string, status string, text string")
    index = search.build_index(rows)
    for query in ("dog", "the dogs", 'run "cafe', "naive x ray"):
        phrase = '"' + query.replace('"', '""') + '"'
        want = {str(i): (s, h) for i, s, h in base.execute("select rowid, bm25(t), highlight(t, 0, '<mark>', '</mark>') from t where t match ?", (phrase,))}
        hits = search.search(index, query, k=100)
        got = {h["node_id"]: h for h in search.snippets(hits, rows, query).collect()}
        assert set(got) == set(want)
        assert all(abs(got[i]["score"] - s) < 1e-5 for i, (s, _) in want.items())
        for i, (_, h) in want.items():
            assert got[i]["snippet"].replace("</mark> <mark>", " ") == h.replace("</mark> <mark>", " ")
    assert search.search(index, "dog", "d").where("doc_id <> 'd'").count() == 0 < search.search(index, "dog", "d").count()
    assert search.search(index, " \"-\" ").count() == 0 and search.search(index, "dog", k=1).count() == 1 and search.search(index, "dog", level="heading").count() == 0
    # statistics over all rows, hits among the active ones
    gone = rows.withColumn("status", F.when(F.col("node_id") == "1", "deleted").otherwise("active"))
    assert search.search(search.build_index(gone), "dog", k=100, all_statistics=True).where("node_id = '1'").count() == 0


def test_passages_of_any_length(spark):
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("ab é.") for _ in range(n))
    texts = [letters(r.randint(0, 60)) for _ in range(60)] + [None]
    quotes = [letters(r.randint(0, 14)) for _ in range(40)] + [t[a : a + r.randint(1, 40)] for t in texts[:20] if t for a in [r.randrange(len(t))]]
    want = sorted((d, i) for d, t in enumerate(texts) for i, q in enumerate(quotes) if t is not None and q and q in t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = lambda some: spark.createDataFrame(some, "item_id long, quote string")
    assert sorted((x["doc_id"], x["item_id"]) for x in search.containing(docs, passages(list(enumerate(quotes)))).collect()) == want and len(want) > 20
    assert search.containing(docs, passages([(1, "")])).count() == 0


def test_annotations(spark):
    text = "Énd. The quick brown fox; the quick red fox."
    held = spark.createDataFrame([("d", "n1", text, 3), ("d", "n2", "other", 1)], "doc_id string, node_id string, text string, version int")
    schema = "request_id int, doc_id string, node_id string, quote string, body string, motivation string"
    asked = spark.createDataFrame([(1, "d", "n1", "quick", "note", None), (2, "d", "n2", None, None, "tagging"), (3, "d", "n9", None, None, None), (4, "d", "n1", "absent", None, None), (5, "x", "n1", None, None, None)], schema)
    made, rejects = annotations.annotate(asked, held, now())
    assert {(r["request_id"], r["error"]) for r in rejects.collect()} == {(3, "SENTENCE_NOT_FOUND"), (4, "QUOTE_NOT_FOUND"), (5, "SENTENCE_NOT_FOUND")}
    one = made.where("target_id = 'n1'").first()
    assert (one["char_start"], one["char_end"], one["exact"], one["prefix"], one["motivation"], one["status"]) == (10, 15, "quick", "Énd. The ", "commenting", "active")
    assert json.loads(one["body"])["value"] == "note" and json.loads(one["selectors"])[0]["start"] == 10
    back = made.where("target_id = 'n1'").select(annotations.from_selectors(F.col("selectors")).alias("s")).first()["s"]
    assert back.asDict() == {"start": 10, "end": 15, "exact": "quick", "prefix": one["prefix"], "suffix": one["suffix"]}
    later = spark.createDataFrame([("d", "n1", "the quick x. " + text, "active")], "doc_id string, node_id string, text string, status string")
    found = {r["annotation_id"]: r for r in annotations.resolve(made, later).collect()}
    assert (found[one["annotation_id"]]["new_status"], found[one["annotation_id"]]["new_start"], found[one["annotation_id"]]["confidence"]) == ("active_partial", 23, 0.8)
    moved = {r["target_id"]: r for r in annotations.with_status(made, annotations.resolve(made, later)).collect()}
    assert moved["n2"]["status"] == "orphan" and moved["n1"]["char_start"] == 23
    gone = annotations.orphaned(made, spark.createDataFrame([("n1",)], "node_id string"))
    assert {r["target_id"]: r["status"] for r in gone.collect()} == {"n1": "orphan", "n2": "active"}
    assert annotations.for_target(annotations.removed(gone, made.where("target_id = 'n2'")), "n2").count() == 0 and annotations.for_document(gone, "d").count() == 2


def test_a_lost_quote_is_found_in_another_node(spark):
    """Against every active node of the same type, one by one, with repeated texts, ties, nulls, short and odd quotes."""
    r = random.Random(3)
    words = ["red", "fox", "RAN", "État", "sun", "low"]
    line = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", ", ", "-"]) for _ in range(n))
    nodes_of = []
    for doc in ("d", "e"):
        texts = [line(r.randint(0, 9)) for _ in range(25)]
        nodes_of += [(doc, f"{doc}{k}", r.choice(["sentence", "paragraph"]), float(r.choice([k, k, 7])), r.choice([1, 2]), r.choice(["active", "active", "deleted"]), r.choice([texts[k], texts[k], r.choice(texts), None])) for k in range(25)]
    lost = []
    for k in range(600):
        doc, node_id = (n := r.choice(nodes_of))[0], n[1]
        text = r.choice([m[6] for m in nodes_of if m[0] == doc and m[6]] or ["x"])
        a, b = sorted(r.sample(range(len(text) + 1), 2)) if len(text) > 1 else (0, len(text))
        exact = r.choice([text[a:b], text[a:b].upper(), text, line(4).strip(), "", "--", None])
        lost.append((f"a{k}", doc, node_id if k % 9 else "none", exact, r.choice([None, text[:a], "zz"]), r.choice([None, text[b:]])))
    nodes = spark.createDataFrame(nodes_of, "doc_id string, node_id string, node_type string, position double, version int, status string, text string")
    frame = spark.createDataFrame(lost, "annotation_id string, doc_id string, target_id string, exact string, prefix string, suffix string")
    got = {x["annotation_id"]: (x["new_target"], x["new_version"], x["new_start"], x["new_end"], x["confidence"]) for x in annotations.moved(frame, nodes).collect()}
    split = lambda text: re.findall(r"[^\W_]+", text.lower())
    want = {}
    for name, doc, target, exact, prefix, suffix in lost:
        was = next((n for n in nodes_of if n[1] == target), None)
        quote = split(exact or "")
        best = []
        for n in nodes_of if was and quote else []:
            if n[0] == doc and n[2] == was[2] and n[5] == "active" and n[6]:
                status, start, end, sure = annotations.resolved(n[6], None, None, exact, prefix, suffix)
                held = split(n[6])
                whole = len(quote) > 2 or any(held[i : i + len(quote)] == quote for i in range(len(held)))
                if status != "orphan" and whole:
                    best.append(((-sure, abs(n[3] - was[3]), n[3], n[1]), (n[1], n[4], start, end, sure)))
        if best:
            want[name] = min(best)[1]
    assert got == want and len(want) > 40 and {w[4] for w in want.values()} == {0.8, 0.6, 0.4}
    assert annotations.moved(frame.limit(0), nodes).count() == 0 and annotations.moved(frame, nodes.limit(0)).count() == 0


def test_ingest_anchors_again_in_another_node(spark, tmp_path):
    place = tmp_path / "a.md"
    place.write_text("# Title\n\nA brown fox sat on the old wall.\n\nLast words.\n")
    one = api.Workspace(spark, str(tmp_path / "data"))
    doc = one.ingest(str(place)).first()["doc_id"]
    target = next(x["node_id"] for x in one.sentences(doc).collect() if "fox" in x["text"])
    requests = spark.createDataFrame([("r", doc, target, "brown fox sat on", None, None)], "request_id string, doc_id string, node_id string, quote string, body string, motivation string")
    assert one.annotate(requests)[0].count() == 1
    place.write_text("# Title\n\nLast words.\n\nIt is said by many in the village that one day, long ago, a brown fox sat on something else entirely and then went home to sleep.\n")
    one.ingest(str(place))
    held = one.table("annotations", "").first()
    node = one.node(held["target_id"]).first()
    assert held["status"] == "active_partial" and held["target_id"] != target and node["node_type"] == "sentence" and node["status"] == "active"
    assert node["text"].encode()[held["char_start"] : held["char_end"]] == b"brown fox sat on"


def test_anchor_resolution():
    f = annotations.resolved
    assert f("abc def", 4, 7, "def", None, None)[:3] == ("active", 4, 7) and f("xabc def", 4, 7, "def", None, None)[:3] == ("active_partial", 5, 8)
    assert f("abc", 1, 9, None, None, None)[0] == "orphan" and f("", 0, 0, "", None, None)[0] == "orphan" and f(None, 0, 1, "a", None, None)[0] == "orphan"
    assert f("a x b x c x", None, None, "x", "b ", " c")[1:3] == (6, 7) and f("x x", None, None, "x", "zz", None)[1:3] == (0, 1)
    assert f("The  Quick\nfox", 90, 99, "the quick", None, None) == ("active_partial", 0, 10, 0.4)
    assert annotations.places("aaaa".encode(), b"aa") == [0, 2]


def test_context_is_cut_at_words(spark):
    text = "alpha " * 20 + "QUOTE" + " beta" * 20
    start = text.index("QUOTE")
    rows = spark.createDataFrame([(text, start, start + 5), ("é" * 60 + "Q" + "ß" * 60, 120, 121), ("ab", 1, 1), ("ab", 1, 9), (None, 0, 1)], "t string, a int, b int")
    got = annotations.reconcile(rows, "t", "a", "b").collect()
    assert got[0]["exact"] == "QUOTE" and got[0]["prefix"].strip() == ("alpha " * 10).strip() and got[0]["suffix"].strip() == ("beta " * 12).strip()
    assert got[1]["exact"] == "Q" and got[1]["prefix"] == "" and [r["error"] for r in got] == [None, None, "EMPTY_SPAN", "OUT_OF_RANGE", "OUT_OF_RANGE"]


def test_edges(spark):
    held = spark.createDataFrame([("a", "d", 1, "active"), ("b", "d", 2, "active"), ("c", "e", 5, "deleted")], "node_id string, doc_id string, version int, status string")
    asked = spark.createDataFrame([("a", "b", "cites"), ("a", "a", "cites"), ("a", "x", "cites"), ("a", "b", "likes"), ("b", "c", "derives-from"), ("a", "b", None)], "source_id string, target_id string, predicate string")
    made, rejects = anchors.create(asked, held, now())
    assert sorted(r["error"] for r in rejects.collect()) == ["INVALID_PREDICATE", "INVALID_PREDICATE", "NODE_NOT_FOUND", "SELF_EDGE"]
    assert {(r["source_id"], r["target_id"], r["version_at_include"], r["status"]) for r in made.collect()} == {("a", "b", 2, "live"), ("b", "c", 5, "live")}
    every = spark.createDataFrame([("a", "b", p) for p in anchors.PREDICATES], "source_id string, target_id string, predicate string")
    assert anchors.create(every, held, now())[0].count() == 8 and set(anchors.PREDICATES) == {"transcludes", "cites", "derives-from", "references", "extends", "refutes", "translates", "summarizes"}
    newer = held.withColumn("version", F.col("version") + 1)
    assert {r["target_id"]: r["status"] for r in anchors.refreshed(made, newer).collect()} == {"b": "stale", "c": "orphaned"}
    assert anchors.by_source(made, "a").count() == 1 == anchors.by_target(made, "c").count()


def test_rendering(spark):
    text = "# T\n\nA *b* **c** `d` $e$ [f](g) ~~h~~\n\n```py\nx\n```\n\n> q\n> > r\n\n- a\n- b\n\n1. x\n2. y\n\n---\n\nEnd. Two.\n"
    held = nodes.accepted(segmented(spark, {"d": text}))
    show = lambda kind, markers=False: render.project(held, kind, markers).first()
    assert show("markdown")["text"] == "# T\n\nA *b* **c** `d` $e$ [f](g) ~~h~~\n\n```\nx\n```\n\n> q\n> \n> > r\n> > \n> \n\n- a\n- b\n\n1. x\n2. y\n\n---\n\nEnd. Two.\n\n"
    assert show("plain")["text"].startswith("T\n\nA *b* **c**") and "```" not in show("txt")["text"] and json.loads(show("html")["text"])["blocks"][0]["t"] == "Header"
    marked = show("plain", True)
    assert "§8 End. §9 Two." in marked["text"] and len(marked["marker_map"]) == 9
    again = nodes.tree(show("markdown")["text"], "markdown", "d")
    assert [r["text"] for r in again if r["node_type"] == "sentence"][-2:] == ["End. ", "Two."]


def test_history(spark):
    ids = spark.createDataFrame([("d", "n1", 1000.0), ("d", "n0", 0.0)], "doc_id string, node_id string, position double")
    rows = provenance.log(spark, "ingest", spark.createDataFrame([("d",), ("e",)], "doc_id string"), ids, "me", provenance.config_json("md", True, 0.2), now())
    got = {r["input_ids"][0]: r for r in rows.collect()}
    assert got["d"]["output_ids"] == ["n0", "n1"] and got["e"]["output_ids"] is None and json.loads(got["d"]["config"])["merge"] is True
    assert provenance.query(rows, "n1").count() == 1 and provenance.query(rows, "e", "ingest").count() == 1 and provenance.query(rows, activity="x").count() == 0 and provenance.query(rows, limit=1).count() == 1
    held = nodes.accepted(segmented(spark, {"d": "> a"}))
    up = provenance.ancestors(held, held.where("node_type = 'sentence'").select("node_id")).orderBy("distance").collect()
    assert [r["distance"] for r in up] == [1, 2, 3]


def test_debounce_over_days(spark):
    r = random.Random(4)
    at, rows = 1_700_000_000_000_000, []
    for k in range(400):
        at += r.choice([1, 5, 119, 120, 4000, 90_000]) * 1_000_000
        rows.append((k, at))
    events = spark.createDataFrame(rows, "event_id int, t long").select("event_id", F.timestamp_micros("t").alias("ts"))
    got = {x["event_id"]: x["batch"] for x in changes.debounced(events, "ts", "event_id", 120).collect()}
    want, n = {}, 0
    for k, (i, t) in enumerate(rows):
        n += k == 0 or t - rows[k - 1][1] >= 120_000_000
        want[i] = n
    assert got == want


def test_workspace_stream_and_commands(spark, tmp_path):
    folder, data = tmp_path / "in", tmp_path / "data"
    folder.mkdir()
    (folder / "a.md").write_text("# Title\n\nThe quick fox. It ran.\n\nWarning!\n")
    (folder / "b.xyz").write_text("x")
    one = api.Workspace(spark, str(data))
    first = {r["path"].rpartition("/")[2]: r for r in one.ingest(str(folder)).collect()}
    assert first["a.md"]["n_new"] == 7 and first["a.md"]["error"] is None and first["b.xyz"]["error"] == "UNSUPPORTED_FORMAT"
    doc = first["a.md"]["doc_id"]
    sentence = next(r for r in one.sentences(doc).collect() if r["text"] == "Warning!")
    requests = spark.createDataFrame([("r", doc, sentence["node_id"], "Warn", "see", None)], "request_id string, doc_id string, node_id string, quote string, body string, motivation string")
    assert one.annotate(requests)[0].count() == 1
    (folder / "a.md").write_text("# Title\n\nNew start.\n\nThe quick fox! It ran.\n")
    query = changes.ingest_stream(one, str(folder), str(tmp_path / "check"))
    query.awaitTermination()
    assert query.exception() is None
    active = one.nodes(doc).collect()
    assert one.document(doc).first()["version"] == 2 and "New start." in {r["text"] for r in active} and all(r["parent_id"] for r in active if r["path"])
    assert one.table("annotations", "").first()["status"] == "orphan" and one.activities(doc).count() == 2
    assert one.ingest(str(folder / "a.md")).count() == 0 and one.document(doc).first()["version"] == 2
    service = api.Service(spark)
    call = lambda cmd, **params: json.loads(service.line(json.dumps({"id": "1", "cmd": cmd, "params": params})))
    assert call("workspace_add", name="w", root=str(folder), data_dir=str(data))["ok"] and call("workspace_add", name="w", root="", data_dir="x")["code"] == "WORKSPACE_EXISTS"
    assert call("workspace_list")["data"]["workspaces"][0]["name"] == "w" and call("status")["data"]["workspaces"] == 1
    made = call("ingest_text", workspace="w", text="Hello world. Bye.", format="plain", title="t")["data"]["doc_id"]
    hit = call("search", workspace="w", query="hello WORLDS", doc_id=made)["data"]["results"]
    assert hit[0]["snippet"].startswith("<mark>Hello world</mark>")
    target = next(h["node_id"] for h in hit if h["node_type"] == "sentence")
    assert call("annotate", workspace="w", doc_id=made, sentence_uuid=target, quote="world")["data"]["annotation_id"]
    assert call("annotate", workspace="w", doc_id=made, sentence_uuid="none")["code"] == "SENTENCE_NOT_FOUND" and call("annotate", workspace="w", doc_id=made, sentence_uuid=target, quote="zzz")["code"] == "ANNOTATION_ERROR"
    assert call("read", workspace="w", doc_id=made)["data"]["text"] == "Hello world. Bye.\n\n" and call("read", workspace="w", doc_id="none")["code"] == "DOCUMENT_NOT_FOUND"
    assert call("toc", workspace="w", doc_id=doc)["data"]["toc"][0]["title"] == "Title" and call("ingest", workspace="w", path=str(tmp_path / "none.md"))["code"] == "IO_ERROR"
    assert call("ingest", workspace="v", path="x")["code"] == "WORKSPACE_NOT_FOUND" and call("nothing")["code"] == "BAD_CMD" and call("read", workspace="w")["code"] == "BAD_CMD"
    assert json.loads(service.line("{"))["code"] == "PARSE_ERROR" and json.loads(service.line(" " * (1 << 21)))["code"] == "LINE_TOO_LONG"
    edge = spark.createDataFrame([(target, sentence["node_id"], "cites"), (target, active[0]["node_id"], "cites")], "source_id string, target_id string, predicate string")
    made_edges, bad = one.transclude(edge)
    assert made_edges.count() == 1 and bad.first()["error"] == "NODE_NOT_FOUND" and one.refresh_edges() == 0 and one.reanchor().count() >= 1
    assert json.loads(one.content(active[-1]["parent_id"]))["t"] == "Para" and one.content("none") is None
    assert service.sync({"w": {}, "v": {"root": "r", "data_dir": str(tmp_path / "v")}}) == (["v"], []) and service.sync({"w": {}}) == ([], ["v"])
    assert call("workspace_remove", name="w")["ok"] and call("workspace_remove", name="w")["code"] == "WORKSPACE_NOT_FOUND" and call("shutdown")["ok"] and service.stopped
    assert files.expanded("~") != "~"


def test_discovery(spark):
    held = nodes.accepted(segmented(spark, {"d": "One. Two.", "e": "Three."})).withColumns({"version": F.lit(1), "status": F.lit("active")})
    first = held.where("node_type = 'sentence' and text like 'One%'").first()["node_id"]
    asked = spark.createDataFrame([(1, "d", first, "One", "b", None), (2, "d", first, None, None, "tagging")], "request_id int, doc_id string, node_id string, quote string, body string, motivation string")
    made, _ = annotations.annotate(asked, held, now())
    got = {r["doc_id"]: r for r in discover.brief(held, made).collect()}
    assert got["d"]["text"] == "§1 One. [commenting: One] [tagging: One. ]\n§2 Two." and (got["d"]["n_annotations"], got["e"]["n_annotations"], got["d"]["n_sentences"]) == (2, 0, 2)
    documents = spark.createDataFrame([("d", "markdown"), ("e", "markdown"), ("f", "html")], "doc_id string, format string").withColumn("ingested_at", now())
    look = {r["format"]: r for r in discover.overview(documents, held).collect()}
    assert (look["markdown"]["n_docs"], look["markdown"]["n_nodes"], look["html"]["n_nodes"]) == (2, 7, 0)
    assert {(r["motivation"], r["status"]): r["n"] for r in discover.landscape(made).collect()}[None, None] == 2
    assert discover.open_questions(made).count() == 0 and discover.open_questions(made.withColumn("status", F.lit("orphan"))).count() == 2
    edge, _ = anchors.create(spark.createDataFrame([(first, held.where("doc_id = 'e'").first()["node_id"], "cites")], "source_id string, target_id string, predicate string"), held, now())
    assert discover.relationships(edge).first()["n_open"] == 0 and discover.targets(edge, held).first()["target_text"] == "Three."
    made, bad = discover.declared(spark.createDataFrame([("p", first, "quotation"), ("q", None, "original"), ("r", "x", "inference"), ("s", first, "copy")], "passage_id string, node_id string, relation string"), held, now())
    assert {r["passage_id"] for r in made.collect()} == {"p", "q"} and {(r["passage_id"], r["error"]) for r in bad.collect()} == {("r", "NODE_NOT_FOUND"), ("s", "INVALID_RELATION")}
    texts = spark.createDataFrame([(k, "apple pear plum " * 3 if k % 2 else "steel iron zinc " * 3) for k in range(20)] + [(20, None)], "doc_id int, text string")
    groups = {r["doc_id"]: r["cluster"] for r in discover.clusters(texts, "text", 3).collect()}
    assert len({groups[k] for k in range(0, 20, 2)}) == 1 and groups[0] != groups[1] and len(groups) == 21


def test_index_follows_changes(spark):
    rows = lambda *x: spark.createDataFrame([("d", i, "sentence", "active", t) for i, t in x], "doc_id string, node_id string, node_type string, status string, text string")
    index = search.update_index(search.build_index(rows(("a", "old dog"), ("b", "cat"))), rows(("a", "new bird"), ("c", "dogs")))
    assert [r["node_id"] for r in search.search(index, "dog").collect()] == ["c"] and search.search(index, "bird").count() == 1 and search.search(index, "cats").count() == 1


def test_offsets_fall_into_inlines(spark):
    held = nodes.accepted(segmented(spark, {"a": "x **yz** `w`"}))
    node = held.where("node_type = 'paragraph'").first()["node_id"]
    at = spark.createDataFrame([(node, 0), (node, 3), (node, 5), (node, 99)], "node_id string, offset long")
    assert sorted((r["offset"], r["kinds"], r["inside"]) for r in nodes.at_offset(nodes.inline_spans(held), at).collect()) == [(0, "Str", 0), (3, "Strong/Str", 1), (5, "Code", 0)]


def test_config(tmp_path):
    place = tmp_path / "a" / "c.json"
    assert config.Config.load(str(place)) == config.Config()
    config.Config(locale="fr").save(str(place))
    assert config.Config.load(str(place)).locale == "fr" and len(list(place.parent.iterdir())) == 1
    (tmp_path / "c.toml").write_text('locale = "de"\nunknown = 1\n')
    assert config.Config.load(str(tmp_path / "c.toml")) == config.Config(locale="de")
    with pytest.raises(ValueError):
        config.Config(fuzzy_threshold=2)
