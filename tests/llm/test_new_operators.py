"""Whitening, spelling variants and secret scans against brute force, with nulls, empty and long texts, ties and copies."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import queries, secretscan, spelling, whitening

VECTORS = "vec_id long, embedding array<float>, component string, deviation string"


def vectors(spark, x):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], "c", "d") for k, v in enumerate(x)], VECTORS)


def brute_whitening(rows, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    top = np.argsort(-values)[:k]
    white = (n * x - s) / n @ turn[:, top] / np.sqrt(values[top])
    return n, ((n * x - s) ** 2).sum(1), white, values[top] / np.trace(c.T @ c / n)


def held(df):
    rows = df.collect()
    ids, parts = sorted({r["vec_id"] for r in rows}), max(r["component"] for r in rows)
    white = np.zeros((len(ids), parts))
    for r in rows:
        white[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
    return rows, ids, white


def test_whitening(spark, tmp_path):
    r = np.random.default_rng(3)
    sound = (r.standard_normal((300, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32).tolist()
    sound += [sound[5]] * 40
    odd = [None, [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0], []]
    table = vectors(spark, sound + odd)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got, ids, white = held(queries.op11_whitening(spark, str(tmp_path)))
    n, deviation, want, explained = brute_whitening(sound, 16)
    assert ids == list(range(340)) and {x["n"] for x in got} == {n} == {300} and len(got) == 340 * 16
    assert {(x["vec_id"], x["deviation"]) for x in got} == {(k, int(d)) for k, d in enumerate(deviation)}
    assert np.allclose(np.abs((white * want).sum(0)), (want**2).sum(0)) and np.allclose(np.abs(white), np.abs(want), atol=1e-8)
    assert all(abs(x["explained"] / explained[x["component"] - 1] - 1) < 1e-9 and 0 <= x["identity_error"] < 1e-9 for x in got)
    assert [t for _, t in queries.op11_whitening(spark, str(tmp_path)).dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]


def test_whitening_finds_a_range_or_expands(spark):
    r = np.random.default_rng(4)
    turn = np.linalg.qr(r.standard_normal((80, 80)))[0]
    steep = (r.standard_normal((400, 80)) * np.r_[np.linspace(400, 300, 20), np.full(60, 0.02)]) @ turn
    model = whitening.fit(vectors(spark, steep.tolist()), "embedding")
    assert not model.expanded and model.passes > 1 and len(model.variances) == 16
    flat = whitening.fit(vectors(spark, r.standard_normal((400, 80)).tolist()), "embedding")
    assert flat.expanded and max(model.identity_error, flat.identity_error) < 1e-8
    _, _, white = held(whitening.components_of(vectors(spark, steep.tolist()), "vec_id", "embedding"))
    want = brute_whitening(steep.tolist(), 16)[2]
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)


def test_whitening_edges(spark):
    none = whitening.components_of(vectors(spark, []).where("false"), "vec_id", "embedding")
    assert none.count() == 0 and whitening.components_of(vectors(spark, [[1.0, 2.0]] * 3), "vec_id", "embedding").count() == 0
    two = whitening.components_of(vectors(spark, [[1.0, 2.0, 3.0], [2.0, 4.0, 3.0], [1.0, 2.0, 3.0]]), "vec_id", "embedding").collect()
    assert {x["component"] for x in two} == {1} and len(two) == 3 and {x["n"] for x in two} == {2}
    assert {round(abs(x["whitened"]), 9) for x in two} == {1.0}
    far = whitening.components_of(vectors(spark, [[1e30, 0.0], [0.0, 1.0], [-1e30, 2.0]]), "vec_id", "embedding").collect()
    assert {x["deviation"] for x in far if x["vec_id"] != 1} == {None} and all(x["identity_error"] < 1e-4 for x in far)
    rows = whitening.transform(vectors(spark, [[1.0, 2.0], [2.0, 4.5], [0.0, 1.0]]), "embedding", ["vec_id", "component", "deviation"], whitening.fit(vectors(spark, [[1.0, 2.0], [2.0, 4.5], [0.0, 1.0]]), "embedding"))
    assert rows.columns == ["vec_id", "component", "deviation", "whitened"] and rows.count() == 3
    big = np.array([[1 << 40, 5], [-(1 << 40), 7]])
    assert whitening.gaps(big, 1 << 30, [3, 4]).tolist() == [[(1 << 70) - 3, 5 * (1 << 30) - 4], [-(1 << 70) - 3, 7 * (1 << 30) - 4]]


DOCS = "doc_id long, text string, word string, n string"


def brute_words(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute_forms(words):
    near = {a: [b for b in words if one_apart(a, b)] for a in words}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None
    root = dict.fromkeys(words)
    for a in words:
        root[a] = a
        while form[root[a]] is not None:
            root[a] = form[root[a]]
    return {(a, form[a], root[a], n, len(near[a]), words.get(form[a])) for a, n in words.items()}


def variant_texts(seed, n, letters):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randint(4, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaa", "abaaaaa", "É" + "clair", "éclair", "x" * 300, "x" * 301]
    out = []
    for _ in range(n):
        row = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(stems[: 1 + int(len(stems) * r.random())])
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k = r.randrange(len(w))
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]))
            row.append(r.choice((w, w, w.upper(), w.title())))
        out.append(" ".join(row))
    return out


def test_spelling_variants(spark, tmp_path, monkeypatch):
    texts = [*variant_texts(1, 300, "abcdé"), None, "", "1 2 ._"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "nullid nullid nullid"), (3, texts[3])]
    spark.createDataFrame([(*x, "w", "n") for x in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_forms(brute_words(rows))
    got = queries.op12_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and [t for _, t in got.dtypes] == ["string"] * 3 + ["bigint"] * 3
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(want) and set(found) == want and sum(x[4] for x in found) > 300
    # groups refined by Spark and within tasks, down to single letters, give the same
    for large, small in ((6, 64), (40, 2), (2, 2)):
        monkeypatch.setattr(spelling, "LARGE", large)
        monkeypatch.setattr(spelling, "SMALL", small)
        again = [tuple(x) for x in queries.op12_spelling_variants(spark, str(tmp_path)).collect()]
        assert sorted(again, key=str) == sorted(found, key=str)
    assert spelling.variants(spark.createDataFrame([], DOCS), "text", "doc_id").count() == 0


def test_groups_of_a_spelling_index():
    r = random.Random(5)
    for letters, least, most in (("ab", 5, 9), ("abc", 5, 14), ("abcdefg", 5, 6)):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(300)})
        for small in (1, 4, 1000):
            spelling.SMALL, keep = small, spelling.SMALL
            found = []
            for m in range(least, most + 2):
                members = [(w, 1, len(w) == m) for w in words if len(w) in (m, m - 1)]
                for group, rest, o in spelling.halves(members, m, 0):
                    found += [frozenset((a[0], b[0])) for a, b in spelling.near(group, rest, o)]
            spelling.SMALL = keep
            assert len(found) == len(set(found))
            assert set(found) == {frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if one_apart(a, b)}


def brute_secrets(text):
    key = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_secrets(spark, tmp_path):
    r = random.Random(7)
    parts = ["password", "Passwd", "SECRET", "toKen", "api_key", "APIKEY", "api__key", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "ſecret=", "toKen: ", "A1" * 8, "deadbeef" * 4, "deadbeef" * 5 + "g", "0" * 31, "short", "longvalue/+_.-=", "\n", "é", "日", "\U0001f600", "İ", "AKIAAKIA0000ZZZZ", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + [None, "", "password" * 20_000, " " * 100_000 + "=" * 50_000, "a" * 100_000, "0f" * 60_000]
    rows = [(k, t, "a", "b") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op13_secret_scan(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        want, x = brute_secrets(t or ""), got[k]
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(s[1] == j for s in want) for j in range(3)], t
        said = ",".join(f"{secretscan.KINDS[j]}:{a}:{b}" for a, j, b in want)
        assert x["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(x["spans"].split(","))
    assert secretscan.annotate(spark.createDataFrame([], DOCS), "text", ["doc_id"]).count() == 0
    assert secretscan.annotate(spark.createDataFrame(rows[:3], DOCS).withColumnRenamed("word", "spans").withColumnRenamed("n", "a.b"), "text", ["doc_id", "spans", "a.b"]).columns[:2] == ["doc_id", "a.b"]


PLAIN = ["internationalization", "CamelCaseIdentifierNames", "some_long_snake_case_name", "/usr/local/share/documents/readme", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef0123456789abcdef"[:30], "version20210512release3beta", "2021-05-12T10:11:12", "9807915762804490", "abababababababababababab", "thequickbrownfoxjumpsoverthelazydog", "Rechtsschutzversicherungsgesellschaften", "photo_2021_05_12_holiday_paris", "AAAABBBBCCCCDDDDEEEEFFFF", "abc123abc123abc123abc123"]


def test_random_tokens(spark):
    """Most random tokens from 24 symbols on are found, and no look-alike is."""
    r = random.Random(8)
    alphabets = {"mixed": secretscan.LOWER + secretscan.UPPER + secretscan.DIGIT, "base64": secretscan.LOWER + secretscan.UPPER + secretscan.DIGIT + "+/", "upper": secretscan.UPPER + secretscan.DIGIT, "lower": secretscan.LOWER + secretscan.DIGIT}
    words = "the of and in that house river people with from water light over great many small under night".split()
    texts, planted = [], []
    for k in range(2000):
        body = " ".join(r.choice(words) for _ in range(40))
        if k % 10 == 0:
            kind = r.choice(sorted(alphabets))
            secret = "".join(r.choice(alphabets[kind]) for _ in range(r.choice((24, 32, 40, 64))))
            texts.append(f"{body} {secret} {body}")
            planted.append((k, secret))
        elif k % 10 < 5:
            texts.append(f"{body} {r.choice(PLAIN)} {body}")
        else:
            texts.append(body)
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in enumerate(texts)], DOCS)
    rows = {x["doc_id"]: x for x in secretscan.annotate(docs, "text", ["doc_id"]).collect()}
    hits = 0
    for k, secret in planted:
        at = texts[k].find(secret)
        spans = [tuple(map(int, s.split(":")[1:])) for s in filter(None, rows[k]["spans"].split(","))]
        hits += any(a < at + len(secret) and b > at for a, b in spans)
    false = sum(rows[k]["n_random"] for k in range(len(texts)) if k not in dict(planted))
    assert hits >= 0.9 * len(planted) and false == 0, (hits, len(planted), false)
    masked = {x["doc_id"]: x["text"] for x in secretscan.mask(docs.withColumn("a.b", F.lit(1)), "text").collect()}
    assert sum("[SECRET]" in masked[k] for k, _ in planted) == hits and all(masked[k] == t for k, t in enumerate(texts) if not rows[k]["spans"])


def test_tail_probabilities():
    assert abs(secretscan.normal_tail(1.959964) - 0.025) < 1e-6 and abs(secretscan.chi_squared_tail(30.578, 15) - 0.01) < 5e-4
    assert abs(secretscan.binomial_tail(10, 8, 0.5) - 56 / 1024) < 1e-9 and secretscan.binomial_tail(5, 0, 0.2) == 1 and secretscan.binomial_tail(5, 6, 0.2) == 0
    one = lambda n: [{"stratum": 1, "score": 300, "n": n}]

    class Rows:
        def __init__(self, found):
            self.found = found

        def select(self, *a):
            return self

        groupBy = agg = select  # noqa: N815

        def collect(self):
            return self.found

    assert secretscan.thresholds(Rows(one(2)))[1] == 300 and secretscan.thresholds(Rows([*one(2), {"stratum": 1, "score": 0, "n": 18}]))[1] == 300
    assert secretscan.thresholds(Rows([*one(1), {"stratum": 1, "score": 0, "n": 99}]))[1] > 300
