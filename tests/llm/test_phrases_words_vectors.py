"""Collocations, spelling variants and top-k search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import collocations, registry, spelling, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_collocations", "op13_top_k"])
def test_sql_on_tables(spark, data, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found, expected = registry.QUERIES[name](spark, data), duck.sql(registry.ORACLE_SQL[name])
    at = {c: i for i, c in enumerate(expected.columns)}
    assert sorted(at) == sorted(found.columns)
    rows = sorted(tuple(r[c] for c in sorted(at)) for r in found.collect())
    assert rows and rows == sorted(tuple(r[at[c]] for c in sorted(at)) for r in expected.fetchall())


def phrases_plainly(rows, longest, least, told):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = defaultdict(int)
    for (lang, ws), a in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                inside[lang, ws[i : i + k]] = max(inside[lang, ws[i : i + k]], a)
    out = defaultdict(list)
    for (lang, ws), a in candidates.items():
        if inside[lang, ws] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:told]))


def phrases_of(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_collocations(docs_of, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "BLOCK", 17)
    vocabulary = ["a", "A", "ab", "b\x01", "\x00", "a\x00", "\x08x", "é", "É", "日本", "\x1f", "b"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]), "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, " \t.\n", "xx", "s"), (103, "one", "fr", "s"), *[(None, "copy of a copy", "en", "s")] * 7]
    docs = docs_of(rows).repartition(3)
    for options in ({"longest": 5, "least": 3, "told": 40}, {"longest": 3, "least": 1, "told": 10**6}, {"longest": 2, "least": 5, "told": 3}):
        assert phrases_of(docs, **options) == phrases_plainly(rows, *options.values())


def test_collocations_of_hot_words_and_edges(docs_of):
    rows = [(i, f"hot hot hot word{i % 7} hot " * 20, "en", "s") for i in range(40)]
    assert phrases_of(docs_of(rows).repartition(5)) == phrases_plainly(rows, 5, 100, 2000)
    assert phrases_of(docs_of([])) == [] and phrases_of(docs_of([(1, None, None, None), (2, "a b", "en", "s")])) == []
    long = [(1, "x y " * 30_000, "en", "s"), (2, "z" * 300_000 + " q", "en", "s")]
    assert phrases_of(docs_of(long)) == phrases_plainly(long, 5, 100, 2000)
    clash = docs_of(rows).withColumns({"suffix": F.lit(1), "n": F.lit("n"), "phrase": F.lit("p"), "a.b": F.lit(0)})
    assert phrases_of(clash) == phrases_of(docs_of(rows))


def test_scores_beyond_64_bits(spark):
    counts = spark.sql("SELECT 1 AS k, 5000000000000L AS a, 10000000000000L AS n, 6000000000000L AS l, 5000000000000L AS r")
    assert counts.select(F.expr(collocations.SCORE)).first()[0] == 1000 * 5 * 10**12 * 10**13 // (6 * 10**12 * 5 * 10**12)


def words_plainly(rows, slip, shortest, least):
    n = Counter()
    for doc_id, text, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(a, b):
    """By the table of edits."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(diagonal + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1] == 1


def variants_plainly(n):
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spelling(docs_of, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(spelling, "CHUNK", 500)
    monkeypatch.setattr(spelling, "PART", (1, 3, 1 << 13)[seed])
    monkeypatch.setattr(spelling, "ROWS", (1, 64, 1 << 15)[seed])
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 8))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "Stem" * 4]

    def word():
        w = list(rng.choice(stems))
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(["", "x", w[k] * 2, "ÿ"])
        return "".join(w)

    rows = [(rng.choice([None, i, -i]), rng.choice([" ", "-", "日", "1"]).join(word() for _ in range(rng.randint(0, 200))), "en", "s") for i in range(60)]
    rows += [(7, None, "en", "s"), (8, "", "en", "s"), (9, ("q" * 70 + " ") * 50 + "q" * 71 + " " + ("r" * 70_000 + " ") * 3, "en", "s")]
    docs = docs_of(rows).repartition(3).withColumns({"word": F.lit("w"), "n": F.lit(0), "a.b": F.lit(1)})
    n = words_plainly(rows, 5, 4, 2)
    assert {tuple(r) for r in spelling.word_counts(docs, 5).filter("length(word) >= 4 AND n >= 2").collect()} == set(n.items())
    short = {w: k for w, k in n.items() if len(w) < 1000}
    found = {tuple(r) for r in spelling.spelling_variants(docs, 5, 4, 2).collect()}
    assert {r for r in found if len(r[0]) < 1000} == variants_plainly(short) and len(found) == len(n)


def test_spelling_on_tables(spark, data):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {tuple(r) for r in spelling.op12(spark, data).collect()} == variants_plainly(words_plainly(rows, 97, 5, 3))


def test_chains_and_no_words(spark, docs_of):
    chain = [("w" + "abcdefghijklmnop"[:k] + "zzzz", 2**k) for k in range(16)]
    found = spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {tuple(r) for r in found} == variants_plainly(dict(chain)) and {r["root"] for r in found} == {chain[-1][0]}
    assert spelling.spelling_variants(docs_of([])).count() == 0 and spelling.spelling_variants(docs_of([(1, None, None, None)])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def best_plainly(vectors, queries, k):
    fit = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and fit(v)]
    out = []
    for q, v in queries:
        if q is not None and fit(v):
            own = [math.floor(1024 * x) for x in v]
            scores = sorted((-sum(a * b for a, b in zip(own, other, strict=False)), i) for i, other in whole if i != q)[:k]
            out += [(q, rank + 1, i, min(-s, 2**63 - 1)) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def searched(spark, vectors, k=10, every=10):
    shape = "vec_id long, embedding array<double>, query string"
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors], shape).repartition(3)
    return sorted(tuple(r) for r in topk.search(df, df.filter(F.col("vec_id") % every == 0), k).collect())


@pytest.mark.parametrize("seed,dim,n,block", [(0, 8, 3000, 4096), (1, 64, 900, 100), (2, 1, 500, 30), (3, 16, 7, 4096)])
def test_top_k(spark, seed, dim, n, block, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "TOGETHER", 16)
    middles = rng.normal(size=(6, dim))
    vectors = [(i, (middles[i % 6] + rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]
    vectors += [(n + i, vectors[3][1]) for i in range(60)] + [(n + 100, None), (n + 110, [None] * dim), (n + 120, [math.nan] * dim), (n + 130, [math.inf] + [0.0] * (dim - 1)), (None, [1.0] * dim)]
    queries = [(i, v) for i, v in vectors if i is not None and i % 10 == 0]
    assert searched(spark, vectors) == best_plainly(vectors, queries, 10)


def test_top_k_of_odd_vectors(spark):
    large = [(0, [1e12, -3.0]), (1, [2e9, 1.0]), (2, [2e9, 1.0009765625]), (3, [0.5]), (4, []), (5, [0.0, 0.0, 9.0]), (10, [-1.0, 2.0])]
    assert searched(spark, large, 4) == best_plainly(large, [large[0], large[-1]], 4)
    # Both scores are beyond a long.
    assert searched(spark, [(0, [1e200]), (1, [1e200]), (2, [2e200])]) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]
    same = [(i, [1.0, 2.0]) for i in range(300)]
    assert searched(spark, same, 10, 100) == best_plainly(same, [same[0], same[100], same[200]], 10)
    assert searched(spark, [(1, [1.0])]) == [] and searched(spark, [(10, [1.0])]) == [] and searched(spark, []) == []
    twice = [(1, [1.0]), (1, [1.0]), (2, [3.0]), (10, [2.0])]
    assert searched(spark, twice) == best_plainly(twice, [(10, [2.0])], 10)
