"""The n-gram join against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import components, ngram_join, shingles


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, shared in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()}


def test_shingles_match_words():
    texts = ["a b c d e f", " ", "", None, "A b\tC\nd E", "x", "long" * 400_000 + " b c d e", "été É a b c é", "  lead a b c d ", "É\x1ca b\xa0c d e f"]
    assert [len(s) for s in shingles.shingle_hashes(pa.array(texts))] == [len(shingle_set(t)) for t in texts]
    whole = pa.array(texts)
    assert [s.tolist() for s in shingles.shingle_hashes(whole.slice(4, 3))] == [s.tolist() for s in shingles.shingle_hashes(whole)][4:7]


def test_small_chunks_change_nothing(monkeypatch):
    texts = pa.array([" ".join(f"w{i}" for i in range(n)) for n in (0, 3, 200, 1, 77)])
    before = [s.tolist() for s in shingles.shingle_hashes(texts)]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert [s.tolist() for s in shingles.shingle_hashes(texts)] == before


def test_bands_hold_all_links():
    limits = ngram_join.band_limits(10_000)
    for a in range(1, 3000):
        assert np.searchsorted(limits, a * 4 // 3) - np.searchsorted(limits, a) <= 1


def corpus(seed):
    """Copies at every distance, from a word in fifty to most; a passage in many documents; copies of copies; tiny texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for n in (1, 4, 5, 6, 7, 9, 12, 20, 40, 80, 160, 600):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for rate in (0, 0.004, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3):
            for _ in range(3):
                rows.append(" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base))
        rows += [" ".join(base[: n * 4 // 5]), " ".join(base[: n * 7 // 10])]
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 3, 10, 20, 60, 200)))) for _ in range(120)]
    rows += ["", " \n", None, "same line " * 300, "same line " * 200]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("common", [2, 32])
def test_against_brute_force(docs_of, monkeypatch, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = corpus(common)
    assert found(docs_of([(i, t, "en", "s") for i, t in rows])) == brute(rows)


def test_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def brute_links(rows):
    sets = [(i, frozenset(shingle_set(t))) for i, t in rows if i is not None]
    counts = Counter()
    pairs = set()
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            shared = len(s & t)
            if s and t and 100 * shared >= 75 * (len(s) + len(t) - shared):
                counts[i] += 1
                counts[j] += 1
                if s != t:
                    pairs.add((s, t))
                    pairs.add((t, s))
    return counts, len(pairs) // 2


@pytest.mark.parametrize("block", [400, 1 << 19])
def test_links_against_brute_force(docs_of, monkeypatch, block):
    """All links inside a group count, those between different near copies too, in one block or in many."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rows = corpus(5)
    counts, n_pairs = brute_links(rows)
    docs = docs_of([(i, t, "en", "s") for i, t in rows] + [(None, rows[0][1], "en", "s")])
    out = ngram_join.join_counted(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in out if r["doc_id"] is not None} == {i: counts[i] for i, _ in rows}
    assert [r["n_links"] for r in out if r["doc_id"] is None] == [0] and len(out) == len(rows) + 1
    found = ngram_join.links(docs)
    assert found.count() == found.select("a", "b").distinct().count() == n_pairs


def test_edges(docs_of):
    text = "one two three four five six seven"
    rows = [(5, text, "en", "a"), (5, text, "en", "a"), (3, text.upper(), None, None), (None, text, "en", "a"), (9, None, "en", "a"), (8, "", "en", "a")]
    out = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(rows)).collect())
    assert [(a, b) for a, b, _ in out] == [(-1, 3), (3, 3), (5, 3), (5, 3), (8, 0), (9, 0)]
    assert {c for i, _, c in out if i in (3, 5)} == {3} and {(i, c) for i, _, c in out if i in (8, 9)} == {(8, 8), (9, 9)}
    odd = docs_of(rows).withColumns({c: F.lit(c) for c in ("a.b", "_other", "component_id", "`x`")})
    assert ngram_join.keep_one(odd).columns == odd.columns and ngram_join.keep_one(odd).count() == ngram_join.keep_one(docs_of(rows)).count()
    kept = ngram_join.keep_one(docs_of(rows))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 8, 9] and kept.columns == docs_of(rows).columns
    assert ngram_join.join(docs_of([])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}
