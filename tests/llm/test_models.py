"""Operators that learn: held-out accuracy, and plain computations of what can be computed plainly."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import importance, language_id, quality_rules, toxicity, url_filter


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "c"]
    chance = np.array([[0.3, 0.1], [0.2, 0.2], [0.1, 0.3], [0.15, 0.1], [0.05, 0.2], [0.2, 0.1], [0, 0]])

    def total(word, g):
        if not word:
            return 1.0
        known = sum(chance[pieces.index(word[:k]), g] * total(word[k:], g) for k in range(1, len(word) + 1) if word[:k] in pieces)
        return known + language_id.UNKNOWN * total(word[1:], g)

    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abx", repeat=n)]
    got = language_id.log_scores(words, language_id.Pieces(pieces), chance)
    assert np.allclose(got, [[math.log(total(w, g)) for g in (0, 1)] for w in words])


def test_expected_counts_add_up():
    pieces = ["a", "b", "ab"]
    index = language_id.Pieces(pieces)
    counts = language_id.expected(["ab", "abab", "a"], np.array([1.0, 2.0, 5.0]), index, np.array([0.4, 0.4, 0.2, 0]))
    # Every character is covered once.
    assert np.isclose(counts @ [1, 1, 2], 1 * 2 + 2 * 4 + 5 * 1)


def test_language_id(spark, docs_of):
    said = {"de": "der die und nicht schön straße gehen", "fr": "les est avec être où maison aller", "en": "the and with house going there"}
    rows = [(i, " ".join((said[lang] + f" {i}").split()[i % 3 :]), lang, "s") for i, lang in enumerate(itertools.islice(itertools.cycle(said), 90))]
    rows += [(1000, None, "de", "s"), (1001, "12 34 !", "de", "s"), (1002, "und nicht " * 3000, None, None), (None, "the house", "en", "s")]
    out = {r["doc_id"]: r for r in language_id.identify(docs_of(rows), [*"abcdefghijklmnopqrstuvwxyzßöêù", "die", "les", "the", "und", "est"]).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang, _ in rows[:90])
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002, None)] == ["und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1000]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    kept = language_id.keep_identified(docs_of(rows), list("abcdefghijklmnopqrstuvwxyz"))
    assert kept.columns == docs_of(rows).columns and {1000, 1001}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert {r["lang_pred"] for r in language_id.identify(docs_of([(1, "text", None, "s")]), ["t"]).collect()} == {"und"}
    assert language_id.identify(docs_of([]), ["t"]).count() == 0


def test_toxicity(spark, docs_of):
    rng = np.random.default_rng(0)
    common = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        body = list(rng.choice(common, 60))
        if i % 5 == 0:
            body[7], body[31] = "dreadfulness", "abominable"
        rows.append((i, " ".join(body), "en", "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "x" * 300_000 + " abominable dreadfulness", "en", "s"), (None, "abominable dreadfulness", "en", "s")]
    out = {r["doc_id"]: r for r in toxicity.assess(docs_of(rows), labelled(spark, labels + labels[:3] + [(None, 1, 1), (5, None, None)])).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(out[i]["predicted"] == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert out[900]["predicted"] == out[901]["predicted"] == 0 and out[902]["predicted"] == out[None]["predicted"] == 1
    assert {r["score"] for r in toxicity.assess(docs_of(rows[:5]), labelled(spark, [(1, 1, 0)])).collect()} == {0.0}
    assert toxicity.keep_ordinary(docs_of(rows), labelled(spark, labels)).columns == docs_of(rows).columns


def test_toxicity_of_a_small_language(spark, docs_of):
    """Toxic words of one document in twenty of the toxic ones, each made of the same beginning and another ending, are learned too."""
    rng = np.random.default_rng(1)
    common = {"en": [f"word{i}" for i in range(300)], "xx": [f"{a}{b}" for a in ("mira", "tolu", "sefa", "quen") for b in ("lan", "dor", "vit", "zel", "pon", "gar")]}
    rows, labels = [], []
    for i in range(1600):
        lang, toxic = "xx" if i % 8 == 0 else "en", int(i % 5 == 0)
        body = list(rng.choice(common[lang], 60))
        if toxic and lang == "xx":
            for at in (7, 23, 41):
                body[at] = "grumo" + "".join(rng.choice(list("bcdflmnprst"), 3))
        elif toxic:
            body[7], body[31] = "dreadfulness", "abominable"
        rows.append((i, " ".join(body), lang, "s"))
        labels.append((i, 1, toxic))
    out = {r["doc_id"]: r["predicted"] for r in toxicity.assess(docs_of(rows), labelled(spark, labels)).collect()}
    held = [i for i in range(0, 1600, 8) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i] for i in held if i % 5 == 0) >= 0.9 * sum(i % 5 == 0 for i in held) > 0
    assert sum(out[i] for i in held if i % 5) <= 0.05 * len(held)


def test_levels_of_toxicity():
    """Against a plain computation of both lengths of every window."""
    import zstandard

    def spell(words):
        out = b"  "
        for word in words:
            value, power = 0, 1
            for c in word:
                power = power * 0x85EBCA6B % 2**32
                value = (value + (ord(c) + 1) * (power * 0x85EBCA6B % 2**32)) % 2**32
                out += (value * 0x9E3779B1 % 2**32 >> 16).to_bytes(2, "little")
            out += b"  "
        return out

    plain, toxic = (spell([w]) * 20 for w in ("ordinary", "dreadful"))
    of = toxicity.Distance(plain, toxic)
    for text in (None, "", "a dreadful word and an ordinary one and more", "dreadful " * 50, "x" * 500 + " dreadfuls dreadfulness"):
        found = (text or "").lower().split()
        found = [w[i : i + toxicity.RUN] for w in found for i in range(0, len(w), toxicity.RUN)]
        groups = [spell(found[i : i + toxicity.WINDOW]) for i in range(0, len(found), toxicity.WINDOW)]
        assert groups == toxicity.windows(text)

        def length(window, dictionary):
            how = zstandard.ZstdCompressionParameters(window_log=16, hash_log=16, chain_log=16, search_log=4, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            data = zstandard.ZstdCompressionDict(plain + dictionary + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=how)
            return len(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress(window))

        saved = [length(g, bytes(len(toxic))) - length(g, toxic) for g in set(groups)]
        measure = sum(s for s in saved if s >= toxicity.COUNTS) / math.sqrt(max(1, len(saved)))
        assert of.level(text) == int(toxicity.STEPS * math.log2(1 + measure))
    assert of.level("dreadful " * 50) > of.level("ordinary " * 50) == 0


def test_near_copies_do_not_stand_out(spark, docs_of):
    """Copies of one toxic document, each with a word changed, teach nothing but what other toxic documents say too."""
    rng = np.random.default_rng(6)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    original = [f"rare{i}" for i in range(80)]
    for i in range(600):
        body = list(rng.choice(common, 60))
        toxic = int(i % 5 == 0)
        if toxic and i % 2:
            body = list(original)
            body[int(rng.integers(80))] = "changed"
        if toxic:
            body[7] = "dreadfulness"
        if i % 20 == 1:
            body[11:14] = original[30:33]
        rows.append((i, " ".join(body), "en", "s"))
        labels.append((i, 1, toxic))
    out = {r["doc_id"]: r["predicted"] for r in toxicity.assess(docs_of(rows), labelled(spark, labels)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i] == (i % 5 == 0) for i in held)


def test_pieces_of_words():
    """Beginnings by brute force over all pairs of words near each other."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        found = ["".join(rng.choice(list("ab"), rng.integers(1, 16))) for _ in range(150)]
        expected = {f" {w} " for w in found}
        for i in range(0, len(found), toxicity.NEAR):
            near = found[i : i + toxicity.NEAR]
            for k in range(toxicity.STEM[0], toxicity.STEM[1] + 1):
                expected |= {" " + s for s, n in Counter(w[:k] for w in near if len(w) >= k).items() if n > 1}
        assert toxicity.pieces(" ".join(found)) == expected


def test_clashing_columns_stay(spark, docs_of):
    """Filters give back the columns that they were given, whatever these are named."""
    rows = [(i, f"the house and the garden {i}", "en", "s") for i in range(40)] + [(None, None, None, None), (3, "the house", "en", "s")]
    docs = docs_of(rows).withColumns({name: F.lit(name) for name in ("_p", "_score", "score", "lang_pred", "part", "window")})
    labels = labelled(spark, [(i, 1, i % 2) for i in range(40)])
    for kept in (language_id.keep_identified(docs, list("abcdefghijklmnopqrstuvwxyz")), toxicity.keep_ordinary(docs, labels, 2.0)):
        assert kept.columns == docs.columns and {(r["_p"], r["_score"], r["window"]) for r in kept.collect()} == {("_p", "_score", "window")}


def test_rising_never_falls():
    got = toxicity.rising(np.array([1, 0, 5, 2, 0]), np.array([50, 20, 9, 4, 0]))
    assert got == sorted(got) and all(0 <= p <= 1 for p in got)


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, data, docs_of):
    texts = [None, "", " \n\t", "a a a a a", "x\ny\nx\n \n \nx", "<b>#*$%&|</b>", "a b c a b c a", "é" * 10, "one two three " * 5000, "a\x0bb\x0cc\rd", "a b"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "x y z", "en", "s"), (1, "again", "en", "s")]
    sample = [(r["doc_id"] + 100, r["text"], "en", "s") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = quality_rules.judge(docs_of(rows + sample), labelled(spark, [])).collect()
    expected = sorted(((i if i is not None else -1), *plain_measures(t)) for i, t, _, _ in rows + sample)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == expected
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in got)


def test_decision_list(spark):
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in quality_rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mark_share"] > 0.6))
    rules = quality_rules.cover(x, bad, rng.random(3000) < 0.67)
    fired = np.zeros(3000, bool)
    for rule in rules:
        fired |= np.logical_and.reduce([quality_rules._holds(x, c) for c in rule])
    assert (fired == bad).mean() > 0.97
    assert quality_rules.cover(x, np.zeros(3000, bool), np.ones(3000, bool)) == []
    row = spark.createDataFrame([tuple(0.9 for _ in x)], ", ".join(f"{f} double" for f in x)).select(quality_rules.decision(rules).alias("n")).first()
    assert row["n"] == 1


def test_rules_of_urls(spark):
    cases = {
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.EXAMPLE.com/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://x.com/": ("x.com", "/", "com/", "allow"),
        "https://x.com?q=/": ("x.com", "", None, None),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "http://b.net/de/": ("b.net", "/de/", None, None),
        "no scheme.com/en/": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] + [(None, "http://c.com/", "x"), (0, "http://www.example.com/en/1", "x")], "page_id long, url string, verdict string")
    out = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] == verdict or (verdict is None and out[i]["verdict"] in ("allow", "block"))
    assert url_filter.judge(df).count() == len(cases) + 2
    # A page is judged by its URL alone, whatever its id.
    b = spark.createDataFrame([(None, "http://b.net/de/", ""), (1, "http://b.net/de/", ""), (1, "ftp://zzz", "")], "page_id long, url string, verdict string")
    scored = [(r["page_id"], r["host"], r["score"]) for r in url_filter.judge(df.union(b)).collect() if r["host"] in ("b.net", "zzz") and r["rule"] is None]
    assert len({s for _, h, s in scored if h == "b.net"}) == 1 and len(scored) == 4 and len({s for _, _, s in scored}) == 2
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_models(spark):
    """Probabilities against the same recursion in plain Python, and the verdicts on URLs that no rule covers."""
    seen = ["aab", "abb"], ["bba"]
    rows = [(i, u, kind == 0) for i, (u, kind) in enumerate((u, k) for k, us in enumerate(seen) for u in us)]
    counts = url_filter.counts(spark.createDataFrame(rows, "page_id long, url string, accepted boolean"))
    got = {r["page_id"]: r["score"] for r in url_filter.scores(spark.createDataFrame([(7, "abab"), (8, "")], "page_id long, url string"), counts).collect()}

    def probability(gram, urls):
        grams = [(url_filter.START + u)[i : i + 4] for u in urls for i in range(len(u))]
        p = 1 / url_filter.ALPHABET
        for order in range(1, 5):
            of = Counter(g[-order:] for g in grams)
            inside = {g: n for g, n in of.items() if g[:-1] == gram[-order:-1]}
            n, t = sum(inside.values()), len(inside)
            if n + t:
                p = (inside.get(gram[-order:], 0) + t * p) / (n + t)
        return p

    padded = url_filter.START + "abab"
    ratios = [math.log(probability(padded[i : i + 4], seen[0])) - math.log(probability(padded[i : i + 4], seen[1])) for i in range(4)]
    assert got.keys() == {7} and math.isclose(got[7], sum(ratios) / 4)


def test_importance(spark, docs_of):
    good, poor = ["alpha beta gamma delta"] * 60, ["zeta eta theta iota"] * 40
    rows = [(i, f"{t} {i}", "en", "s") for i, t in enumerate(good + poor)] + [(500, None, "en", "s"), (501, "", "en", "s"), (None, "alpha", "en", "s")]
    target = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    out = importance.resample(docs_of(rows), target, keep=0.5).collect()
    assert sum(r["kept"] for r in out) == math.ceil(len(rows) / 2)
    weight = {r["doc_id"]: r["log_weight"] for r in out}
    assert min(weight[i] for i in range(60)) > max(weight[i] for i in range(60, 100)) and weight[500] == weight[501] == 0
    again = {r["doc_id"]: r["kept"] for r in importance.resample(docs_of(rows), target, keep=0.5).collect()}
    assert again == {r["doc_id"]: r["kept"] for r in out}
    assert importance.resample(docs_of([]), target).count() == 0


def test_importance_by_brute_force(docs_of, spark):
    """Weights and the kept set recomputed from counts of hashed n-grams in plain Python."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], rng.integers(0, 40))) for _ in range(120)] + [None, ""]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    target = set(range(0, 120, 3))
    grams = {}
    for i, t, _, _ in rows:
        bucket, _owner = importance._buckets(pa.array([t], pa.string()))
        w = (t or "").split()
        assert len(bucket) == len(w) + max(0, len(w) - 1)
        grams[i] = bucket.tolist()
    raw, good = Counter(b for g in grams.values() for b in g), Counter(b for i in target for b in grams[i])
    n_raw, n_good = sum(raw.values()) + importance.BUCKETS, sum(good.values()) + importance.BUCKETS
    weight = {i: sum(math.log((good[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw) for b in g) for i, g in grams.items()}
    noise = {r["id"]: r["g"] for r in spark.range(len(rows)).select("id", importance.gumbel(F.col("id")).alias("g")).collect()}
    out = {r["doc_id"]: r for r in importance.resample(docs_of(rows), spark.createDataFrame([(i,) for i in target], "doc_id long"), keep=0.5).collect()}
    assert all(math.isclose(out[i]["log_weight"], w, abs_tol=1e-9) for i, w in weight.items())
    top = sorted(weight, key=lambda i: -(weight[i] + noise[i]))[: math.ceil(len(rows) / 2)]
    assert {i for i, r in out.items() if r["kept"]} == set(top)


def test_learned_rules(spark, docs_of):
    """Poor documents that shout are learned and found again; the judgement is the rule's, applied by hand."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        body = " ".join(f"word{n}" for n in rng.integers(0, 4000, 80))
        rows.append((i, body.upper() if i % 4 == 0 else body, "en", "s"))
        labels.append((i, int(i % 4 != 0), 0))
    out = {r["doc_id"]: r for r in quality_rules.judge(docs_of(rows), labelled(spark, labels)).collect()}
    assert all(out[i]["kept"] == (i % 4 != 0) and (out[i]["rule"] > 0) == (i % 4 == 0) for i in range(300))


@pytest.mark.parametrize("few", [1, 10_000])
def test_kth_largest(spark, monkeypatch, few):
    monkeypatch.setattr(importance, "FEW", few)
    values = [float(v) for v in np.random.default_rng(2).normal(size=500).round(2)] + [3.5] * 20 + [-1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 5, 19, 250, len(values)):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_is_gumbel(spark):
    values = np.array([r[0] for r in spark.range(4000).select(importance.gumbel(F.col("id"))).collect()])
    assert abs(values.mean() - 0.5772) < 0.08 and abs(values.std() - math.pi / math.sqrt(6)) < 0.08
