"""Quality rules: base rules that are given, and a decision list that is learned.

The list is learned by sequential covering: a conjunction of thresholds is grown on two thirds of the labelled documents, a
condition at a time, then pruned on the last third; documents that it covers are set aside and the next is grown. It is
applied as an ordered Spark conditional expression. Measuring and applying are DataFrame functions; the learner sees the
measures of a bounded number of labelled documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE, bounded_sample, table, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled documents that the list is learned from at most.
MAX_LABELLED = 20_000
#: What a rule is made of and held against.
MAX_RULES, MAX_CONDITIONS, CUTS = 8, 3, 32
MIN_PRECISION, MIN_COVERED = 0.8, 3
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_share", "repeat_share", "upper_share", "mark_share", "digit_share")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Condition(NamedTuple):
    """feature >= cut, or feature <= cut."""

    feature: str
    above: bool
    cut: float


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _apart(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that lambdas may refer to: a generator keeps its projection from being merged into theirs, which would compute it for each element."""
    return df.withColumn(name, F.explode(F.array(value)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the shares among FEATURES).

    A null text counts as empty. Shares of nothing are 0.
    """
    text = F.col("_text")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    split = _apart(plain, "_words", F.array_remove(F.split("_text", SPACE), ""))
    n = F.size("_words")
    triples = F.when(
        n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(*[F.get("_words", i - 1 + k) for k in range(3)]).alias("h"), i.alias("i")))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    counted = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(text).cast("long").alias("_n"),
        (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("_upper"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("_digits"),
        (F.char_length(text) - F.char_length(_without(text, "!?"))).cast("long").alias("_marks"),
        lines.alias("_lines"),
        triples.alias("_triples"),
    )
    # Equal windows stand next to each other once sorted.
    ordered = _apart(counted, "_sorted", F.sort_array("_triples")).drop("_triples")
    same = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    full = ordered.withColumn("n_repeat_words", covered.cast("long")).withColumn("_n_lines", F.size("_lines").cast("long"))
    full = full.withColumn("n_dup_lines", F.col("_n_lines") - F.size(F.array_distinct("_lines")))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return full.select(
        "doc_id",
        *_COUNTS,
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "_n").alias("symbol_share"),
        share("n_dup_lines", "_n_lines").alias("dup_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "_n").alias("upper_share"),
        share("_marks", "_n").alias("mark_share"),
        share("_digits", "_n").alias("digit_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _holds(x: dict[str, np.ndarray], condition: Condition) -> np.ndarray:
    value = x[condition.feature]
    return value >= condition.cut if condition.above else value <= condition.cut


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Conditions that each add most information about the bad documents that are left (FOIL's gain)."""
    rule: list[Condition] = []
    left = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[left]).any() and bad[left].any():
        now = np.log2(bad[left].mean())
        best, gain = None, 0.0
        for feature in FEATURES:
            for cut in np.unique(np.quantile(x[feature][left], np.linspace(0, 1, CUTS), method="nearest")):
                for above in (True, False):
                    condition = Condition(feature, above, float(cut))
                    inside = left & _holds(x, condition)
                    n_bad = (bad & inside).sum()
                    if n_bad and (found := n_bad * (np.log2(n_bad / inside.sum()) - now)) > gain:
                        best, gain = condition, found
        if best is None:
            break
        rule.append(best)
        left &= _holds(x, best)
    return rule


def _precision(x: dict[str, np.ndarray], bad: np.ndarray, rule: list[Condition]) -> tuple[float, int]:
    inside = np.ones(len(bad), bool)
    for condition in rule:
        inside &= _holds(x, condition)
    return (float((bad & inside).sum() + 1) / (inside.sum() + 2), int(inside.sum()))


def cover(x: dict[str, np.ndarray], bad: np.ndarray, growing: np.ndarray) -> list[list[Condition]]:
    """The rules, in order, each a conjunction that bad documents meet. growing: the documents that rules are grown on."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & growing, left & ~growing
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow])
        if not rule:
            break
        held = {f: v[prune] for f, v in x.items()}
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _precision(held, bad[prune], r)[0])
        precision, covered = _precision(held, bad[prune], rule)
        if precision < MIN_PRECISION or covered < MIN_COVERED:
            break
        rules.append(rule)
        for condition in rule[:1]:
            inside = _holds(x, condition)
        for condition in rule[1:]:
            inside = inside & _holds(x, condition)
        left &= ~inside
    return rules


def learn(measures: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """The decision list for quality 0, from the labelled documents that pass the base rules; at most max_labelled, by hash of the id.

    A document labelled twice counts as poor if either label says so. Of conditions that gain as much the first feature, the
    lowest cut and ``>=`` win; of prunings that are as precise the longest.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = bounded_sample(measures.filter(~base_failed()).join(known, "doc_id"), max_labelled, "doc_id").orderBy("doc_id", *FEATURES)
    rows = chosen.select("quality", F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)).alias("part"), *FEATURES).collect()
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return cover(x, np.array([r["quality"] == 0 for r in rows], bool), np.array([r["part"] != 0 for r in rows], bool))


def decision(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that a document meets, from 1; 0 if it meets none."""
    chain = None
    for number, rule in enumerate(rules, 1):
        met = F.lit(True)
        for feature, above, cut in rule:
            met = met & (F.col(feature) >= cut if above else F.col(feature) <= cut)
        chain = F.when(met, number) if chain is None else chain.when(met, number)
    return F.lit(0) if chain is None else chain.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text), (doc_id, quality) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule).

    One row for each document; rule is the number of the learned rule that it met first, 0 if none. Where no rule can be
    learned all documents that pass the base rules are kept.
    """
    measures = written(measured(docs), "quality-measures")
    judged = measures.withColumns({"base_failed": base_failed(), "rule": decision(learn(measures, labels))})
    return judged.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
