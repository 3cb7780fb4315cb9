"""Toxicity by compression distance.

Two zstandard dictionaries, both trained: one on windows of ordinary text, the other on windows of toxic text. Most of a toxic
document is ordinary, so that its windows are chosen: a word stands out if it begins with a piece, a whole word or a beginning
that several words near each other share, that many toxic documents have and ordinary ones hardly do. How many documents must
have a piece does not grow with their number, so that those of a language with few documents are found too. A window of eight
words is compressed with the ordinary dictionary and with the same followed by the toxic one; how many bytes a document's
windows must save in all is calibrated on labelled documents that neither dictionary has seen.

Words are spelled before they are compressed: a character becomes two bytes, a hash of the word up to it, so that what
matches is the beginning of a word, whole words included, and not any part. Both dictionaries are of the same length, so
that a match costs the same in either.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_sample, fold, table, written
from pagewright.llm.shingles import shingle_hashes

HELD_OUT, PARTS = 2, (0, 1, 3)
#: Labelled documents to learn from at most, and windows to train each dictionary on at most.
MAX_LABELLED, MAX_WINDOWS = 20_000, 20_000
#: Words in a window that is compared, in one that the ordinary dictionary is trained on, and in one whose words may share a beginning.
WINDOW, TRAINED, NEAR = 8, 16, 64
#: The characters at which a word is cut.
RUN = 64
#: Bytes of the dictionaries.
PLAIN_BYTES, TOXIC_BYTES = 16_384, 4096
#: For the toxic one the trainer looks at segments of so many bytes, scored by how often runs of so many recur.
SEGMENT, RECURRING = 24, 8
#: Lengths of the beginnings of words that are counted.
STEM = (4, 12)
#: A piece stands out if so many toxic documents have it, they have it so many times as often as ordinary ones, and the
#: log-likelihood ratio of that is so large. Documents that are counted at a time.
MIN_SUPPORT, MIN_LIFT, MIN_STRENGTH, SLICE = 5, 6.0, 30.0, 500
#: Bytes that the toxic dictionary must save in a window for it to count.
COUNTS = 5
#: Steps of a doubling of the measure, and how many there are; the last is out of reach of any text.
STEPS, LEVELS = 12, 512
THRESHOLD = 0.3


class Model(NamedTuple):
    """The two dictionaries, and the probability that a document is toxic at each level of the measure."""

    ordinary: bytes
    toxic: bytes
    probability: list[float]


def cut_words(text: str | None) -> list[str]:
    """The words of a text in lower case; one longer than RUN characters is cut."""
    found = (text or "").lower().split()
    if any(len(w) > RUN for w in found):
        found = [w[i : i + RUN] for w in found for i in range(0, len(w), RUN)]
    return found


def spelled(words: list[str]) -> tuple[bytes, np.ndarray]:
    """The words with a space before, between and after them, two bytes a character, and the places of the spaces.

    The two bytes are a hash of the word up to the character; a space is two spaces.
    """
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_space = codes == 32
    space = np.flatnonzero(is_space)
    before = np.maximum.accumulate(np.where(is_space, np.arange(len(codes)), 0))
    terms = np.where(is_space, np.uint32(0), (codes + np.uint32(1)) * _POWERS[np.arange(len(codes)) - before])
    so_far = np.cumsum(terms, dtype=np.uint32)
    out = ((so_far - so_far[before]) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")
    out[is_space] = 0x2020
    return out.tobytes(), space


_POWERS = np.cumprod(np.full(RUN + 1, 0x85EBCA6B, np.uint32), dtype=np.uint32)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of ``size`` words, spelled, each word between spaces."""
    found = cut_words(text)
    if not found:
        return []
    data, space = spelled(found)
    starts, ends = (2 * space[:-1:size]).tolist(), (2 * np.append(space[size::size], space[-1]) + 2).tolist()
    return [data[i:j] for i, j in zip(starts, ends, strict=False)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=16, chain_log=16, search_log=4, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


class Distance:
    """Compares the compressed lengths of windows under the ordinary and the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # zstandard does not find matches in a dictionary's last bytes.
        self.plain, self.toxic = (_compressor(ordinary + d + b" " * 8).compress for d in (bytes(len(toxic)), toxic))

    def saved(self, found: list[bytes]) -> np.ndarray:
        """For each window the bytes that the toxic dictionary saves; fewer than none where it is worse."""
        plain, toxic = self.plain, self.toxic
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in found), np.int64, len(found))

    def level(self, text: str | None) -> int:
        """The bytes saved in all different windows that count, over the root of their number, in logarithmic steps; 0 without words."""
        saved = self.saved(list(set(windows(text))))
        if not len(saved):
            return 0
        measure = saved[saved >= COUNTS].sum() / np.sqrt(len(saved))
        return min(int(STEPS * np.log2(1 + measure)), LEVELS - 1)


def rising(toxic: np.ndarray, n: np.ndarray) -> list[float]:
    """The share of toxic documents at each level, smoothed by one document at the overall share, made never to fall; in between where none has it."""
    base = toxic.sum() / max(1, n.sum())
    blocks: list[list[float]] = []
    seen = np.flatnonzero(n)
    for i in seen:
        blocks.append([float(toxic[i]), float(n[i]), 1])
        while len(blocks) > 1 and _share(blocks[-2], base) >= _share(blocks[-1], base):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    shares = [_share(block, base) for block in blocks for _ in range(int(block[2]))]
    return np.interp(np.arange(len(n)), seen, shares).tolist() if shares else [base] * len(n)


def _share(block: list[float], base: float) -> float:
    return (block[0] + base) / (block[1] + 1)


def pieces(text: str | None) -> set[str]:
    """The words of a text, between spaces, and the beginnings that two words or more near each other share, after a space."""
    found = cut_words(text)
    out = {f" {w} " for w in found}
    least, most = STEM
    for i in range(0, len(found), NEAR):
        # Words with the same beginning stand next to each other once sorted.
        for a, b in pairwise(sorted(found[i : i + NEAR])):
            if a[:least] == b[:least]:
                k = least
                while k <= min(most, len(a), len(b)) and a[:k] == b[:k]:
                    out.add(" " + a[:k])
                    k += 1
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """(text, toxic, part) -> (piece, a_0, b_0, ...): the toxic and the ordinary documents of each part that have the piece; the pieces of MIN_SUPPORT toxic ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                rows = batch.iloc[lo : lo + SLICE]
                found = Counter((p, part, toxic) for text, toxic, part in zip(rows["text"], rows["toxic"], rows["part"], strict=True) for p in pieces(text))
                yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=["piece", "part", "toxic", "n"])

    some = sample.select("text", "toxic", "part").mapInPandas(count, "piece string, part int, toxic int, n long")
    sums = [F.sum(F.when((F.col("part") == part) & (F.col("toxic") == toxic), F.col("n")).otherwise(0)).alias(f"{name}_{part}") for part in PARTS for toxic, name in ((1, "a"), (0, "b"))]
    return some.groupBy("piece").agg(*sums).filter(sum(F.col(f"a_{part}") for part in PARTS) >= MIN_SUPPORT)


def _standing_out(counted: DataFrame, parts: tuple[int, ...], n: dict[int, int]) -> list[str]:
    """The pieces that stand out in these parts; one that begins with another of them adds nothing and is left out.

    A piece is in MIN_SUPPORT of the sampled documents at least, so that their number is bounded with the sample.
    """
    a, b = (sum(F.col(f"{name}_{part}") for part in parts) for name in "ab")
    held = counted.select("piece", a.alias("a"), (b + 1).alias("b")).filter((F.col("a") >= MIN_SUPPORT) & (F.col("a") / n[1] >= MIN_LIFT * F.col("b") / n[0]))
    share = n[1] / (n[0] + n[1])
    strength = sum(2 * F.col(x) * F.log(F.col(x) / ((F.col("a") + F.col("b")) * s)) for x, s in (("a", share), ("b", 1 - share)))
    chosen: list[str] = []
    for (piece,) in held.filter(strength >= MIN_STRENGTH).select("piece").orderBy("piece").toLocalIterator():
        if not chosen or not piece.startswith(chosen[-1]):
            chosen.append(piece)
    return chosen


def _toxic_windows(sample: DataFrame, standing: dict[int, list[str]]) -> DataFrame:
    """(text, part) -> (without, window, n): how often each word that begins with a piece, spelled, stands in toxic documents outside the part ``without``; -1 is none."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = {without: tuple(chosen) for without, chosen in standing.items()}
        for batch in batches:
            found: Counter = Counter()
            for text, part in zip(batch["text"], batch["part"], strict=True):
                for word, n in Counter(cut_words(text)).items():
                    for without, some in starts.items():
                        if part != without and f" {word} ".startswith(some):
                            found[without, word] += n
            yield pd.DataFrame([(without, spelled([word])[0], n) for (without, word), n in found.items()], columns=["without", "window", "n"])

    found = sample.filter("toxic = 1").select("text", "part").mapInPandas(choose, "without int, window binary, n long")
    return found.groupBy("without", "window").agg(F.sum("n").alias("n"))


def _plain_windows(sample: DataFrame) -> DataFrame:
    """(text, part) -> (part, window): windows of ordinary documents, MAX_WINDOWS of them at most."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(part, w) for text, part in zip(batch["text"], batch["part"], strict=True) for w in windows(text, TRAINED)], columns=["part", "window"])

    found = sample.filter("toxic = 0").select("text", "part").mapInPandas(cut, "part int, window binary")
    return bounded_sample(written(found, "toxicity-windows"), MAX_WINDOWS, "window", "part")


def _trained(samples: list[bytes], size: int, **how: object) -> bytes:
    """A trained dictionary of these windows, in any order, or the windows themselves where they are too few to train on."""
    samples = sorted(samples)
    np.random.default_rng(0).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, level=3, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionaries(sample: DataFrame) -> dict[int, tuple[bytes, bytes]]:
    """By the part that they have not seen, -1 being none: the dictionaries of ordinary and of toxic text, of parts that have both kinds."""
    counted = written(_counted(sample), "toxicity-pieces")
    n = {(part, toxic): k for part, toxic, k in sample.groupBy("part", "toxic").agg(F.count("*")).collect()}
    standing, sizes = {}, {}
    for without in (-1, *PARTS):
        parts = tuple(p for p in PARTS if p != without)
        sizes[without] = {toxic: sum(n.get((p, toxic), 0) for p in parts) for toxic in (0, 1)}
        if min(sizes[without].values()):
            standing[without] = _standing_out(counted, parts, sizes[without])
    plain = [(part, bytes(w)) for part, w in _plain_windows(sample).toLocalIterator()]
    chosen = written(_toxic_windows(sample, standing), "toxicity-chosen")
    out = {}
    for without in standing:
        own = bounded_sample(chosen.filter(F.col("without") == without), MAX_WINDOWS, "window").select("window", "n").collect()
        # As often as they stand in the documents, but MAX_WINDOWS in all, besides one of each.
        rate = min(1.0, MAX_WINDOWS / max(1, sum(k for _, k in own)))
        toxic = [bytes(w) for w, k in own for _ in range(max(1, round(k * rate)))]
        out[without] = _trained([w for part, w in plain if part != without], PLAIN_BYTES), _trained(toxic, TOXIC_BYTES, k=SEGMENT, d=RECURRING, f=20, accel=1, split_point=1.0)
    return out


def _without_copies(sample: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) -> the same, one document of those with the same least, then with the same greatest hash of a word shingle.

    What a group of near copies repeats would stand out like what many documents say. The least id stays; toxic if any is.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [own.view(np.int64) for own in shingle_hashes(pa.array(batch["text"], pa.string()))]
            yield batch.assign(first=[int(x[0]) if len(x) else 0 for x in found], last=[int(x[-1]) if len(x) else 0 for x in found])

    left = sample.mapInPandas(mark, "doc_id long, text string, toxic int, first long, last long")
    for key in ("first", "last"):
        left = left.groupBy(key).agg(F.max("toxic").alias("toxic"), F.min(F.struct("doc_id", "text", *({"first", "last"} - {key}))).alias("one")).select("toxic", key, "one.*")
    return left.select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """(doc_id, text), (doc_id, toxic) -> the model; None if the labels outside the held-out fold lack either class.

    It learns from ``max_labelled`` labelled documents at most, those whose ids hash lowest; a document labelled twice
    counts as toxic if either label says so, of rows that share an id the least text is learned from, and of near copies mostly
    one. The level of each document that the probabilities are read off is that under dictionaries of the other folds, made as the whole ones are.
    """
    asked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    asked = asked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The broadcast side has max_labelled rows of two numbers.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(bounded_sample(asked, max_labelled, "doc_id")), "doc_id")
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = written(_without_copies(one).withColumn("part", fold(F.col("doc_id"))), "toxicity-sample")
    pairs = _dictionaries(sample)
    if -1 not in pairs:
        return None
    seen = [p for p in PARTS if p in pairs]

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {part: Distance(*pairs[part]) for part in seen}
        for batch in batches:
            yield batch[["toxic"]].assign(level=[of[part].level(text) for part, text in zip(batch["part"], batch["text"], strict=True)])

    counts = np.zeros((2, LEVELS))
    measured = sample.filter(F.col("part").isin(*seen)).select("text", "toxic", "part").mapInPandas(levels, "toxic int, level int")
    for r in measured.groupBy("level").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect():
        counts[:, r["level"]] += r["a"], r["n"]
    return Model(*pairs[-1], rising(*counts))


def score(model: Model | None, text: Column) -> Column:
    """The probability that a text is toxic. Null and empty texts have that of level 0; without a model it is 0."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Distance(model.ordinary, model.toxic)
        for texts in batches:
            yield pd.Series([model.probability[of.level(t)] for t in texts], dtype="float64")

    return probability(text.cast("string"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text), (doc_id, toxic) -> (doc_id, held_out, score, predicted), one row for each document.

    Null and empty texts get the score of a text in which nothing is saved; rows without an id or that share one are scored
    each by its text; without labels of both classes all score 0.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns whatever these are named."""
    return docs.filter(score(train(docs, labels), F.col("text")) < threshold)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
