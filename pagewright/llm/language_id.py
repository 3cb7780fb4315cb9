"""Language identification by unigram piece models, one for each language, over a fixed public vocabulary.

A word's probability in a language is the sum, over all ways to segment it into pieces of the vocabulary, of the products
of the pieces' probabilities: the forward algorithm. Pieces never cross white space, so that a text's probability is the
product of its words'. The piece probabilities are learned by expectation maximisation over the counts of all words of all
training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import fold, table, written

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
ROUNDS = 2
#: Added to the expected count of each piece of each language.
SMOOTHING = 0.5
#: The probability of a character that no piece covers, in any language.
UNKNOWN = 1e-7
#: Words are scored in runs of this many characters at most; a longer one is cut.
RUN = 24
#: Distinct words that a task counts before it hands them on, and that it remembers with their scores.
COUNTED, REMEMBERED = 100_000, 150_000
#: Words that are worked on together.
TOGETHER = 100_000
HELD_OUT = 2
#: A model is refused if there are more languages than this: what comes to the driver grows with their number.
MAX_LANGUAGES = 1000

_BASE, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 21


def vocabulary(path: str) -> list[str]:
    """The distinct lower-cased pieces of a sentencepiece file, without the mark of a word's start and without control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in found if 0 < len(p) <= RUN)


class Pieces:
    """The vocabulary with vectorised look-up of all substrings of many equally long words."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=0)
        self.hash = np.zeros(self.n + 1, np.uint64)
        self.tables = [np.full(1 << _SLOTS, self.n, np.int32) for _ in range(2)]
        for length in range(1, self.longest + 1):
            of = [i for i, p in enumerate(pieces) if len(p) == length]
            codes = codes_of([pieces[i] for i in of], length)
            value = np.zeros(len(of), np.uint64)
            for k in range(length):
                value = value * _BASE + codes[:, k]
            self.hash[of] = value
        places = [at.tolist() for at in self._slots(self.hash[: self.n])]
        for i in range(self.n):
            for at, held in zip(places, self.tables, strict=True):
                if held[at[i]] == self.n:
                    held[at[i]] = i
                    break

    @staticmethod
    def _slots(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = value ^ (value >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        return mixed >> np.uint64(64 - _SLOTS), (mixed >> np.uint64(8)) & np.uint64((1 << _SLOTS) - 1)

    def ids(self, value: np.ndarray) -> np.ndarray:
        """The piece that hashes to each value, n if none."""
        first, second = self._slots(value)
        a = self.tables[0][first]
        b = self.tables[1][second]
        return np.where(self.hash[a] == value, a, np.where(self.hash[b] == value, b, self.n)) if self.n else a

    def spans(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> for each word the piece that stands there, for every pair at which any word has one."""
        length = codes.shape[1]
        out = {}
        for start in range(length):
            value = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                value = value * _BASE + codes[:, end - 1]
                ids = self.ids(value)
                if (ids < self.n).any():
                    out[start, end] = ids
        return out


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)


def runs(text: str) -> list[str]:
    """The words of a text in lower case, long ones cut."""
    found = text.lower().split()
    if any(len(w) > RUN for w in found):
        found = [w[i : i + RUN] for w in found for i in range(0, len(w), RUN)]
    return found


def forward(spans: dict, length: int, n: int, longest: int, chance: np.ndarray) -> list[np.ndarray]:
    """chance: (pieces + 1) x languages, the last row 0. For each end, the summed probability of all segmentations up to it."""
    alpha = [np.ones((n, chance.shape[1]))]
    for end in range(1, length + 1):
        total = alpha[end - 1] * UNKNOWN
        for start in range(max(0, end - longest), end):
            if (ids := spans.get((start, end))) is not None:
                total = total + alpha[start] * chance[ids]
        alpha.append(total)
    return alpha


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def log_scores(words: list[str], pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """words x languages: the logarithm of each word's probability."""
    out = np.zeros((len(words), chance.shape[1]))
    for length, at in by_length(words):
        for part in np.array_split(at, -(-len(at) // 4096)):
            codes = codes_of([words[i] for i in part], length)
            out[part] = np.log(forward(pieces.spans(codes), length, len(part), pieces.longest, chance)[length])
    return out


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """How often each piece stands in these words of one language, over all segmentations by their probability."""
    total = np.zeros(pieces.n + 1)
    for length, at in by_length(words):
        for part in np.array_split(at, -(-len(at) // 4096)):
            spans = pieces.spans(codes_of([words[i] for i in part], length))
            alpha = [a[:, 0] for a in forward(spans, length, len(part), pieces.longest, chance[:, None])]
            beta = [np.zeros(len(part))] * length + [np.ones(len(part))]
            for start in range(length - 1, -1, -1):
                sum_ = beta[start + 1] * UNKNOWN
                for end in range(start + 1, min(length, start + pieces.longest) + 1):
                    if (ids := spans.get((start, end))) is not None:
                        sum_ = sum_ + chance[ids] * beta[end]
                beta[start] = sum_
            weight = counts[part] / alpha[length]
            for (start, end), ids in spans.items():
                total += np.bincount(ids, alpha[start] * chance[ids] * beta[end] * weight, pieces.n + 1)
    return total[:-1]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows, since words of a length are worked on at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def word_counts(training: DataFrame, languages: list[str]) -> DataFrame:
    """(text, lang) -> (language, word, n): how often each word stands in all texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: i for i, lang in enumerate(languages)}
        held = [Counter() for _ in languages]

        def flush() -> Iterator[pa.RecordBatch]:
            for i, counter in enumerate(held):
                if counter:
                    yield pa.RecordBatch.from_pydict({"language": pa.array([i] * len(counter), pa.int32()), "word": pa.array(counter.keys(), pa.string()), "n": pa.array(counter.values(), pa.int64())})
                    counter.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[index[lang]].update(runs(text.as_py()))
                if sum(map(len, held)) > COUNTED:
                    yield from flush()
        yield from flush()

    counted = training.select("text", "lang").mapInArrow(count, "language int, word string, n long")
    return counted.groupBy("language", "word").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """languages, in order, and the probability of each piece in each; the last row stands for no piece."""

    languages: list[str]
    pieces: list[str]
    chance: np.ndarray


def train(docs: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> Model:
    """(doc_id, text, lang) -> the model, from all documents outside the held-out fold that have a text and a language.

    What comes to the driver is bounded by vocabulary and languages: an expected count for each piece of each.
    """
    spark = docs.sparkSession
    training = docs.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r[0] for r in training.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    start = np.full(len(pieces), 1.0 / max(1, len(pieces)))
    chance = np.vstack([np.repeat(start[:, None], len(languages), 1), np.zeros((1, len(languages)))])
    if not languages:
        return Model(languages, pieces, chance)
    counted = written(word_counts(training, languages), "language-words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, chance))

        def collect_pieces(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            known, chance = shared.value
            index, total = Pieces(known), np.zeros((len(known), chance.shape[1]))
            for batch in gathered(batches, TOGETHER):
                language, words, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for g in np.unique(language):
                    at = np.flatnonzero(language == g)
                    total[:, g] += expected([words[i] for i in at], n[at].astype(float), index, chance[:, g])
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "language": pa.array(language, pa.int32()), "n": pa.array(total[piece, language], pa.float64())})

        sums = counted.mapInArrow(collect_pieces, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        chance = np.full((len(pieces) + 1, len(languages)), SMOOTHING)
        for batch in sums.toArrow().to_batches():
            chance[batch.column(0).to_numpy(), batch.column(1).to_numpy()] += batch.column(2).to_numpy()
        chance[-1] = 0
        chance /= chance.sum(0)
        shared.destroy()
    return Model(languages, pieces, chance)


class Scorer:
    """Scores texts, many at a time; remembers up to REMEMBERED words."""

    def __init__(self, languages: list[str], pieces: list[str], chance: np.ndarray):
        self.languages, self.pieces, self.chance = languages, Pieces(pieces), chance
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def rows(self, words: list[str]) -> np.ndarray:
        new = [*set(words).difference(self.known)]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
            new = [*set(words)]
        if new:
            self.known |= {w: i for i, w in enumerate(new, len(self.known))}
            self.scores = np.vstack([self.scores, log_scores(new, self.pieces, self.chance)])
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        total, held, ends = np.zeros((len(texts), len(self.languages))), [], []

        def add() -> None:
            of = np.repeat([i for i, _ in ends], [n for _, n in ends])
            for at in range(0, len(held), TOGETHER):
                np.add.at(total, of[at : at + TOGETHER], self.rows(held[at : at + TOGETHER]))
            held.clear()
            ends.clear()

        asked = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        for i, text in enumerate(texts):
            if asked[i]:
                found = runs(text)
                held += found
                ends.append((i, len(found)))
                if len(held) >= TOGETHER:
                    add()
        add()
        share = np.exp(total - total.max(1, keepdims=True)) if self.languages else total
        best = share.argmax(1) if self.languages else []
        return [(self.languages[best[i]], float(share[i, best[i]] / share[i].sum())) if asked[i] else (UNDETERMINED, 0.0) for i in range(len(texts))]


def predict(model: Model, text: Column, spark: SparkSession) -> Column:
    """struct(lang_pred, score): the likeliest learned language and its posterior probability, all languages equally likely before.

    Null and letterless texts, and all texts where nothing was learned, are ``und`` with score 0.
    """
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # Of this task alone: what it remembers goes with it, for a worker lives on.
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.DataFrame(scorer.texts(texts.tolist()), columns=["lang_pred", "score"])

    return score(text.cast("string"))


def default_vocabulary() -> list[str]:
    import public_tokenizers

    return vocabulary(public_tokenizers.path(VOCABULARY))


def identify(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score), one row for each document, repeated ids included.

    A null id falls in fold 0. Between languages of the same score the first in code point order wins.
    """
    model = train(docs, pieces)
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), predict(model, F.col("text"), docs.sparkSession).alias("_p"))
    return scored.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, pieces: list[str], least: float = 0.5) -> DataFrame:
    """The documents whose language is found, with a posterior probability of at least ``least``, and their own columns whatever these are named.

    Null and letterless texts go. Rows that share an id, or have none, are judged each by its text. If nothing can be learned, all go.
    """
    found = predict(train(docs, pieces), F.col("text"), docs.sparkSession)
    return docs.filter((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), default_vocabulary())
