"""Phrases whose words stand together more often than chance has it, counted by Suffix-sigma.

Every word begins a suffix of its piece, cut after ``longest`` words. The suffixes are dealt by first word and language and
sorted in reverse order, so that all occurrences of a phrase, which are the suffixes that begin with it, stand
in one run of its language. One pass with a stack of open prefixes, one for each length, counts all phrases at once: a row closes the prefixes that it
does not share with the row before. What the empty prefix counts are the words of the language.

Dealing is by ranges of that order, which a bounded sample cuts to about equal sizes, equal suffixes of a block of text being
one row with its count. The suffixes of a frequent first word thereby spread over as many tasks as they need, and only the prefixes that are open at either end of a task are known
in part; those are always given out, and parts are added up after. All other phrases below the least count end in their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import table, written

#: Words of the longest phrase, the least count of a phrase, and the phrases of a language that are told.
LONGEST, LEAST, TOLD = 5, 100, 2000
#: Of 100 occurrences of a phrase so many within one longer phrase make it a part of that.
WITHIN = 100
#: Bytes of text that are split at a time, and words whose suffixes are written out at a time.
CHUNK, BLOCK = 1 << 21, 1 << 18
#: Documents, and as many of their suffixes at most, that tell where the ranges are cut; and the first bytes of a suffix, which decide on its range.
SAMPLED, LEADS, LEADING = 2000, 1 << 15, 24
#: A frequent part of phrases is joined in so many places, the size of a language in so many.
SALTS, LANGUAGE_SALTS = 16, 256

#: The score of a cut, exact: no factor passes 17 digits, no product 38.
SCORE = "div(cast(1000 AS decimal(4,0)) * cast(cast(a AS decimal(17,0)) * cast(n AS decimal(17,0)) AS decimal(34,0)), cast(l AS decimal(17,0)) * cast(r AS decimal(17,0)))"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
# Words end with a byte that sorts before all others, for which NUL itself is put as a byte that UTF-8 does not have.
_STORED = np.arange(256, dtype=np.uint8)
_STORED[65:91] += 32
_STORED[0] = 0xFF
_TOLD = bytes.maketrans(b"\x00\xff", b" \x00")


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    out = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    at = np.arange(out[-1], dtype=np.int64) + np.repeat(starts - out[:-1], lengths)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(out), pa.py_buffer(data[at])])


def suffixes(data: np.ndarray, longest: int) -> Iterator[pa.BinaryArray]:
    """The suffix of each word of a text that ends with a break between pieces: its words, each with a NUL behind it."""
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    stored = _STORED[data]
    stored[ends] = 0
    inside[ends] = True
    stored = stored[inside]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=offsets[1:])
    after = np.minimum(np.arange(len(starts)) + longest, np.searchsorted(piece, piece, side="right"))
    for lo in range(0, len(starts), BLOCK):
        own = slice(lo, lo + BLOCK)
        yield _gathered(stored, offsets[:-1][own], offsets[after[own]] - offsets[:-1][own])


def _chunks(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Texts one behind the other in chunks of about CHUNK bytes; a longer text is cut between pieces, a longer piece is whole."""
    gathered, size = [], 0
    for text in texts:
        gathered += (text, b"\n")
        size += len(text) + 1
        if size >= CHUNK:
            data = np.frombuffer(b"".join(gathered), np.uint8)
            breaks = np.flatnonzero(_KIND[data] == 2) if size > 2 * CHUNK else np.array([len(data) - 1])
            at = 0
            while at < len(data):
                k = np.searchsorted(breaks, at + CHUNK)
                end = int(breaks[min(k, len(breaks) - 1)]) + 1
                yield data[at:end]
                at = end
            gathered, size = [], 0
    if gathered:
        yield np.frombuffer(b"".join(gathered), np.uint8)


def _leading(suffix: pa.BinaryArray) -> np.ndarray:
    """The first bytes of suffixes, as numpy compares them: a shorter one is filled up with the byte that sorts first."""
    offsets = np.frombuffer(suffix.buffers()[1], np.int32)[suffix.offset : suffix.offset + len(suffix) + 1].astype(np.int64)
    data = np.frombuffer(suffix.buffers()[2], np.uint8)
    at = offsets[:-1, None] + np.arange(LEADING)
    found = np.where(at < offsets[1:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return found.view(f"S{LEADING}").ravel()


def suffix_counts(docs: DataFrame, longest: int = LONGEST, cuts: list[bytes] | None = None) -> DataFrame:
    """(lang, text) -> (part, lang, suffix, n): the suffixes of the words, those of a block that are equal counted, and the range between cuts that each is in."""
    bounds = np.array(cuts or [], f"S{LEADING}")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).dictionary_encode()
            codes = of.indices.to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.large_binary())
            for code, lang in enumerate(of.dictionary.to_pylist()):
                for data in _chunks(texts.filter(pa.array(codes == code)).to_pylist()):
                    for block in suffixes(data, longest):
                        counted = pa.table({"suffix": block}).group_by("suffix", use_threads=False).aggregate([([], "count_all")])
                        for rows in counted.to_batches():
                            part = np.searchsorted(bounds, _leading(rows["suffix"]), "right").astype(np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([lang] * rows.num_rows, pa.string()), rows["suffix"], rows["count_all"]], ["part", "lang", "suffix", "n"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(emit, "part int, lang string, suffix binary, n long")


def _cuts(docs: DataFrame, longest: int, parts: int) -> list[bytes]:
    """Where the order of suffixes is cut into ranges of about equal size, by a sample. Cuts decide on no result, only on which task counts what."""
    n = docs.count()
    sample = docs.sample(min(1.0, SAMPLED / n), 1) if n else docs
    thin = suffix_counts(sample, longest).orderBy(F.xxhash64("suffix", "lang")).limit(LEADS)
    found = sorted(thin.select(F.substring("suffix", 1, LEADING).alias("lead")).toArrow().column("lead").to_pylist())
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


class _Stack:
    """The prefixes that the row before has left open, one for each length from 0, and their counts so far."""

    def __init__(self, longest: int, least: int) -> None:
        self.depths, self.least = longest + 1, least
        self.row = None
        self.open = np.zeros(self.depths, np.int64)
        # Whether the open prefix may go on in the task before: nothing of its length has been closed yet.
        self.first = np.ones(self.depths, bool)

    def push(self, rows: pa.Array, n: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """Takes rows of a language in their order and gives the prefixes that they close: (words, count)."""
        held = self.row is not None
        if held:
            rows = pa.concat_arrays([pa.array([self.row], pa.binary()), rows])
            n = np.append(0, n)
        offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
        data = np.frombuffer(rows.buffers()[2], np.uint8)
        lengths = np.diff(offsets)
        # How far each row is like the one before, in bytes and then in whole words.
        compared = np.minimum(lengths[1:], lengths[:-1])
        ends = np.cumsum(compared)
        begins = ends - compared
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(begins, compared)
        unlike = np.flatnonzero(data[at + np.repeat(offsets[1:-1], compared)] != data[at + np.repeat(offsets[:-2], compared)])
        unlike = np.append(unlike, len(at))
        like = np.minimum(unlike[np.searchsorted(unlike, begins)], ends) - begins
        marks = np.flatnonzero(data[: offsets[-1]] == 0)
        first_mark = np.searchsorted(marks, offsets[:-1])
        words = np.searchsorted(marks, offsets[1:]) - first_mark
        shared = np.full(len(rows), -1)
        shared[1:] = np.searchsorted(marks, offsets[1:-1] + like) - first_mark[1:]
        for depth in range(self.depths):
            starts = np.flatnonzero(shared < depth) if depth else np.zeros(1, np.int64)
            counts = np.add.reduceat(n, starts)
            counts[0] += self.open[depth] if held else 0
            told = (words[starts] >= depth) & (counts >= self.least)
            if self.first[depth] and len(starts) > 1:
                told[0] = words[starts[0]] >= depth
                self.first[depth] = False
            self.open[depth] = counts[-1]
            for k in np.flatnonzero(told[:-1]).tolist():
                row = int(starts[k])
                yield data[offsets[row] : marks[first_mark[row] + depth - 1] + 1].tobytes(), int(counts[k])
        self.row = rows[-1].as_py()

    def close(self) -> Iterator[tuple[bytes, int]]:
        """What is open after the last row, which may go on in the next task."""
        if self.row is not None:
            ends = [0, *[i + 1 for i, b in enumerate(self.row) if b == 0]]
            for depth, end in enumerate(ends):
                yield self.row[:end], int(self.open[depth])


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, text) -> (lang, phrase, f): phrases of up to ``longest`` words, in ASCII lower case and a space apart, that occur ``least`` times
    or more within pieces of a language's texts; and the phrase '' with the number of its words.

    A null language is 'und', a null text is empty, rows that repeat count each; a language without a word has no row. Other
    columns are not looked at. A text is cut between pieces to go through memory, so that one piece at a time must fit.
    """
    # The words come first in the order, since a sort is fast on its first bytes: the languages of a task have a stack each.
    order = [F.desc("suffix"), F.desc("lang")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = suffix_counts(docs, longest, _cuts(docs, longest, parts))
    dealt = found.repartitionById(parts, F.col("part")).select("lang", "suffix", "n").sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[str, _Stack] = {}

        def told(found: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1][:-1].translate(_TOLD).decode() for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64())], ["lang", "phrase", "f"]
            )

        for batch in batches:
            of = batch.column(0).dictionary_encode()
            codes = of.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(of.dictionary.to_pylist()):
                own = batch.filter(pa.array(codes == code)) if len(of.dictionary) > 1 else batch
                stack = stacks.setdefault(lang, _Stack(longest, least))
                yield told([(lang, *found) for found in stack.push(own.column(1), own.column(2).to_numpy())])
        for lang, stack in stacks.items():
            yield told([(lang, *found) for found in stack.close()])

    counted = dealt.mapInArrow(count, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def _joined(rows: DataFrame, sizes: DataFrame, phrase: str, name: str, salts: int) -> DataFrame:
    """rows with the count, called ``name``, of what is in the column ``phrase``. A phrase that stands in many rows is joined in ``salts`` places."""
    copies = sizes.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(name), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase", "k"), F.lit(salts)).cast("int"))
    return salted.join(copies, ["lang", phrase, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, told: int = TOLD, within: int = WITHIN) -> DataFrame:
    """(lang, text) -> (lang, rank, phrase, a, l, r, n, score): of each language the ``told`` phrases of 2 to ``longest`` words that hold together best.

    score is floor(1000 * a * n / (l * r)) of the cut in two parts at which it is least, the shortest first part among ties. A phrase
    is left out if of 100 of its occurrences ``within`` or more stand within one longer phrase. Nulls, empty texts, repeated
    rows and other columns are as in phrase_counts; tables without a phrase give no row. Ties are ranked by a, then by the
    phrase's bytes. Arithmetic is exact in 38 digits.
    """
    counts = written(phrase_counts(docs, longest, least), "phrases")
    phrases = counts.filter(F.col("phrase") != "").withColumn("_words", F.split("phrase", " "))
    candidates = phrases.filter(F.size("_words") > 1)
    n_words = F.size("_words")
    longer = candidates.filter(n_words > 2).select("lang", "f", "_words", F.explode(F.sequence(F.lit(2), n_words - 1)).alias("_size"))
    longer = longer.select("lang", "f", "_words", "_size", F.explode(F.sequence(F.lit(1), n_words - F.col("_size") + 1)).alias("_from"))
    part = F.array_join(F.slice("_words", F.col("_from"), F.col("_size")), " ")
    around = longer.select("lang", part.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_around"))
    kept = candidates.join(around, ["lang", "phrase"], "left").filter(F.col("_around").isNull() | (100 * F.col("_around") < within * F.col("f")))
    kept = _joined(kept.select("lang", "phrase", F.col("f").alias("a"), "_words", F.lit("").alias("_none"), F.lit(0).alias("k")), counts.filter(F.col("phrase") == ""), "_none", "n", LANGUAGE_SALTS)
    cut = kept.select("lang", "phrase", "a", "n", "_words", F.explode(F.sequence(F.lit(1), n_words - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "n", "k", F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ").alias("_left"), F.array_join(F.slice("_words", F.col("k") + 1, n_words - F.col("k")), " ").alias("_right"))
    parted = _joined(_joined(cut, counts, "_left", "l", SALTS), counts, "_right", "r", SALTS)
    score = F.expr(SCORE)
    scored = parted.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("_cut"))
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("_cut").alias("_cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = least_cut.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score").withColumn("_rank", rank).filter(F.col("_rank") <= told)
    return out.select("lang", F.col("_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same with joins of lists of words. Patterns hold the characters themselves, since not all engines read their escapes alike.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, len, unnest(list_transform(range(1, len(ws) - len + 2), lambda i: array_to_string(ws[i : i + len - 1], ' '))) AS phrase FROM w, range(1, 6) t(len) WHERE len(ws) >= len),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE len > 1),
s AS (SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, max(a) AS around FROM c, range(2, 5) t(size), range(1, 5) u(i) WHERE size < len AND i + size - 1 <= len GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a),
x AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:len], ' ') AS rp FROM k, range(1, 5) t(k) WHERE k < len),
y AS (SELECT x.lang, x.phrase, a, k, fl.f AS l, fr.f AS r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = rp JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000
"""
