"""Spellings of the same word: words one edit apart, each hung on its much more frequent neighbour.

Near words are found by an inverted index of positional 3-grams. A word of m letters, padded by two marks on either side, has
m + 2 grams, of which an edit spoils 3 at most: near words share at least max - 1, max being the longer one's letters, at
places that differ by no more than the edit moves them. So they share one of the four grams of each that are rarest in all
words, and they meet in the part of the index of that gram, its place and the length. Within a part a word's own grams are
looked up: of its posting lists all but the longest max - 2 are merged with a heap, since whoever is in none of those lists
cannot reach the bound. What the merge gives is counted against the bound, and what passes is compared letter by letter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import table, written
from pagewright.llm.shingles import mix64

#: Letters of a gram, and the least letters and occurrences of a word.
Q, SHORTEST, LEAST = 3, 5, 3
#: A form is so many times as frequent as the word that hangs on it.
TIMES = 2
#: One in SLIP runs of letters loses a letter.
SLIP = 97
#: Bytes of text that are split at a time, distinct words that a task counts before it gives them out, and rows of the index taken at a time.
CHUNK, COUNTED, ROWS = 1 << 22, 1 << 18, 1 << 15
#: Pairs that are compared at a time.
PAIRS = 1 << 16
#: Rows of one part of the index; a larger one is dealt into several, each of which meets all words that ask.
PART = 1 << 13

# Letters are those of Latin-1 that the runs are made of: a-z and the code points C0 to FF.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0xC0, 0x100)]] = True
_CODE = np.zeros(256, np.int64)
_CODE[_LETTER] = np.arange(1, 91)
GRAMS = 91**Q
#: Bytes of words whose checksum is worked out for all their occurrences at once.
_SHORT = 64


def _shifts() -> np.ndarray:
    """What n bytes do to the checksum before them: a table for each byte of it, for n up to _SHORT.

    The checksum of a + b is that of b, changed by a linear function of that of a, which depends on the length of b alone.
    """
    out = np.zeros((_SHORT + 1, 4, 256), np.uint32)
    for n in range(_SHORT + 1):
        for bit in range(32):
            value = zlib.crc32(bytes(n), 1 << bit) ^ zlib.crc32(bytes(n))
            has = np.arange(256) >> bit % 8 & 1 == 1
            out[n, bit // 8, has] ^= np.uint32(value)
    return out


def _slipped(word: bytes, checksum: int) -> bytes:
    at = checksum % len(word)
    return word[:at] + word[at + 1 :]


def _runs(ids: list, texts: list[str], shifts: np.ndarray, slip: int) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """The distinct runs of letters of texts in Latin-1, how often each occurs whole, and those that have lost a letter."""
    stored = [t.encode("latin-1", "replace").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(stored), np.uint8)
    inside = _LETTER[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    of, distinct = runs.indices.to_numpy(), runs.dictionary.to_pylist()
    utf8 = [w if w.isascii() else w.decode("latin-1").encode() for w in distinct]
    lengths = np.array([len(w) for w in utf8], np.int64)
    own = np.array([zlib.crc32(w) for w in utf8], np.uint32)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    doc = np.searchsorted(np.cumsum([len(s) for s in stored]), starts, side="right")
    checksum, prefix, length = own[of], before[doc], np.minimum(lengths, _SHORT)[of]
    for byte in range(4):
        checksum = checksum ^ shifts[length, byte, prefix >> np.uint32(8 * byte) & np.uint32(255)]
    for k in np.flatnonzero(lengths[of] > _SHORT).tolist():
        checksum[k] = zlib.crc32(utf8[of[k]], int(prefix[k]))
    slips = checksum % slip == 0
    lost = [_slipped(distinct[of[k]], int(checksum[k])) for k in np.flatnonzero(slips).tolist()]
    return distinct, np.bincount(of[~slips], minlength=len(distinct)), lost


def word_counts(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """(doc_id, text) -> (word, n) of all runs of letters, ASCII ones in lower case, one in ``slip`` of them less a letter.

    A null text has none, a null id is written as nothing, rows that repeat count each.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = _shifts()
        counted: dict[bytes, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counted], pa.string()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])

        def parts() -> Iterator[tuple[list, list[str]]]:
            ids, texts, size = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(doc_id)
                    texts.append(text.as_py())
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield ids, texts
                        ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        for ids, texts in parts():
            words, n, lost = _runs(ids, texts, shifts, slip)
            for word, times in zip(words, n.tolist(), strict=True):
                if times:
                    counted[word] = counted.get(word, 0) + times
            for word in lost:
                counted[word] = counted.get(word, 0) + 1
            if len(counted) >= COUNTED:
                yield told()
                counted.clear()
        yield told()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(emit, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words in Latin-1, two marks before and behind each, and where each begins."""
    stored = [w.encode("latin-1") for w in words.to_pylist()]
    data = np.frombuffer(b"\0\0" + b"\0\0\0\0".join(stored) + b"\0\0", np.uint8)
    starts = np.cumsum([0, *[len(w) + 4 for w in stored]])
    return data, starts


def _grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of all words one behind the other: code, word, place in the word."""
    code = _CODE[data]
    codes = (code[:-2] * 91 + code[1:-1]) * 91 + code[2:]
    each = np.diff(starts) - 2
    word = np.repeat(np.arange(len(each)), each)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return codes[starts[:-1][word] + place], word, place


def gram_counts(words: DataFrame) -> np.ndarray:
    """In how many places of all words each gram stands, by its code. There are no more than GRAMS of them, however many words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            total += np.bincount(_grams(*_letters(batch.column(0)))[0], minlength=GRAMS) if batch.num_rows else 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    found = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAMS, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def _mixed(*values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values[0]), np.uint64)
    for value in values:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + value.astype(np.int64).view(np.uint64) + np.uint64(1))
    return out


def index_rows(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, n) -> (key, asks, word, n): a word in the parts of the index of its rarest grams, and where it asks for words a letter longer."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = _letters(batch.column(0))
            codes, word, place = _grams(data, starts)
            order = np.lexsort((place, codes, shared.value[codes], word))
            nth = np.arange(len(order)) - (starts[:-1] - 2 * np.arange(batch.num_rows))[word[order]]
            rare = order[nth <= Q]
            code, at, of = codes[rare], place[rare], word[rare]
            length = (np.diff(starts) - 4)[of]
            keys = [_mixed(code, at, length), _mixed(code, at, length + 1), _mixed(code, at + 1, length + 1)]
            for asks, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), asks > 0)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], ["key", "asks", "word", "n"])

    # A gram that stands twice in a word may ask twice in one place.
    return words.select("word", "n").mapInArrow(emit, "key long, asks boolean, word string, n long").distinct()


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _meet(rows: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows (key, chunk, asks, word, n) of whole parts -> pairs of rows whose words are near.

    Within a part rows that do not ask are the index, and ask for words of their own length behind them.
    """
    data, starts = _letters(rows.column(3))
    codes, row, place = _grams(data, starts)
    part = _mixed(rows.column(0).to_numpy(), rows.column(1).to_numpy()).view(np.int64)
    asks = rows.column(2).to_numpy(zero_copy_only=False)
    letters = np.diff(starts) - 4
    stored = _mixed(part[row], codes, place)
    indexed = np.flatnonzero(~asks[row])
    indexed = indexed[np.lexsort((row[indexed], stored[indexed]))]
    keys, posted = stored[indexed], row[indexed]

    def lists(at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        sought = _mixed(part[row[at]], codes[at], place[at] + step)
        return np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")

    words = rows.column(3).to_pylist()
    for longer in (False, True):
        at = np.flatnonzero(asks[row] == longer)
        spans = [lists(at, step) for step in range(1 + longer)]
        sizes = sum(hi - lo for lo, hi in spans)
        # The bound is max - 1 shared grams, so that the Q + 1 shortest lists hold everyone who reaches it.
        order = np.lexsort((sizes, row[at]))
        own = row[at][order]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        # A row of the index is in its lists itself: who else is there stands behind it.
        short = order[(nth <= Q) & (sizes[order] > (0 if longer else 1))]
        pairs: list[tuple[int, int]] = []
        for asker, group in groupby(short.tolist(), key=lambda k: int(row[at[k]])):
            merged = heapq.merge(*[posted[lo[k] : hi[k]].tolist() for k in group for lo, hi in spans if hi[k] > lo[k]])
            pairs += [(asker, other) for other, _ in groupby(merged) if longer or other > asker]
        for lo in range(0, len(pairs), PAIRS):
            some = np.array(pairs[lo : lo + PAIRS])
            enough = _shared(data, starts, letters, some[:, 0], some[:, 1]) >= letters[some[:, 1]] - 1
            yield from ((a, b) for a, b in some[enough].tolist() if near(words[a], words[b]))


def _shared(data: np.ndarray, starts: np.ndarray, letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The grams that the words of pairs share in places that one edit allows: the same, or one on where b is a letter longer. A gram of a counts once."""
    size = letters[a] + 4
    ends = np.cumsum(size)
    pair = np.repeat(np.arange(len(a)), size)
    nth = np.arange(ends[-1]) - (ends - size)[pair]
    own, other = data[starts[a][pair] + nth], starts[b][pair] + nth
    same = own == data[other]
    moved = (own == data[np.minimum(other + 1, len(data) - 1)]) & (letters[b] > letters[a])[pair]
    begins = nth[:-2] < (size - 2)[pair[:-2]]
    grams = begins & (same[:-2] & same[1:-1] & same[2:] | moved[:-2] & moved[1:-1] & moved[2:])
    return np.bincount(pair[:-2][grams], minlength=len(a))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words of Latin-1 letters in lower case -> (a, a_n, b, b_n), each pair of near words once, in no order."""
    rows = written(index_rows(words, gram_counts(words)), "grams")
    sizes = rows.filter(~F.col("asks")).groupBy("key").agg(F.count("*").alias("_size")).filter(F.col("_size") > PART)
    # Words of a part that is too large go to one of its chunks as the index and to all of them asking, the latter for those behind them.
    chunks = F.ceil(F.coalesce("_size", F.lit(1)) / PART).cast("int")
    split = rows.join(sizes, "key", "left").withColumns({"_of": chunks, "_own": F.pmod(F.xxhash64("word"), chunks).cast("int")})
    placed = split.select("key", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("_of") - 1)).otherwise(F.array("_own"))).alias("chunk"), "asks", "word", "n")
    equal = split.filter("NOT asks AND _of > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("chunk"), "_own", "word", "n").filter("chunk > _own")
    dealt = placed.unionByName(equal.select("key", "chunk", F.lit(True).alias("asks"), "word", "n"))
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "asks", "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_parts(batches):
            found = list(_meet(rows))
            a, b = (pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([rows.column(3).take(a), rows.column(4).take(a), rows.column(3).take(b), rows.column(4).take(b)], ["a", "a_n", "b", "b_n"])

    found = dealt.mapInArrow(search, "a string, a_n long, b string, b_n long")
    swapped = F.col("a") > F.col("b")
    ends = {c: F.when(swapped, F.col(o)).otherwise(F.col(c)) for c, o in (("a", "b"), ("a_n", "b_n"), ("b", "a"), ("b_n", "a_n"))}
    return found.select(*[c.alias(name) for name, c in ends.items()]).distinct()


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part in batches of about ROWS that hold parts whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, chunk = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        changes = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.RecordBatch.from_arrays([c for c in rows.slice(0, cut).columns], names=rows.schema.names)
            rows = rows.slice(cut)
        held, n = [rows], rows.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last form that following them leads to. Forms lead to ever more frequent words, never in a ring.

    Each round halves what is left of every chain, so that rounds grow with the logarithm of the longest one.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        # Chains that have reached their end have no next.
        further = written(reached.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if further.filter("_moved").isEmpty():
            return further.select("word", "root")
        reached = further.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n): each word's most frequent near word (ties: the first in code-point order), if it is
    ``times`` as frequent or more, where forms lead to, and how many near words it has. Without words there is no row."""
    words = written(words, "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("_n"), F.col("b").alias("_near"), F.col("b_n").alias("_near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("_n"), F.col("a").alias("_near"), F.col("a_n").alias("_near_n"))
    )
    best = both.groupBy("word", "_n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_near_n")).alias("_less"), "_near")).alias("_best"))
    has = -F.col("_best._less") >= times * F.col("_n")
    hung = written(best.select("word", "n_near", F.when(has, F.col("_best._near")).alias("form"), F.when(has, -F.col("_best._less")).alias("form_n")), "forms")
    out = words.join(hung, "word", "left").join(roots(hung.filter(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, slip: int = SLIP, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(doc_id, text) -> the variants of its words of at least ``shortest`` letters that occur ``least`` times or more.

    Null and empty texts have no words, a null id is written as nothing, rows that repeat count each, and other columns are
    not looked at. Texts and words may be of any length.
    """
    return variants(word_counts(docs, slip).filter((F.length("word") >= shortest) & (F.col("n") >= least)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants in all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
