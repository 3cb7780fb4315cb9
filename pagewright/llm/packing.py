"""Best-fit packing of tokenised documents, improved by swap-based local search."""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import table, written

SEQUENCE = 2048
END_ID = 0
#: Pieces that one task packs together; more than this and the pieces are dealt to more groups.
GROUP = 4096
#: Underfull sequences are packed anew as long as a round has filled those of one piece in so many.
WORTH = 8
TOKENIZER = "word_bpe_49k.json"
#: Words that a task, and parts of words that a worker remembers with their ids, and the longest that they remember.
REMEMBERED, PARTS, LONG_WORD = 400_000, 300_000, 64
#: str.split() without an argument would also split at characters that the tokenizer keeps.
_SPACES = "\t\n\r\x0b\x0c"


class Ids(dict):
    """A dictionary that asks ``find`` for what it lacks, and forgets all when it is full."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most = find, most

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[text] = found
        return found


class WordIds:
    """The ids of texts as bytes (little-endian unsigned 32-bit), as the tokenizer by default gives them; words and their parts
    are asked of it once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row. A word of
    common Latin characters, on which its normalisation is lower case alone, is split into the tokenizer's parts here, for
    most parts occur in many words; any other word goes through the whole tokenizer.
    """

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        parsed = json.loads(description)
        # Texts that hold one of these are split at it before anything else.
        added = parsed.get("added_tokens") or []
        self.added, self.added_lower = ([t["content"] for t in added if t["normalized"] == n] for n in (False, True))
        pre = parsed["pre_tokenizer"]
        steps = pre["pretokenizers"] if pre and pre["type"] == "Sequence" else []
        self.parts = None
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and not steps[1]["use_regex"]:
            self.parts = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.bytes = _byte_characters()
        # Whether the rule takes letters, of which no shorter part is made, as one.
        self.letters = self.parts is not None and self.parts("Straßeté") == ["Straßeté"]
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.part_ids, self.word_ids = Ids(self._of_part, PARTS), Ids(self._of_word, REMEMBERED)

    @classmethod
    def of_worker(cls, description: str) -> WordIds:
        """The one of this process, which outlives a task; the words of the last task are forgotten."""
        held = cls.__dict__.get("_held")
        if held is None or held[0] != description:
            cls._held = held = (description, cls(description))
        held[1].word_ids.clear()
        return held[1]

    def _of_part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes)
        return b"".join([self.packed[t.id] for t in self.tokenize(mapped)])

    def _of_word(self, word: str) -> bytes:
        if self.parts and _SIMPLE(word):
            lower = word.lower()
            # Letters alone are one part.
            return self.part_ids[lower] if self.letters and lower.isalpha() else b"".join(map(self.part_ids.__getitem__, self.parts(lower)))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if any(t in text for t in self.added) or (self.added_lower and any(t in text.lower() for t in self.added_lower)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for space in _SPACES:
            text = text.replace(space, " ")
        return b"".join(map(self.word_ids.__getitem__, text.split(" ")))


#: Visible ASCII, and Latin letters that lower case takes one for one.
_SIMPLE = re.compile("[!-~¡-¬®-į]+").fullmatch


def _byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself where visible, else the next free one from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32): the ids of each document and the end id, cut where too long.

    A null or empty text is the end id alone.
    """

    # The file is read by the driver, since executors need not have it; vocabularies are a few MB.
    description = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.of_worker(description.value)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(ids.of(text.as_py() or "") + end)
                for piece, at in enumerate(range(0, len(data), 4 * sequence)):
                    part = data[at : at + 4 * sequence]
                    for name, value in zip(NAMES, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, PIECES)
        ids.word_ids.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
NAMES = PIECES.names


def best_fit(lengths: list[int], sequence: int = SEQUENCE) -> list[list[int]]:
    """Pieces in decreasing order, each into the fullest sequence with room for it, the earliest among equals."""
    bins: list[list[int]] = []
    with_free: list[list[int]] = [[] for _ in range(sequence + 1)]
    mask = 0  # bit f is set if a sequence has f tokens free
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = mask >> lengths[item]
        if fits:
            free = lengths[item] + (fits & -fits).bit_length() - 1
            b = heapq.heappop(with_free[free])
            if not with_free[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(bins), sequence
            bins.append([])
        bins[b].append(item)
        heapq.heappush(with_free[free - lengths[item]], b)
        mask |= 1 << (free - lengths[item])
    return bins


class Pool:
    """The sequences that pieces may be taken from: for each length, and each sum of two lengths, those that have it."""

    def __init__(self) -> None:
        self.having: tuple[dict[int, set[int]], dict[int, set[int]]] = (defaultdict(set), defaultdict(set))
        self.mask = [0, 0]  # bit n is set if a sequence has one piece, or two pieces, of n tokens

    def add(self, b: int, stock: dict[int, list[int]]) -> None:
        for kind, sums in enumerate((stock, _pairs(stock))):
            for n in sums:
                self.having[kind][n].add(b)
                self.mask[kind] |= 1 << n

    def remove(self, b: int, stock: dict[int, list[int]]) -> None:
        for kind, sums in enumerate((stock, _pairs(stock))):
            for n in sums:
                self.having[kind][n].discard(b)
                if not self.having[kind][n]:
                    self.mask[kind] &= ~(1 << n)

    def largest(self, kind: int, most: int) -> int:
        """The largest length, or sum, of ``most`` at most; -1 if there is none."""
        return (self.mask[kind] & ((1 << (most + 1)) - 1)).bit_length() - 1


def _pairs(stock: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Sum -> two lengths of a sequence's pieces that make it up. It has few distinct lengths, for they add up to its tokens."""
    different = sorted(stock)
    return {x + y: (x, y) for i, x in enumerate(different) for y in different[i:] if x < y or len(stock[x]) > 1}


def _exchange(pool: Pool, stock: dict[int, list[int]], free: int) -> tuple[int, tuple[int, ...], int, int] | None:
    """The exchange that fills a sequence most: (tokens gained, lengths that it gives, 0 or 1 for one or two pieces that it gets, their tokens)."""
    best = None
    ones = [(0, ())] + [(n, (n,)) for n in stock]
    for kind, given in ((0, ones), (0, _pairs(stock).items()), (1, ones)):
        for out, lengths in given:
            got = pool.largest(kind, out + free)
            if got > out and (best is None or got - out > best[0]):
                best = (got - out, lengths, kind, got)
                if best[0] == free:
                    return best
    return best


def improve(bins: list[list[int]], lengths: list[int], sequence: int = SEQUENCE) -> list[list[int]]:
    """Local search: exchanges between two underfull sequences until none helps.

    A sequence takes a piece from an emptier one, or one for one, one for two, or two for one of its own, as long as it
    thereby becomes fuller; of all such exchanges with any emptier sequence the one that fills it most is made. The fullest is
    filled first. Each exchange moves tokens from an emptier to a fuller sequence, so that the sum of the squared fills grows
    and the search ends; sequences that lose their last piece are gone. Passes over all underfull sequences are repeated until
    one changes nothing.
    """
    stocks: list[dict[int, list[int]]] = []
    for items in bins:
        stock: dict[int, list[int]] = defaultdict(list)
        for i in items:
            stock[lengths[i]].append(i)
        stocks.append(stock)
    free = [sequence - sum(lengths[i] for i in items) for items in bins]
    changed = True
    while changed:
        changed = False
        pool, order = Pool(), sorted((b for b, stock in enumerate(stocks) if stock and free[b]), key=lambda b: (free[b], b))
        for b in order:
            pool.add(b, stocks[b])
        waiting = [(free[b], b) for b in order]
        heapq.heapify(waiting)
        while waiting:
            was, b = heapq.heappop(waiting)
            if was != free[b] or not stocks[b]:
                continue
            pool.remove(b, stocks[b])
            while free[b] and (found := _exchange(pool, stocks[b], free[b])):
                gained, out, kind, got = found
                other = max(pool.having[kind][got], key=lambda x: (free[x], x))
                into = _pairs(stocks[other])[got] if kind else (got,)
                pool.remove(other, stocks[other])
                moved = [(_take(stocks[b], n), b, other) for n in out] + [(_take(stocks[other], n), other, b) for n in into]
                for i, _, to in moved:
                    stocks[to][lengths[i]].append(i)
                free[b] -= gained
                free[other] += gained
                pool.add(other, stocks[other])
                heapq.heappush(waiting, (free[other], other))
                changed = True
    return [[i for items in stock.values() for i in items] for stock in stocks if stock]


def _take(stock: dict[int, list[int]], length: int) -> int:
    item = stock[length].pop()
    if not stock[length]:
        del stock[length]
    return item


def pack_group(lengths: list[int], sequence: int = SEQUENCE) -> list[int]:
    """The sequence of each piece, by best fit and local search. lengths: in the order in which ties shall fall."""
    where = [0] * len(lengths)
    for b, items in enumerate(improve(best_fit(lengths, sequence), lengths, sequence)):
        for i in items:
            where[i] = b
    return where


def _packed(df: DataFrame, groups: int, round_no: int, sequence: int) -> DataFrame:
    """One round: pieces are dealt to groups by a hash, each group is packed in one task."""

    def pack(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], na_position="last", ignore_index=True)
        frame["bin"] = pack_group(frame["length"].tolist(), sequence)
        inside = frame.groupby("bin")["length"]
        frame["offset"] = inside.cumsum() - frame["length"]
        frame["free"] = sequence - inside.transform("sum")
        frame["sequence_id"] = (round_no << 56) + (int(group[0]) << 24) + frame["bin"]
        return frame[[*NAMES, "sequence_id", "offset", "free"]]

    dealt = df.select(*NAMES, F.pmod(F.xxhash64(F.lit(round_no), "doc_id", "piece"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Full pieces are sequences of their own. The others are dealt evenly, by a hash, to groups of about ``group`` pieces;
    each is packed by one task. The pieces of sequences that are still underfull are dealt anew, to ever fewer groups,
    until one group holds them all or a round has filled the sequences of fewer than one piece in WORTH. Repeated rows, ids
    included, are packed as documents of their own. A text of any length is one document. Reruns pack
    alike; the ids of sequences are any numbers.
    """
    cut = written(pieces(docs, tokenizer_path, sequence), "pack-pieces")
    whole = cut.filter(F.col("length") == sequence).select(
        *NAMES, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done = [whole]
    left = cut.filter(F.col("length") < sequence)
    n, round_no = left.count(), 1
    while n:
        groups = -(-n // group)
        placed = written(_packed(left, groups, round_no, sequence), "pack-round")
        still = placed.filter("free > 0")
        m = still.count() if groups > 1 else 0
        if groups == 1 or WORTH * (n - m) < n:
            done.append(placed.drop("free"))
            break
        done.append(placed.filter("free = 0").drop("free"))
        left, n, round_no = still, m, round_no + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
