"""Near-duplicate join of documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

A set is sketched by cells: each shingle hash falls in one of k cells, and a cell holds the exclusive or of the hashes in
it. A shingle that only one of two sets has changes one cell, so the number of cells in which two sketches differ is at
most the size of the symmetric difference, and documents that link agree in at least k - d cells, d being the most by
which linked sets of their size band can differ. Documents that agree in a cell are candidates. A parity sketch of fixed
length, whose Hamming distance is a lower bound of the same kind, discards most false candidates; the sets themselves
decide on the rest.

Size bands: sets that link lie in the same band or in neighbouring ones. Each document takes part in two joins, of its band
with the one below and with the one above; k follows from the larger band's sizes.

Where k is small, all cells are emitted and the pigeonhole is certain: agreement in nothing but empty cells, the one case in
which two linked documents would not meet, sends both to a second join on prefixes of their sorted sets. Where k is larger
than CELLS, only the first CELLS of them are, a random part of the hash space: of two linked sets a cell agrees and is not
empty with probability 0.41 or more, so that they fail to meet with a probability below 1e-14, the order of a collision of
the hashes. What a document emits is thereby bounded, whatever its length.

Shingles of very many documents, such as a passage that many share, go to a cell of their own that is never emitted; the
pigeonhole still holds with one cell more. Documents that consist mostly of them are joined a second time with all their
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import table, written
from pagewright.llm.components import components
from pagewright.llm.shingles import mix64, shingle_hashes

#: Cells that a document emits for a join at most.
CELLS = 64
#: Cells for each shingle of difference: at this ratio a cell of linked documents is likeliest to agree and not be empty.
SPREAD = 2.16
#: Longs of the parity sketch.
PARITY_LONGS = 16
#: A shingle of so many different sets is common; the threshold doubles until MAX_COMMON shingles at most are.
COMMON, MAX_COMMON = 32, 262_144
#: Bits of the filter of candidate ids, a power of two: what is broadcast is at most this long.
MAX_FILTER_BITS = 1 << 26
#: Shingles of a block of sets, about; each block of a component is held against each.
BLOCK_SHINGLES = 1 << 19


def band_limits(most: int) -> np.ndarray:
    """The largest size of each band, up to one that holds ``most``: linked sets are in the same or in neighbouring bands."""
    limits = [1]
    while limits[-1] < most:
        limits.append((limits[-1] + 1) * 4 // 3)
    return np.array(limits)


_LIMITS = band_limits(1 << 40)


def join_cells(join: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each join, named by its upper band: the most that linked sets can differ, and the cells. Sets of up to 3 cannot differ."""
    differ = _LIMITS[join] * 2 // 7
    return differ, np.maximum(differ + 2, (differ * SPREAD).astype(np.int64))


def _cell(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell of each hash; the first cells hold the least hashes. Exact as long as there are fewer than 2 ** 32 cells."""
    return ((hashes >> np.uint64(32)) * cells.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, set_a, set_b, parity, least): the size of each set, two hashes of it, its parity sketch, and
    its hashes that fall in cells that can be emitted."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, a, b, parity, least = [], [], [], [], []
                for own in shingle_hashes(part.column(1)):
                    n.append(len(own))
                    a.append(np.bitwise_xor.reduce(own).view(np.int64) if len(own) else 0)
                    b.append(mix64(own).sum(dtype=np.uint64).view(np.int64) if len(own) else 0)
                    bits = np.bincount((own & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
                    parity.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                    cells = int(join_cells(np.searchsorted(_LIMITS, [len(own)]))[1][0])
                    least.append((own[: np.searchsorted(own, np.uint64(min((CELLS << 64) // cells + 1, 2**64 - 1)), "right")] if cells > CELLS else own).view(np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64())) for x in (parity, least)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *lists], ["doc_id", "n", "set_a", "set_b", "parity", "least"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sketch, "doc_id long, n long, set_a long, set_b long, parity array<long>, least array<long>"
    )


def common_shingles(sets: DataFrame) -> np.ndarray:
    """The hashes, sorted, of the shingles of so many sets that a cell with nothing else would join too many."""
    counts = sets.select(F.explode("least").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    counts = written(counts, "common")
    least = COMMON
    while counts.filter(F.col("n") >= least).count() > MAX_COMMON:
        least *= 2
    found = counts.filter(F.col("n") >= least).select("hash").toArrow().column("hash")
    return np.sort(found.to_numpy().view(np.uint64))


def cell_keys(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, n, least) -> (key, doc_id): what each set emits for its two joins."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                lengths = np.diff(part.column(2).offsets.to_numpy())
                hashes = part.column(2).flatten().to_numpy().view(np.uint64)
                yield from map(_batch, _keys(ids, n, hashes, np.repeat(np.arange(len(n)), lengths), common))

    return sets.select("doc_id", "n", "least").mapInArrow(emit, "key long, doc_id long")


def _batch(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1], pa.int64())], ["key", "doc_id"])


def _keys(ids: np.ndarray, n: np.ndarray, hashes: np.ndarray, of: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """of: the document of each hash; those of a document are sorted."""
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    is_common = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    own_band = np.searchsorted(_LIMITS, n)
    for join in (own_band, own_band + 1):
        differ, cells = join_cells(join)
        cell = _cell(hashes, cells[of])
        used = (cell < CELLS) & (differ[of] > 0)
        total, plain = np.bincount(of[used], minlength=len(n)), np.bincount(of[used & ~is_common], minlength=len(n))
        keys, docs = _cells(join, cell, hashes, of, used & ~is_common)
        yield keys, ids[docs]
        filled = np.bincount(docs, minlength=len(n))
        certain = cells <= CELLS
        # Mostly common shingles: all of them count in another join of such documents.
        mostly = ~certain & (2 * plain < total)
        keys, docs = _cells(join + 1_000, cell, hashes, of, used & mostly[of])
        yield keys, ids[docs]
        # So few cells filled that linked documents might agree in empty ones alone: the rarest of the set, as many as linked
        # sets cannot both do without.
        sparse = certain & (differ > 0) & (filled <= differ)
        chosen = np.flatnonzero(sparse[of])
        chosen = chosen[np.lexsort((hashes[chosen], is_common[chosen], of[chosen]))]
        first = np.searchsorted(of[chosen], np.arange(len(n)))
        prefix = np.arange(len(chosen)) - first[of[chosen]] <= n[of[chosen]] // 4
        chosen = chosen[prefix]
        yield mix64(hashes[chosen] ^ mix64(np.full(len(chosen), 2_000, np.uint64))), ids[of[chosen]]


def _cells(join: np.ndarray, cell: np.ndarray, hashes: np.ndarray, of: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each filled cell of each document, and the document."""
    cell, hashes, of = cell[used], hashes[used], of[used]
    if not len(cell):
        return hashes, of
    starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])))
    value = np.bitwise_xor.reduceat(hashes, starts)
    return mix64(value ^ mix64((join[of[starts]] * CELLS + cell[starts]).astype(np.uint64))), of[starts]


def _filter_bits(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap in which each id sets one bit; it is at most MAX_FILTER_BITS long."""
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(12, (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    set_bits = ids.select(slot.alias("slot")).selectExpr("cast(slot div 64 as int) AS word", "shiftleft(1L, cast(slot % 64 AS int)) AS bit")
    found = set_bits.groupBy("word").agg(F.bit_or("bit").alias("value")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("value").to_numpy()
    return bitmap, bits


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the documents with these ids; a bitmap keeps nearly all other texts out of the shuffle."""
    bitmap, bits = _filter_bits(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            asked = batch.filter(pa.array((bitmap[slot >> 6] >> (slot & 63)) & 1 == 1))
            for lo in range(0, asked.num_rows, 500):
                part = asked.slice(lo, 500)
                sets = [*shingle_hashes(part.column(1))]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "hashes"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    found = typed.select("doc_id", "text", slot.alias("slot")).mapInArrow(hashed, "doc_id long, hashes array<long>")
    return found.join(ids, "doc_id", "left_semi")


def _near(one: str, other: str) -> Column:
    """Sizes and parity sketches allow two sets to link. Hamming distance is a lower bound of their difference."""
    distance = reduce(add, [F.bit_count(F.col(f"{one}.parity")[i].bitwiseXOR(F.col(f"{other}.parity")[i])) for i in range(PARITY_LONGS)])
    n_one, n_other = F.col(f"{one}.n"), F.col(f"{other}.n")
    return (4 * F.least(n_one, n_other) >= 3 * F.greatest(n_one, n_other)) & (7 * distance <= n_one + n_other)


def _verify(near: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = written(_sets_of(docs, ids), "candidate-sets")
    met = near.join(full.withColumnsRenamed({"doc_id": "b", "hashes": "of_b"}), "b").join(full.withColumnsRenamed({"doc_id": "a", "hashes": "of_a"}), "a")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return met.filter(100 * shared >= 75 * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> (doc_id, n_shingles, set_a, set_b, component_id), one row for each document; the classes of equal sets,
    (n, set_a, set_b, of_class, size), of_class being the least id of the rows and size their number.

    Documents with equal sets are one class, joined once. Of the documents that meet in a cell, each is first held against the
    least only; documents that still are not in one component are then held against each other, so that no link between
    components is lost while a large group of copies costs one comparison a copy.
    """
    all_sets = written(sketches(docs), "sketches")
    classes = all_sets.filter("n > 0 and doc_id is not null").groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("of_class"), F.count("*").alias("size"))
    classes = written(classes, "class-sizes")
    member = all_sets.select("doc_id", "n", "set_a", "set_b").join(classes, ["n", "set_a", "set_b"], "left")
    member = written(member.select("doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b", F.coalesce("of_class", "doc_id").alias("of_class")), "classes")
    sets = written(all_sets.join(classes.select(F.col("of_class").alias("doc_id")).distinct(), "doc_id", "left_semi"), "class-sets")

    keys = cell_keys(sets, common_shingles(sets))
    group = Window.partitionBy("key")
    met = keys.withColumn("hub", F.min("doc_id").over(group)).withColumn("last", F.max("doc_id").over(group)).filter("hub < last")
    met = written(met.select("key", "doc_id", "hub"), "met")
    short = sets.select("doc_id", "n", "parity")
    pairs = met.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = pairs.join(short.alias("x"), F.col("a") == F.col("x.doc_id")).join(short.alias("y"), F.col("b") == F.col("y.doc_id")).filter(_near("x", "y"))
    links = written(_verify(written(near.select("a", "b"), "near-hubs"), docs), "links-to-hubs")
    found = written(components(links), "components")

    named = met.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    named = named.withColumns({"first": F.min("component").over(group), "last": F.max("component").over(group)}).filter("first < last").drop("last")
    apart = written(named.join(short, "doc_id"), "apart")
    # Of two documents in different components one at least is not in the first; sizes and sketches are part of the condition,
    # so that only pairs that are near leave the join.
    one, other = apart.filter("component <> first").alias("x"), apart.alias("y")
    once = (F.col("y.component") == F.col("y.first")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    rest = one.join(other, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & _near("x", "y"))
    rest = rest.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    more = written(_verify(written(rest, "near-others"), docs), "links-between")
    # Classes whose ids are shared by several rows hang together through the id.
    same_id = member.filter("doc_id <> of_class").select(F.col("of_class").alias("a"), F.col("doc_id").alias("b"))
    whole = components(links.unionByName(more).unionByName(same_id))
    out = member.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", "set_a", "set_b", F.coalesce("component", "doc_id").alias("component_id")), classes


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), one row for each document.

    component_id is the least doc_id reachable by links, itself included. Documents without words link with nothing. Rows
    without an id have no component. Rows that share an id are one node with the links of all.
    """
    return _joined(docs)[0].select("doc_id", "n_shingles", "component_id")


def _compared(docs: DataFrame, joined: DataFrame, classes: DataFrame, pairs: bool) -> DataFrame:
    """All linked pairs of classes (a, b), with size_a and size_b; or, without pairs, (of_class, n, set_a, set_b, linked): the documents
    of the classes that link with a class, as partial sums.

    All links are inside components: each class of a component is held against each other one of it, a block of sets against
    a block, so that no task has more than two blocks and no pair that does not link leaves it. Copies are not expanded.
    """
    of = joined.filter("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("of_class"), F.col("component_id").alias("component")).distinct()
    placed = written(classes.join(of, "of_class"), "placed-classes")
    several = placed.groupBy("component").agg(F.count("*").alias("n_classes"), F.sum("n").alias("shingles")).filter("n_classes > 1")
    blocks = several.select("component", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = written(placed.join(blocks, "component"), "classes-to-compare")
    sets = _sets_of(docs, placed.select(F.col("of_class").alias("doc_id")).distinct())
    # Rows that share an id have different sets: the right one has the size and the exclusive or of the class.
    sets = sets.select(F.col("doc_id").alias("of_class"), F.size("hashes").cast("long").alias("n"), F.aggregate("hashes", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias("set_a"), "hashes")
    full = placed.join(sets, ["of_class", "n", "set_a"]).dropDuplicates(["of_class", "n", "set_a", "set_b"])
    dealt = full.withColumn("block", F.pmod(F.xxhash64("of_class", "set_b"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    names = ["of_class", "n", "set_a", "set_b"]

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        n, size, block = rows["n"].to_numpy(), rows["size"].to_numpy(), rows["block"].to_numpy()
        values, ids = np.unique(np.concatenate(rows["hashes"].to_list()), return_inverse=True)
        ends = np.cumsum(n)
        mark = np.zeros(len(values), np.int32)
        linked, ones, others = np.zeros(len(n), np.int64), [], []
        for i in range(len(n)):
            # Larger sets, or those behind it, that sizes allow to link.
            last = int(np.searchsorted(4 * n[i + 1 :], 4 * n[i] * 4 // 3, "right")) + i + 1
            if last == i + 1:
                continue
            own = ids[ends[i] - n[i] : ends[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[ids[ends[i] : ends[last - 1]]], ends[i : last - 1] - ends[i], dtype=np.int64)
            mark[own] = 0
            links = 100 * shared >= 75 * (n[i] + n[i + 1 : last] - shared)
            if key[1] != key[2]:
                links &= block[i + 1 : last] != block[i]
            found = np.flatnonzero(links) + i + 1
            linked[i] += size[found].sum()
            linked[found] += size[i]
            if pairs:
                ones.append(np.full(len(found), i))
                others.append(found)
        if not pairs:
            return rows[names].assign(linked=linked)[linked > 0]
        one, other = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (ones, others))
        a, b, sizes = rows["of_class"].to_numpy()[one], rows["of_class"].to_numpy()[other], (size[one], size[other])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "size_a": np.where(a <= b, *sizes), "size_b": np.where(a <= b, *sizes[::-1])})

    schema = "a long, b long, size_a long, size_b long" if pairs else "of_class long, n long, set_a long, set_b long, linked long"
    return dealt.select("component", "low", "high", "block", "size", "hashes", *names).groupBy("component", "low", "high").applyInPandas(compare, schema)


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (a, b, size_a, size_b): the pairs of different sets that link, by the least ids that have them, and how many documents do."""
    return _compared(docs, *_shared(docs), pairs=True)


def join_counted(docs: DataFrame) -> DataFrame:
    """What join returns and n_links: the other rows with an id whose sets link with the row's own, equal ones included; none for rows without words or id."""
    joined, classes = _shared(docs)
    sums = _compared(docs, joined, classes, pairs=False).groupBy("of_class", "n", "set_a", "set_b").agg(F.sum("linked").alias("linked"))
    weights = classes.join(sums, ["of_class", "n", "set_a", "set_b"], "left").select(F.col("n").alias("n_shingles"), "set_a", "set_b", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = joined.join(weights, ["n_shingles", "set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def _shared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    joined, classes = _joined(docs)
    return written(joined, "joined"), classes


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose id is that of their component, and those without an id; all columns as they were, whatever their names."""
    others = join(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, docs["doc_id"] == others["_other"], "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_counted(table(spark, sf_dir, "documents"))
