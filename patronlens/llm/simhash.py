"""SimHash near-duplicates: exact comparison of fingerprints in tiles.

A fingerprint is cut into radius + 1 parts. Two fingerprints within the radius are equal in one part at
least, so only fingerprints of a block, those of one equal part, are compared. A block of up to ``TILE_ROWS``
is one tile. A larger one is cut by bit counts of four 16-bit words: two fingerprints within the radius
have counts that differ, summed over the words, by the radius at most; so a tile, which holds fingerprints
of equal bit counts, is compared only with tiles whose counts are that close. Inside a pair of tiles
numpy compares everything: exclusive-or and a count of bits, no candidate is left out.

Nulls: a null text is empty; empty texts have fingerprint zero and link like any other. A null id
takes part but never names a component unless all ids of the component are null. Rows with the
same id are separate rows. Other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.llm.components import connected_components
from patronlens.llm.store import forget, keep
from patronlens.llm.text import blank_words, utf8_values

SHINGLE = 3
RADIUS = 2
SEED = 42
WORDS, WORD_BITS = 4, 16
TILE_ROWS = 2048
VISITOR_ROWS = 512

# Byte value to eight byte-wide lanes, each 0 or 1, so that one addition counts eight bits.
LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).view(np.uint64).ravel()


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    words = blank_words(data)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)] if words else []
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """One bit where more than half of the hashes have one."""
    if not len(hashes):
        return 0
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    blocks = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)  # a lane holds 255 at most
    counts = blocks.view(np.uint8).reshape(len(blocks), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_column``, ``hash`` of the text, and ``bits``, the 64-bit fingerprint as a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [majority_bits(shingle_hashes(t, shingle)) for t in utf8_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.int64())], ["id", "hash", "bits"])

    text = F.col(text_column).cast("string")
    source = docs.select(F.col(id_column).alias("id"), text.alias("t"), F.xxhash64(text).alias("hash"))
    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("hash", T.LongType()), T.StructField("bits", T.LongType())]
    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_column)


def _counts() -> list:
    parts = [F.shiftrightunsigned("bits", WORD_BITS * i).bitwiseAND((1 << WORD_BITS) - 1) for i in range(WORDS)]
    return [F.bit_count(p).cast("long") for p in parts]


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of bit counts within the radius; of each and its opposite only one."""
    zero = (0,) * WORDS
    around = product(range(-radius, radius + 1), repeat=WORDS)
    return [d for d in around if d > zero and sum(map(abs, d)) <= radius]


def _cell(counts) -> F.Column:
    return sum((c * (32**i) for i, c in enumerate(counts)), F.lit(0).cast("long"))


def blocks(prints: DataFrame, radius: int) -> DataFrame:
    """``bits, block``: every fingerprint under each of its radius + 1 parts; two within the radius share a block."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << hi - lo) - 1 if hi - lo < 64 else -1 for lo, hi in zip(cuts, cuts[1:])]
    # The hash of a part and its number; two parts under one hash would only be compared in vain.
    parts = [F.xxhash64(F.lit(i), F.shiftrightunsigned("bits", lo).bitwiseAND(F.lit(mask))) for i, (lo, mask) in enumerate(zip(cuts, masks))]
    return prints.select("bits", F.explode(F.array(*parts)).alias("block"))


def large_blocks(prints: DataFrame, radius: int) -> DataFrame:
    """``block`` of more than ``TILE_ROWS`` fingerprints."""
    return blocks(prints, radius).groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_ROWS).select("block")


def tiles(prints: DataFrame, radius: int, large: DataFrame) -> DataFrame:
    """``tile, role, bits``: what every tile holds (role 0) and what visits it (role 1)."""
    parted = blocks(prints, radius)
    small = parted.join(large, "block", "left_anti").select(F.xxhash64("block").alias("tile"), F.lit(0).alias("role"), "bits")
    placed = parted.join(large, "block").withColumn("counts", F.array(*_counts()))
    counts = [F.col("counts")[i] for i in range(WORDS)]
    placed = placed.select("bits", "block", "counts", _cell(counts).alias("cell"))
    # Rows of large blocks only, at most 17 ** 4 cells each.
    cells = placed.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("tiles"))
    homes = placed.join(cells, ["block", "cell"]).withColumn("number", F.pmod(F.xxhash64("bits"), "tiles"))
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _steps(radius)]).cast("array<array<long>>")
    moved = placed.select("bits", "block", "counts", F.explode(steps).alias("step"))
    target = [F.col("counts")[i] + F.col("step")[i] for i in range(WORDS)]
    inside = F.least(*target) >= 0, F.greatest(*target) <= WORD_BITS
    visits = moved.where(inside[0] & inside[1]).select("bits", "block", _cell(target).alias("cell"))
    visitors = visits.join(cells, ["block", "cell"]).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # Later tiles of the own cell.
    further = homes.where("number + 1 < tiles").withColumn("number", F.explode(F.sequence(F.col("number") + 1, F.col("tiles") - 1)))
    tile = F.xxhash64("block", "cell", F.col("number").cast("long")).alias("tile")
    held = homes.select(tile, F.lit(0).alias("role"), "bits")
    visiting = [df.select(tile, F.lit(1).alias("role"), "bits") for df in (visitors, further)]
    return small.unionByName(held).unionByName(visiting[0]).unionByName(visiting[1])


def _pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items is linked to, over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = np.minimum(new, new[root])
        if np.array_equal(new, root):
            break
        root = new
    return root


class _Tile:
    """The fingerprints of one tile; links come out as a forest, so that a dense tile stays small."""

    def __init__(self, radius: int):
        self.radius = radius
        self.parts: list[np.ndarray] = []
        self.bits = None
        self.root = None

    def close(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.bits is not None:
            return []
        self.bits = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint64)
        found = []
        for start in range(0, len(self.bits), VISITOR_ROWS):
            a, b = _pairs(self.bits[start : start + VISITOR_ROWS], self.bits[start:], self.radius)
            found.append((a[a < b] + start, b[a < b] + start))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
        self.root = _roots(len(self.bits), a, b)
        moved = np.nonzero(self.root != np.arange(len(self.bits)))[0]
        return [(self.bits[moved], self.bits[self.root[moved]])] if len(moved) else []

    def visit(self, bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for start in range(0, len(bits), VISITOR_ROWS):
            some = bits[start : start + VISITOR_ROWS]
            v, h = _pairs(some, self.bits, self.radius)
            if len(v):
                v, h = np.divmod(np.unique(v * len(self.bits) + self.root[h]), len(self.bits))
                out.append((some[v], self.bits[h]))
        return out


def compare_tiles(radius: int):
    """Links between fingerprints of a tile and of its visitors, for rows sorted by tile and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            keys, role, bits = (batch.column(i).to_numpy() for i in range(3))
            if not len(keys):
                continue
            bits = bits.view(np.uint64)
            new_key = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
            change = new_key.copy()
            change[1:-1] |= role[1:] != role[:-1]
            cuts = np.nonzero(change)[0]
            # A row that is alone in its tile meets nothing; at the ends of a batch its tile may go on.
            alone = new_key[cuts[:-1]] & new_key[cuts[1:]] & (np.diff(cuts) == 1)
            alone[[0, -1]] = False
            links = []
            for lo, hi in zip(cuts[:-1][~alone].tolist(), cuts[1:][~alone].tolist()):
                if keys[lo] != key:
                    links += tile.close() if tile else []
                    key, tile = keys[lo], _Tile(radius)
                if role[lo] == 0:
                    tile.parts.append(bits[lo:hi])
                else:
                    links += tile.close() + tile.visit(bits[lo:hi])
            yield from _batch(links)
        if tile:
            yield from _batch(tile.close())

    return run


def _batch(links: list) -> Iterator[pa.RecordBatch]:
    if links:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])


def links(prints: DataFrame, radius: int = RADIUS, large: DataFrame | None = None) -> DataFrame:
    """``src, dst``: links between distinct ``bits``, enough of them to connect all that are within the radius.

    ``large`` may bring the large blocks, already written.
    """
    placed = tiles(prints, radius, large_blocks(prints, radius) if large is None else large)
    return placed.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(compare_tiles(radius), "src long, dst long")


def _classes(printed: DataFrame, least: F.Column, radius: int) -> DataFrame:
    """``bits, least`` of every fingerprint: the minimum of ``least`` over the rows of its component."""
    spark = printed.sparkSession
    distinct, distinct_path = keep(printed.groupBy("bits").agg(F.min(least).alias("least")), "distinct")
    large, large_path = keep(large_blocks(distinct.select("bits"), radius), "blocks")
    linked, linked_path = keep(links(distinct.select("bits"), radius, large), "links")
    roots, roots_path = connected_components(linked)
    named = roots.join(distinct, roots.node == distinct.bits).groupBy("component").agg(F.min("least").alias("least"))
    member = roots.join(named, "component").select(F.col("node").alias("bits"), F.col("least").alias("joined"))
    classes, _ = keep(distinct.join(member, "bits", "left").select("bits", F.coalesce("joined", "least").alias("least")), "classes")
    forget(spark, distinct_path, large_path, linked_path, roots_path)
    return classes


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """``id_column, bits, component_id`` of every row; the component is named by its smallest id."""
    printed, _ = keep(fingerprints(docs, id_column, text_column, shingle), "prints")
    classes = _classes(printed, F.col(id_column), radius).withColumnRenamed("least", "component_id")
    return printed.join(classes, "bits", "left").select(id_column, "bits", "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row of each component, that of the smallest id; rows without an id come last, and of equal ids the hash of the text decides.

    Every row is judged by its own text, so rows that share an id or have none are dropped like any others.
    """
    printed, _ = keep(fingerprints(docs, id_column, text_column, shingle), "prints")
    first = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("hash").alias("hash"))
    kept, _ = keep(_classes(printed, first, radius).select("least.id", "least.hash").distinct(), "kept")
    again = printed.groupBy(F.col(id_column).alias("id"), "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again, _ = keep(again.join(kept, again.id.eqNullSafe(kept.id) & (again.hash == kept.hash), "left_semi").select("id", "hash"), "again")
    hashed = F.xxhash64(docs[text_column].cast("string"))
    same = docs[id_column].eqNullSafe(kept.id) & (hashed == kept.hash)
    once = docs.join(kept, same, "left_semi")
    if again.isEmpty():
        return once
    # Rows that are equal in id and text: any one of them stays.
    same = docs[id_column].eqNullSafe(again.id) & (hashed == again.hash)
    turn = F.row_number().over(Window.partitionBy(id_column, F.xxhash64(F.col(text_column).cast("string"))).orderBy(text_column))
    repeated = docs.join(again, same, "left_semi").withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    return once.join(again, same, "left_anti").unionByName(repeated)


def hex_digits(bits: str = "bits") -> F.Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")
