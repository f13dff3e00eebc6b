"""SimHash fingerprints and near-duplicate groups over pivot distance tables.

The table holds each fingerprint's Hamming distances to reference fingerprints
(pivots).  Two fingerprints that differ in d bits have distances to any pivot that
differ by d at most, so a pair whose largest coordinate difference exceeds d is
discarded; what is left is verified on the fingerprints.

Pivots come as pairs: a random one, and the same with one band of bits turned.  The
difference of the two distances depends on that band alone.  Two fingerprints that
differ in d bits agree on all coordinates of at least (bands - d) bands, so equal
coordinates of so many bands form the blocks in which pairs are looked at.

A large block is parted by plain coordinates as well: a fingerprint looks into its
own cell of a few coordinates and into those that a difference of d reaches, and every
pair within d bits meets in a cell.  What is dense even then, many fingerprints within
a few bits of each other, no pivot can part: there links come from shared one-bit
neighbours, which is exact too, and work in proportion to the cell.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Bands of 16 bits, pivot pairs for each band, and pivots whose plain distances make the filter's coordinates.
BANDS, PER_BAND, FILTER = 4, 8, 8
#: Fingerprints of a block or cell that are compared in pairs; larger blocks are parted into cells.
PAIR_BLOCK = 128
#: Coordinates that part a large block, and how many distances share a cell: a reach of 2 both ways meets two cells at most.
PARTING, CELL = 4, 5


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included.

    A-Z are lower-cased; words are what stands between ASCII white space.  Fewer
    words than ``size`` make one shingle of all; no words make none.
    """
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; signed 64-bit."""
    n, set_ = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_ > n) if n else np.zeros(8, np.uint8)
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = 3) -> DataFrame:
    """``keep`` with ``fp`` of every whole text; no words: 0."""
    names = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.col(text).alias("_text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(v.as_py(), size)) for v in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps, pa.int64())], names=[*names, "fp"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[: len(names)])
    return df.mapInArrow(mark, kinds + "fp long").select(*[F.col(a).alias(c) for c, a in zip(keep, names)], "fp")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(seed: int = 7) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each band the pivot pairs, and the filter's pivots."""
    draw = random.Random(seed)
    width = 64 // BANDS
    pairs = []
    for band in range(BANDS):
        mask = ((1 << width) - 1) << (band * width)
        first = [draw.getrandbits(64) for _ in range(PER_BAND)]
        pairs.append([(_signed(p), _signed(p ^ mask)) for p in first])
    return pairs, [_signed(draw.getrandbits(64)) for _ in range(FILTER)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot).cast("long")))


def pivot_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp`` with ``coords`` (distances to the filter's pivots) and ``blocks``: for
    each choice of (BANDS - max_bits) bands a key of their coordinates."""
    pairs, plain = pivots()
    fp = F.col("fp")
    diffs = [[_distance(fp, a) - _distance(fp, b) for a, b in band] for band in pairs]
    keys = [F.xxhash64(F.lit(i), *[c for b in chosen for c in diffs[b]]) for i, chosen in enumerate(combinations(range(BANDS), BANDS - max_bits))]
    return fps.select("fp", F.array(*[_distance(fp, p) for p in plain]).alias("coords"), F.array(*keys).alias("blocks"))


def _near(max_bits: int) -> Column:
    """Survives the pivots: no coordinate differs by more; then the check itself."""
    passes = F.lit(True)
    for i in range(FILTER):
        passes = passes & (F.abs(F.col("x.coords")[i] - F.col("y.coords")[i]) <= max_bits)
    return passes & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)


def _flips(fp: Column) -> Column:
    """The fingerprint and its 64 one-bit neighbours."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)])


def _cells(block: Column, coords: Column, max_bits: int) -> Column:
    """Keys of the cells that a fingerprint looks into: its own, and those of all
    coordinates up to ``max_bits`` larger.  Of two fingerprints within ``max_bits`` one
    may be larger in one coordinate and smaller in another, so both sides look: in each
    coordinate the reach covers both directions."""

    def further(keys: Column, reach: Column) -> Column:
        return F.flatten(F.transform(keys, lambda k: F.transform(reach, lambda c: F.xxhash64(k, c))))

    keys = F.array(block)
    for i in range(PARTING):
        keys = further(keys, F.array_distinct(F.array(F.floor((coords[i] - max_bits) / CELL), F.floor((coords[i] + max_bits) / CELL))))
    return keys


def _cell(block: Column, coords: Column) -> Column:
    key = block
    for i in range(PARTING):
        key = F.xxhash64(key, F.floor(coords[i] / CELL))
    return key


def _pairs(seekers: DataFrame, members: DataFrame, max_bits: int) -> DataFrame:
    near = seekers.alias("x").join(members.alias("y"), "block").where(F.col("x.fp") < F.col("y.fp")).where(_near(max_bits))
    return near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """(a, b) of fingerprints that connect all pairs within ``max_bits`` (1 or 2):
    every such pair is linked or joined by links."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    blocks = scratch.cut(pivot_table(fps.select("fp").distinct(), max_bits).select("fp", "coords", F.explode("blocks").alias("block")))
    sizes = scratch.cut(blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"))
    small = blocks.join(sizes.where(F.col("n") <= PAIR_BLOCK).select("block"), "block")
    pairs = _pairs(small, small, max_bits)
    if not sizes.where(F.col("n") > PAIR_BLOCK).limit(1).count():
        return pairs
    large = scratch.cut(blocks.join(sizes.where(F.col("n") > PAIR_BLOCK).select("block"), "block"))
    homes = scratch.cut(large.select("fp", "coords", _cell(F.col("block"), F.col("coords")).alias("block")))
    seekers = large.select("fp", "coords", F.explode(_cells(F.col("block"), F.col("coords"), max_bits)).alias("block"))
    held = scratch.cut(homes.groupBy("block").agg(F.count("*").alias("n")))
    parted = held.where(F.col("n") <= PAIR_BLOCK).select("block")
    pairs = pairs.unionByName(_pairs(seekers.join(parted, "block"), homes.join(parted, "block"), max_bits))
    # Dense cells: their own fingerprints and all that look into them.
    dense = held.where(F.col("n") > PAIR_BLOCK).select("block")
    if not dense.limit(1).count():
        return pairs.distinct()
    crowd = seekers.join(dense, "block").select("fp").distinct()
    met = crowd.select("fp", F.explode(_flips(F.col("fp"))).alias("z"))
    if max_bits == 2:  # two fingerprints share a neighbour, or are one, just if they differ in 2 bits at most
        hubs = met.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
        starred = met.join(hubs, "z").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    else:
        starred = met.join(crowd.withColumnRenamed("fp", "b"), F.col("z") == F.col("b")).where(F.col("fp") < F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """``key``, ``fp`` and ``component``: the smallest key reachable over links of at
    most ``max_bits`` differing bits, the document's own included.

    Equal fingerprints are one node whatever their number.  A null or empty text has
    fingerprint 0 and is linked like any other.  Rows may repeat; null keys never are
    the smallest unless a component has no other (then it is null).  An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.cut(fingerprints(docs, keep=(key,), text=text, size=size).withColumnRenamed(key, "k"))
    nodes = scratch.cut(marked.groupBy("fp").agg(F.min("k").alias("least")))
    found = components(links(nodes, max_bits, scratch), scratch)
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only fingerprints that have links change; the others are their own components.
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.cut(rooted.join(smallest, "root").select("fp", "component"))
    return marked.join(named, "fp").select(F.col("k").alias(key), "fp", "component")
