"""SimHash near-duplicates by anchor-point covering.

``fingerprints`` hashes word shingles of whole texts. ``link`` finds every pair of distinct
fingerprints that differ in at most ``threshold`` bits:

* The anchors are the words of a covering code: the product of two perfect binary Golay codes
  [23, 12] on the low 46 bits. Each Golay code has covering radius 3, so every fingerprint has
  one home anchor, within 3 bits of it in each block.
* Let x and y differ in t1 and t2 bits of the blocks. Then y is within 3 + t1 and 3 + t2 of the
  home anchor of x, so y is replicated to every anchor within radius plus threshold, the
  threshold being shared by the blocks: 61 anchors of 16.8 million for two bits. x and y meet at
  the home of x, where the whole 64 bits are compared.
* A cell of more than ``CELL`` homes would compare a group of near copies all with all. Its
  visitors use the trivial covering code instead, all 64-bit words with radius 0: each is
  replicated to itself and its 64 neighbours. Two fingerprints differ in at most two bits if and
  only if they share such a word, and at most 65 can share one, so a star of each cell's members
  holds all links, whatever the size of the group. Only thresholds up to 2 are offered.

Groups are connected components of fingerprints; equal ones collapse first, so thousands of
exact copies cost one row. Null and empty texts have fingerprint zero and link like any other.
A null doc_id takes the group's id, and stays null in a group without ids; repeated rows give
repeated rows of one group; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import jaccard
from quillon.llm.common import connected_components, materialize
from quillon.llm.shingles import shingle_hashes

CELL = 32
BLOCK, RADIUS, BLOCKS = 23, 3, 2
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b101011100011


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    n, count = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[k : k + (1 << 14)].astype(">u8")).view(np.uint8)
        count += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and ``fp``, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fp = np.array([fingerprint(shingle_hashes(texts[i].as_py(), size)) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _remainders(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


class Cosets:
    """Error patterns of up to ``radius + threshold`` bits by syndrome and weight."""

    def __init__(self, threshold: int):
        errors = [(max(0, w - RADIUS), sum(1 << b for b in bits)) for w in range(RADIUS + threshold + 1) for bits in combinations(range(BLOCK), w)]
        excess, pattern = np.array([e for e, _ in errors]), np.array([p for _, p in errors], np.int64)
        syndrome = _remainders(pattern)
        order = np.lexsort((excess, syndrome))
        self.pattern, syndrome, excess = pattern[order], syndrome[order], excess[order]
        # upto[e][s]: where patterns of syndrome s with excess of at most e end; they start at first[s]
        self.first = np.searchsorted(syndrome, np.arange(2048))
        self.upto = [np.searchsorted(syndrome * 8 + excess, np.arange(2048) * 8 + e, side="right") for e in range(threshold + 1)]
        self.low = _remainders(np.arange(1 << 12))
        self.high = _remainders(np.arange(1 << 11) << 12)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row each element belongs to, and first[row] + 0, 1, ... size[row] - 1."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]


def anchors(fps: np.ndarray, code: Cosets, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: every anchor within radius plus threshold of each fingerprint."""
    word = [(fps >> (BLOCK * b)) & ((1 << BLOCK) - 1) for b in range(BLOCKS)]
    s = [code.syndrome(w) for w in word]
    rows, found = [], []
    for e in range(threshold + 1):
        begin = code.first[s[0]] if e == 0 else code.upto[e - 1][s[0]]
        r, i = _ranges(begin, code.upto[e][s[0]] - begin)
        left = word[0][r] ^ code.pattern[i]
        again, j = _ranges(code.first[s[1]][r], (code.upto[threshold - e][s[1]] - code.first[s[1]])[r])
        right = word[1][r][again] ^ code.pattern[j]
        rows.append(r[again])
        found.append(left[again] | right << BLOCK)
    return np.concatenate(rows), np.concatenate(found)


def _covered(fps: DataFrame, threshold: int) -> DataFrame:
    """anchor and fp: the home anchor at threshold 0, else all anchors to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Cosets(threshold)
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(all_fps), 1 << 12):
                part = all_fps[k : k + (1 << 12)]
                rows, anchor = anchors(part, code, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[rows])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def differing_bits(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def crowd_links(fps: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) among ``fps`` with the components of all their links, through words of radius 0."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    near = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    if threshold < 2:
        met = near.hint("merge").join(fps.select(F.col("fp").alias("word")), "word").select(F.col("fp").alias("u"), F.col("word").alias("v"))
        return met.where((F.col("u") > F.col("v")) & (differing_bits("u", "v") <= threshold))
    cell = near.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return cell.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def link(fps: DataFrame, where: str, threshold: int = 2, cell: int = CELL) -> DataFrame:
    """(u, v): edges between distinct fingerprints of ``fps`` (column fp), with the components of all links."""
    if not 0 <= threshold <= 2:
        raise ValueError("thresholds of 0, 1 or 2 bits")
    home = materialize(_covered(fps, 0), f"{where}/home")
    size = materialize(home.groupBy("anchor").agg(F.count(F.lit(1)).alias("homes")), f"{where}/sizes")
    cells = home.join(size.where(F.col("homes") <= cell), "anchor").select("anchor", F.col("fp").alias("x"))
    hot = size.where(F.col("homes") > cell).select("anchor", F.lit(None).cast("long").alias("x"))
    cells = materialize(cells.unionByName(hot), f"{where}/cells")
    visits = _covered(fps, threshold).withColumnRenamed("fp", "y")
    close = F.col("x").isNull() | ((differing_bits("x", "y") <= threshold) & (F.col("x") < F.col("y")))
    # Spark estimates the visits by their fingerprints, 61 times too few, and would send them to the driver to broadcast
    met = materialize(visits.hint("merge").join(cells, "anchor").where(close).select("x", "y").distinct(), f"{where}/met")
    edges = met.where("x is not null").select(F.col("y").alias("u"), F.col("x").alias("v"))
    return edges.unionByName(crowd_links(met.where("x is null").select(F.col("y").alias("fp")), threshold))


def near_duplicates(docs: DataFrame, where: str, size: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    marks = materialize(fingerprints(docs, size), f"{where}/fingerprints")
    fps = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), f"{where}/distinct")
    groups = connected_components(link(fps, where, threshold), f"{where}/components")
    groups = materialize(groups.select(F.col("node").alias("fp"), "root"), f"{where}/groups")
    rooted = materialize(fps.join(groups, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "fp", "first", "copies"), f"{where}/rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")), f"{where}/least")
    named = rooted.join(least, "root").where("copies > 1 or component is distinct from first").select("fp", "component")
    named = materialize(named, f"{where}/named")
    return marks.join(named, "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, where: str, size: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """The rows of ``docs``, of each group of near ones that with the least (doc_id, row), a null doc_id last.

    Near are texts whose fingerprints ``link`` connects, and those of Jaccard similarity ``similarity``, which mostly differ in more bits.
    """
    return jaccard.keep_one(docs, where, size, similarity, fingerprint, lambda fps, folder: link(fps, folder, threshold))
