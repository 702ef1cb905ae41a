"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the training documents into blocks of some megabytes and stores a
positional inverted index of each as one row: for every term the sorted positions in the block,
with a gap between documents. ``vocabulary`` restricts it to the terms that are going to be
searched, since other postings would be written and never read; without one, all terms are stored.

``search`` intersects, per block and window, the lists of the window's terms, each shifted by the
term's offset, from the rarest term of that block on. A window whose rarest term is absent costs
nothing, and a term as frequent as "the" is only ever probed, never scanned. ``slop`` allows
each term to be that many words off: proximity matches. Postings never leave their block, so
there is no shuffle, and a word in every document is one long sorted list per block.

A window is a run of ``window`` words of a benchmark item, or all words of a shorter one. Items
are taken in groups of at most ``MAX_QUERY_WORDS`` words, each group a broadcast of bounded
size and a pass of its own over the index; hits of the groups are then joined
per document.

Null texts have no words; items without words have no window; items of equal item_id count as
one; a null item_id or doc_id is kept as such ("null" in lists); repeated rows give repeated rows; further
columns are ignored; empty documents give an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

MAX_QUERY_WORDS = 500_000
BLOCK_BYTES = 4 << 20
#: Lower-cases A-Z, keeps digits, letters and all bytes beyond ASCII, and turns the rest into blanks.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "block long, doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, positions binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Queries:
    """Distinct windows of a group of items, as rows of term numbers padded with -1."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.terms = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, ws in items:
            ids = [self.terms[w] for w in ws]
            for k in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[k : k + window]), set()).add(number[name])
        self.windows = np.array([w + (-1,) * (window - len(w)) for w in found] or np.empty((0, window)), np.int64)
        self.items = [sorted(x) for x in found.values()]


def query_groups(benchmark: DataFrame, window: int = 10, most: int = MAX_QUERY_WORDS) -> Iterator[Queries]:
    """Items in groups of at most ``most`` words (or one item); the driver holds one group at a time."""
    group, held = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        ws = words_of(row[1])
        if ws and group and held + len(ws) > most:
            yield Queries(group, window)
            group, held = [], 0
        if ws:
            group.append((row[0], ws))
            held += len(ws)
    yield Queries(group, window)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block, see ``INDEX``. ``terms``: int32 numbers of a vocabulary, or without one the terms themselves, joined with blanks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block = TaskContext.get().partitionId() << 32, 0
        known = shared.value if shared else None
        own: dict[bytes, int] = {}
        ids, sizes, numbers, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            lens = np.array(sizes, np.int64)
            every = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
            # one free position after each document: no run of words crosses it
            at = np.arange(len(every)) + np.repeat(np.arange(len(lens)), lens)
            keep = np.flatnonzero(every >= 0)
            every, at = every[keep], at[keep].astype(np.int32)
            order = np.argsort(every, kind="stable")
            present, counts = np.unique(every, return_counts=True)
            if known is None:
                by = list(own)
                terms = b" ".join(by[k] for k in present.tolist())
            else:
                terms = present.astype(np.int32).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([task + block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([terms], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([at[order].tobytes()], pa.binary())],
                names=["block", "doc_ids", "n_words", "terms", "counts", "positions"],
            )

        for batch in batches:
            texts = batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                raw = (texts[k].as_py() or "").encode()
                ws = raw.translate(WORDS).split()
                if known is None:
                    n = np.fromiter((own.setdefault(w, len(own)) for w in ws), np.int32, len(ws))
                else:
                    n = np.fromiter(map(known.get, ws, repeat(-1)), np.int32, len(ws))
                ids.append(doc)
                sizes.append(len(ws))
                numbers.append(n)
                held += len(raw) + 100
                if held >= block_bytes:
                    yield made()
                    block, held = block + 1, 0
                    ids, sizes, numbers = [], [], []
                    own.clear()
        if ids:
            yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def postings(row: dict, terms: dict[bytes, int], by_number: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and first places by term number of the queries, and all positions of a block."""
    counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
    first = np.cumsum(counts) - counts
    n = len(terms)
    if by_number:
        numbers = np.frombuffer(row["terms"], np.int32)
    else:
        numbers = np.array([terms.get(t, n) for t in row["terms"].split(b" ")] if row["terms"] else [], np.int64)
    count, start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    count[numbers], start[numbers] = counts, first
    count[n] = 0
    return count, start, np.frombuffer(row["positions"], np.int32)


def occurrences(queries: Queries, count: np.ndarray, start: np.ndarray, at: np.ndarray, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(window number, first positions) for each window that occurs in the block."""
    lens = np.where(queries.windows >= 0, count[queries.windows], np.iinfo(np.int64).max)
    alive = np.flatnonzero(lens.min(axis=1) > 0) if len(lens) else []
    order = np.argsort(lens[alive], axis=1, kind="stable") if len(alive) else []
    for k, offsets in zip(alive, order, strict=True):
        window, here = queries.windows[k], None
        for offset in offsets.tolist():
            term = window[offset]
            if term < 0:
                break
            list_ = at[start[term] : start[term] + count[term]]
            if here is None:
                here = list_.astype(np.int64) - offset
                continue
            i = np.searchsorted(list_, here + offset - slop)
            here = here[(i < len(list_)) & (list_[np.minimum(i, len(list_) - 1)] <= here + offset + slop)]
            if not len(here):
                break
        if len(here):
            yield int(k), here


HITS = "block long, ordinal int, doc_id long, n_words int, hits array<int>, items array<string>"


def search(index: DataFrame, queries: Queries, by_number: bool = True, slop: int = 0) -> DataFrame:
    """A row per document of the index, see ``HITS``: word positions inside exact (or, with ``slop``, near) occurrences of windows, and the items that have one."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        sizes = (q.windows >= 0).sum(axis=1)
        for batch in batches:
            for row in batch.to_pylist():
                count, first, at = postings(row, q.terms, by_number)
                n_words = np.array(row["n_words"], np.int64)
                begin = np.cumsum(n_words + 1) - n_words - 1
                hit: dict[int, set[int]] = {}
                items: dict[int, set[int]] = {}
                for k, here in occurrences(q, count, first, at, slop):
                    doc = np.searchsorted(begin, np.maximum(here, 0), side="right") - 1
                    for d, p in zip(doc.tolist(), (here - begin[doc]).tolist(), strict=True):
                        hit.setdefault(d, set()).update(range(max(p, 0), min(p + int(sizes[k]), int(n_words[d]))))
                        items.setdefault(d, set()).update(q.items[k])
                n = len(n_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int32()),
                     pa.array([sorted(hit.get(d, ())) for d in range(n)], pa.list_(pa.int32())), pa.array([[q.names[i] for i in sorted(items.get(d, ()))] for d in range(n)], pa.list_(pa.string()))],
                    names=["block", "ordinal", "doc_id", "n_words", "hits", "items"],
                )

    return index.mapInArrow(run, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, where: str, window: int = 10, slop: int = 0, most: int = MAX_QUERY_WORDS) -> DataFrame:
    """``HITS`` for each document, over all items."""
    groups = query_groups(benchmark, window, most)
    first, second = next(groups), next(groups, None)
    if second is None:
        return search(materialize(build_index(docs, first.terms), f"{where}/index"), first, slop=slop)
    # several groups share one index of all terms, so block and ordinal name the same document in each pass
    index = materialize(build_index(docs), f"{where}/index")
    parts = [f"{where}/hits/0"]
    out = materialize(search(index, first, False, slop), parts[0])
    for k, queries in enumerate(chain([second], groups), 1):
        parts.append(f"{where}/hits/{k}")
        materialize(search(index, queries, False, slop).where("size(items) > 0"), parts[-1])
    out = docs.sparkSession.read.schema(out.schema).parquet(*parts)
    joined = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")]
    out = out.groupBy("block", "ordinal").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *joined)
    return out.select("block", "ordinal", "doc_id", "n_words", "hits", "items")

