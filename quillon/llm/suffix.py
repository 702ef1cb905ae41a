"""Removal of long repeated passages with a distributed sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. All suffixes would be a hundred times the input, so the array is sparse:

* Anchors are the positions whose ``GRAM``-byte string has the least hash of some window of
  LENGTH - GRAM + 1 neighbours. Every string of LENGTH bytes holds an anchor, and equal strings
  hold theirs at the same place, so comparing what surrounds anchors finds every repeat. An
  anchor is in one string at most LENGTH - GRAM bytes from its start: with the bytes to the left
  that can matter and LENGTH bytes to the right, it is a suffix with a short memory.
* Texts are first made distinct by SHA-256 (an exact copy of a smaller id goes whole) and dealt
  into chunks of about ``CHUNK`` bytes, as a bucketed table that later passes join without a shuffle.
* Grams that only one text holds are excluded by their hashes, packed per chunk and hash range,
  before any suffix is sent. Equal suffixes of a chunk are sent once, with the least and largest id.
* Sampled splitters range-partition the suffixes by their first GRAM bytes, ``SPLITTERS`` of them at most; where that leaves ranges of more
  than ``BUCKET_ROWS`` suffixes, each is dealt out by a hash of the gram. Equal leading bytes
  never straddle a boundary, so neighbours across a boundary share less than a gram and no
  string.
* Grams that the sample finds in more than ``HOT_ROWS`` suffixes go apart. There equal suffixes of all chunks become one, by partial
  aggregation, and are compared twice, with those that share ``FURTHER`` more bytes to the right and with those that share as many to the left: a string
  of LENGTH bytes has so many beyond the gram on one of its sides. Groups that are still larger than ``HOT_ROWS`` become
  their single strings, whose least ids are a partial aggregate. The runs are joined back.
* Each bucket is sorted by multikey quicksort, 8 bytes at a time and only within ties; the
  common prefixes of neighbours, to the right and, from a second sort, to the left, give for each
  of the LENGTH - GRAM + 1 strings around an anchor the groups of equals and their least id.
* Runs of such strings with a smaller id go back to their chunks, whose texts drop the bytes.

Bytes are compared, not hashes; a hash that collides only lets a suffix through in vain. Null
texts count as empty. A null doc_id counts as larger than all others. Rows of one doc_id do not
repeat each other; repeated rows give repeated rows; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

LENGTH, GRAM = 50, 24
CHUNK = 6 << 20
PART_BYTES = 16 << 20
MIN_PART_BITS = 8
BUCKET_ROWS, HOT_ROWS = 20_000, 100_000
SPLITTERS = 20_000
FURTHER = (LENGTH - GRAM) // 2
SEGMENT = 1 << 20
THIN = 64
LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM = 24 bytes, from hashes of runs of 1, 2, 4, 8 and 16."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    eight = None
    for k, size in enumerate((1, 2, 4, 8)):
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + h[size:]
        h ^= h >> np.uint64(31)
        eight = h if size == 4 else eight
    h = h[:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    done = 1
    while done * 2 <= size:
        x, done = pick(x[:-done], x[done:]), done * 2
    return x if done == size else pick(x[: len(x) - (size - done)], x[size - done :])


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a text and the hashes of their grams."""
    n, window = len(b), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = [], []
    for start in range(0, n - LENGTH + 1, SEGMENT):
        # strings of LENGTH bytes that start in the segment; an anchor may be found by two segments
        h = gram_hashes(b[start : min(n, start + SEGMENT + LENGTH - 1)])
        least = _sliding(h, window, np.minimum)
        most = np.zeros(len(least) + 2 * (window - 1), np.uint64)
        most[window - 1 : window - 1 + len(least)] = least
        at = np.flatnonzero(_sliding(most, window, np.maximum) == h)
        places.append(at + start)
        hashes.append(h[at])
    if len(places) == 1:
        return places[0], hashes[0]
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(x), np.uint8) if x else np.empty(0, np.uint8) for x in blobs]


def _pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _packed_texts(docs: DataFrame) -> DataFrame:
    """doc, sha and the text as Zstandard; a text that a task has seen comes again without it, and only with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1), {}
        for batch in batches:
            docs, shas, blobs, texts = [], [], [], batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                raw = (texts[k].as_py() or "").encode()
                sha = hashlib.sha256(raw).digest()
                before = seen.get(sha)
                if before is None or doc < before:
                    if before is not None or len(seen) < 1 << 20:
                        seen[sha] = doc
                    docs.append(doc)
                    shas.append(sha)
                    blobs.append(pack.compress(raw) if before is None else None)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(shas, pa.binary()), pa.array(blobs, pa.binary())], names=["doc", "sha", "blob"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text").mapInArrow(run, "doc long, sha binary, blob binary")


def _prefilter(texts: DataFrame, part_bits: int) -> DataFrame:
    """Per chunk and hash range the gram hashes of its texts, and whether two of them hold each."""

    def run(table: pa.Table) -> pa.Table:
        found = [np.unique(anchors(b)[1]) for b in _unpacked(table["blob"].to_pylist())]
        u, n = np.unique(np.concatenate(found), return_counts=True)
        cut = np.searchsorted(u, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits))
        low = (u >> np.uint64(24 - part_bits)) & np.uint64((1 << 40) - 1)
        rows = [(p, x, y) for p, (x, y) in enumerate(zip(np.split(low, cut), np.split(n > 1, cut), strict=True)) if len(x)]
        chunk = table["chunk"][0].as_py()
        return pa.table([pa.array([p for p, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([_pack40(x) for _, x, _ in rows], pa.binary()), pa.array([np.packbits(y).tobytes() for _, _, y in rows], pa.binary())], names=["part", "chunk", "grams", "twice"])

    return texts.groupBy("chunk").applyInArrow(run, "part int, chunk long, grams binary, twice binary")


def _repeated(packed: DataFrame) -> DataFrame:
    """The rows of ``_prefilter`` with only those grams that two texts hold."""

    def run(table: pa.Table) -> pa.Table:
        rows = [_unpack40(x) for x in table["grams"].to_pylist()]
        marks = [np.unpackbits(np.frombuffer(y, np.uint8))[: len(x)].astype(bool) for x, y in zip(rows, table["twice"].to_pylist(), strict=True)]
        every = np.sort(np.concatenate(rows))
        twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[x[m] for x, m in zip(rows, marks, strict=True)]]))
        kept = [x[np.isin(x, twice, assume_unique=True)] for x in rows] if len(twice) else [x[:0] for x in rows]
        some = [k for k, x in enumerate(kept) if len(x)]
        return pa.table([table["part"].combine_chunks().take(pa.array(some, pa.int64())), table["chunk"].combine_chunks().take(pa.array(some, pa.int64())), pa.array([_pack40(kept[k]) for k in some], pa.binary())], names=["part", "chunk", "grams"])

    return packed.groupBy("part").applyInArrow(run, "part int, chunk long, grams binary")


class Suffixes:
    """The anchors of a chunk whose grams are repeated, and the distinct contexts around them."""

    def __init__(self, texts: list[np.ndarray], docs: np.ndarray, flags: pa.Table, part_bits: int):
        wanted = [np.empty(0, np.uint64)]
        for part, grams in zip(flags["part"].to_pylist(), flags["grams"].to_pylist(), strict=True):
            wanted.append((np.uint64(part) << np.uint64(40)) | _unpack40(grams))
        known = np.sort(np.concatenate(wanted))
        before, after = LENGTH - GRAM, LENGTH
        text, place, parts = [], [], []
        for k, b in enumerate(texts):
            at, h = anchors(b)
            if not len(at) or not len(known):
                continue
            h >>= np.uint64(24 - part_bits)
            at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            if len(at):
                padded = np.zeros(before + len(b) + after, np.uint8)
                padded[before : before + len(b)] = b
                parts.append(np.lib.stride_tricks.sliding_window_view(padded, before + after)[at])
                text.append(np.full(len(at), k))
                place.append(at)
        cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
        self.text, self.place = cat(text, np.int64), cat(place, np.int64)
        size = np.array([len(b) for b in texts], np.int64)[self.text]
        left, right = np.minimum(self.place, before), np.minimum(size - self.place, after)
        context = np.concatenate(parts) if parts else np.empty((0, before + after), np.uint8)
        row = np.concatenate([context, np.stack([left, right], 1).astype(np.uint8)], 1)
        flat = np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel() if len(row) else np.empty(0, "V78")
        _, self.first, self.number = np.unique(flat, return_index=True, return_inverse=True)
        self.rows = row[self.first]
        doc = docs[self.text]
        self.least, self.most = np.full(len(self.first), LAST), np.full(len(self.first), -(1 << 62))
        np.minimum.at(self.least, self.number, doc)
        np.maximum.at(self.most, self.number, doc)


SUFFIX = "bucket long, chunk long, number int, context binary, least long, most long"


def _chunk(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    table = table.sort_by("sha")
    return _unpacked(table["blob"].to_pylist()), table["doc"].to_numpy()


def _suffixes(texts: DataFrame, flags: DataFrame, part_bits: int, splitters: list[bytes], hot: list[bytes], lanes: int = 1, thin: int = 1) -> DataFrame:
    """``SUFFIX`` rows, or a sample of one in ``thin``; each range between splitters has ``lanes`` buckets; that of ``hot`` grams is -1."""
    shared = texts.sparkSession.sparkContext.broadcast((splitters, hot))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SUFFIX.split(", ")]
        cuts, apart = (np.array(x, f"S{GRAM}") for x in shared.value)
        if not left.num_rows:
            s = None
        else:
            s = Suffixes(*_chunk(left), right, part_bits)
        rows = s.rows[::thin] if s else np.empty((0, 78), np.uint8)
        n = len(rows)
        key = np.ascontiguousarray(rows[:, LENGTH - GRAM : LENGTH]).view(f"S{GRAM}").ravel() if n else np.empty(0, f"S{GRAM}")
        lane = _lanes(rows[:, LENGTH - GRAM : LENGTH], lanes)
        bucket = np.where(np.isin(key, apart), -1, np.searchsorted(cuts, key, side="right") * lanes + lane)
        width = rows.shape[1]
        context = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
        chunk = left["chunk"][0].as_py() if left.num_rows else 0
        return pa.table([pa.array(bucket), pa.array(np.full(n, chunk)), pa.array(np.arange(0, n * thin, thin, dtype=np.int32)), context, pa.array(s.least[::thin] if s else np.empty(0, np.int64)), pa.array(s.most[::thin] if s else np.empty(0, np.int64))], names=names)

    return texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(run, SUFFIX)


def _lanes(grams: np.ndarray, lanes: int) -> np.ndarray:
    words = np.ascontiguousarray(grams).view(np.uint64).reshape(len(grams), GRAM // 8)
    h = words[:, 0]
    for k in range(1, words.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[:, k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(20)) % np.uint64(lanes)).astype(np.int64)


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes: by 8 bytes at a time, going on only within ties."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    tie = np.zeros(n, bool)  # whether a row equals the one before it so far
    tie[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        open_ = tie.copy()
        open_[:-1] |= tie[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group = np.cumsum(~tie[at])
        part = order[at]
        again = np.lexsort((words[part, k], group))
        order[at] = part[again]
        same = words[order[at][1:], k] == words[order[at][:-1], k]
        tie[at[1:]] &= same
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order shares with the one before it; 0 for the first."""
    out, width = np.zeros(len(order), np.int64), rows.shape[1]
    for k in range(1, len(order), 1 << 14):
        a, b = rows[order[k : k + (1 << 14)]], rows[order[k - 1 : min(len(order) - 1, k - 1 + (1 << 14))]]
        differ = a != b
        out[k : k + len(a)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


#: Distances to the anchor of strings that hold ``FURTHER`` bytes beyond the gram to the right, and of the others, which hold as many to the left.
SIDES = (range(LENGTH - GRAM - FURTHER + 1), range(LENGTH - GRAM - FURTHER + 1, LENGTH - GRAM + 1))
RUN = "chunk long, number int, low int, high int, doc long"


def _compare(suffixes: DataFrame) -> DataFrame:
    """For each suffix the runs of strings, by their distance to the anchor, that also occur in ``doc``, a smaller id.

    A bucket of bytes is a side, 0 or 1, and what its suffixes share there; only strings that reach so far on that side are compared.
    """

    def run(table: pa.Table) -> pa.Table:
        before, n = LENGTH - GRAM, table.num_rows
        rows = np.frombuffer(b"".join(table["context"].to_pylist()), np.uint8).reshape(n, -1)
        least, most = table["least"].to_numpy(), table["most"].to_numpy()
        n_left, n_right = rows[:, -2], rows[:, -1]
        right, left = rows[:, before : before + LENGTH], np.ascontiguousarray(rows[:, before - 1 :: -1][:, :before])
        order = multikey_sort(right)
        shared = common_prefixes(right, order)
        order_left = multikey_sort(left)
        shared_left = common_prefixes(left, order_left)
        id_right, id_left = np.empty(n, np.int64), np.empty(n, np.int64)
        docs = np.full((n, before + 1), LAST)
        bucket = table["bucket"][0].as_py()
        for o in SIDES[bucket[0]] if isinstance(bucket, bytes | bytearray) else range(before + 1):
            id_right[order] = np.cumsum(shared < LENGTH - o)
            id_left[order_left] = np.cumsum(shared_left < o)
            some = np.flatnonzero((n_left >= o) & (n_right >= LENGTH - o))
            if not len(some):
                continue
            key = (id_right[some] << 32) | id_left[some]
            by = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            low = np.minimum.reduceat(least[some][by], begins)
            docs[some[by], o] = np.repeat(low, np.diff(np.append(begins, len(by))))
        docs[docs >= most[:, None]] = LAST
        flat = docs.ravel()
        new = np.ones((n, before + 1), bool)
        new[:, 1:] = docs[:, 1:] != docs[:, :-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(flat)) - 1
        keep = flat[begin] < LAST
        begin, end = begin[keep], end[keep]
        at = begin // (before + 1)
        return pa.table(
            [pa.array(table["chunk"].to_numpy()[at]), pa.array(table["number"].to_numpy()[at]), pa.array((begin % (before + 1)).astype(np.int32)), pa.array((end % (before + 1)).astype(np.int32)), pa.array(flat[begin])],
            names=[x.split()[0] for x in RUN.split(", ")],
        )

    # buckets differ in size: more partitions than usual, so that the largest holds little more than the others
    parts = 4 * int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return suffixes.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, RUN)


def _compare_hot(suffixes: DataFrame, where: str) -> DataFrame:
    """Runs of suffixes with hot grams: equal ones are compared once, whatever chunks they are in."""
    rows = materialize(suffixes, f"{where}/hot")
    one = rows.groupBy("context").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    one = materialize(one.withColumn("chunk", F.monotonically_increasing_id()), f"{where}/contexts")
    # the gram starts behind LENGTH - GRAM bytes
    shared = [F.concat(F.lit(bytes([side])), F.substring("context", LENGTH - GRAM + 1 - side * FURTHER, GRAM + FURTHER)) for side in (0, 1)]
    sided = materialize(one.select("*", F.explode(F.array(*shared)).alias("bucket")), f"{where}/sides")
    crowds = materialize(sided.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select("bucket"), f"{where}/crowds")
    some = sided.join(crowds.hint("merge"), "bucket", "left_anti")
    runs = _compare(some.select("bucket", "chunk", F.lit(0).alias("number"), "context", "least", "most")).drop("number")
    runs = runs.unionByName(_compare_each(sided.join(crowds.hint("merge"), "bucket", "left_semi"), where))
    runs = materialize(runs.join(one.select("chunk", "context"), "chunk").drop("chunk"), f"{where}/hotruns")
    return rows.join(runs, "context").where("doc < most").select("chunk", "number", "low", "high", "doc")


def _compare_each(suffixes: DataFrame, where: str) -> DataFrame:
    """As ``_compare``, a row for each string, so that no group is ever in one place."""
    byte = lambda at: F.conv(F.hex(F.substring("context", at, 1)), 16, 10).cast("int")
    left, right = byte(2 * LENGTH - GRAM + 1), byte(2 * LENGTH - GRAM + 2)
    sides = [F.array(*[F.lit(o) for o in side]) for side in SIDES]
    offsets = F.when(F.substring("bucket", 1, 1) == F.lit(b"\0"), sides[0]).otherwise(sides[1])
    fits = F.filter(offsets, lambda o: (left >= o) & (right >= LENGTH - o))
    strings = suffixes.select("chunk", "context", "least", "most", F.explode(fits).alias("low"))
    strings = strings.select("chunk", "least", "most", "low", F.expr(f"substring(context, {LENGTH - GRAM + 1} - low, {LENGTH})").alias("string"))
    strings = materialize(strings, f"{where}/strings")
    least = materialize(strings.groupBy("string").agg(F.min("least").alias("doc")), f"{where}/strings_least")
    return strings.join(least.hint("merge"), "string").where("doc < most").select("chunk", "low", F.col("low").alias("high"), "doc")


RESULT = "sha binary, first long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(texts: DataFrame, marks: DataFrame, part_bits: int, keep_text: bool) -> DataFrame:
    """Drop covered bytes. ``marks``: flags and runs, told apart by a null ``grams``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=[x.split()[0] for x in RESULT.split(", ")])
        left = left.sort_by("sha")
        texts, docs = _chunk(left)
        is_run = right["grams"].is_null()
        runs, flags = right.filter(is_run), right.filter(right["grams"].is_valid())
        size = np.array([len(b) for b in texts], np.int64)
        base = np.cumsum(size + 1) - size - 1
        edge = np.zeros(int(size.sum()) + len(size) + 1, np.int32)
        if runs.num_rows:
            s = Suffixes(texts, docs, flags, part_bits)
            number = runs["number"].to_numpy()
            by = np.argsort(number, kind="stable")
            number, low, high, doc = number[by], runs["low"].to_numpy()[by], runs["high"].to_numpy()[by], runs["doc"].to_numpy()[by]
            first, last = np.searchsorted(number, s.number), np.searchsorted(number, s.number, side="right")
            n = last - first
            row = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            mine = doc[i] < docs[s.text[row]]
            row, i = row[mine], i[mine]
            at = base[s.text[row]] + s.place[row]
            np.add.at(edge, at - high[i], 1)
            np.add.at(edge, at - low[i] + LENGTH, -1)
        covered = np.cumsum(edge) > 0
        removed, spans, shas, kept = [], [], [], []
        pack = zstandard.ZstdCompressor(level=1)
        for k, b in enumerate(texts):
            gone = covered[base[k] : base[k] + size[k]]
            rest = b[~gone].tobytes()
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept.append(pack.compress(rest) if keep_text else None)
        return pa.table([left["sha"], left["doc"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())], names=[x.split()[0] for x in RESULT.split(", ")])

    return texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, RESULT)


def deduplicate(docs: DataFrame, where: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the remaining bytes as Zstandard in ``kept``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    base = materialize(base, f"{where}/base")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    chunks = max(1, -(-total // CHUNK))
    part_bits = min(24, max(MIN_PART_BITS, int(total // PART_BYTES).bit_length()))
    buckets = min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"quillon_texts_{uuid.uuid4().hex}"
    packed = _packed_texts(docs).withColumn("chunk", F.pmod(F.xxhash64("sha"), F.lit(chunks))).repartition(buckets, "chunk")
    packed = packed.groupBy("chunk", "sha").agg(F.min("doc").alias("doc"), F.max("blob").alias("blob"))
    packed.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{where}/texts").format("parquet").saveAsTable(name)
    try:
        texts = spark.table(name)
        flags = materialize(_repeated(_prefilter(texts, part_bits)), f"{where}/flags")
        # a bounded sample of leading bytes: all chunks up to 64 of them, then 64, each thinned out
        step = max(1, chunks // 64)
        some = f"chunk % {step} = 0"
        sample = _suffixes(texts.where(some), flags.where(some), part_bits, [], [], thin=THIN)
        counts = Counter(bytes(r[0]) for r in sample.select(F.substring("context", LENGTH - GRAM + 1, GRAM)).collect())
        hot = [k for k, c in counts.items() if c * THIN * step > HOT_ROWS]
        keys = sorted(counts.elements())
        rows = len(keys) * THIN * step
        n = max(1, min(len(keys), rows // BUCKET_ROWS + 1, SPLITTERS))
        splitters = sorted({keys[len(keys) * k // n] for k in range(1, n)})
        suffixes = _suffixes(texts, flags, part_bits, splitters, hot, lanes=max(1, -(-rows // (n * BUCKET_ROWS))))
        runs = _compare(suffixes.where("bucket >= 0"))
        if hot:
            runs = runs.unionByName(_compare_hot(suffixes.where("bucket < 0"), where))
        runs = materialize(runs, f"{where}/runs")
        marks = flags.select("chunk", "part", "grams", F.lit(None).cast("int").alias("number"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(None).cast("long").alias("doc")).unionByName(
            runs.select("chunk", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("grams"), "number", "low", "high", "doc")
        )
        result = materialize(_apply(texts, marks, part_bits, keep_text), f"{where}/result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, part: F.when(copy, whole).otherwise(part)
    out = base.join(result, "sha").select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans")).alias("n_spans"),
        pick(F.lit(EMPTY), F.col("kept_sha256")).alias("kept_sha256"),
        pick(F.lit(None).cast("binary"), F.col("kept")).alias("kept"),
    )
    return out if keep_text else out.drop("kept")
