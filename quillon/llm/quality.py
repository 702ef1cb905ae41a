"""Quality classifier by co-training a text view and a metadata view.

A document is good if its label says quality and not toxic. The text view sees hashed words and word beginnings, each once per
text; the metadata view sees source, language and length, alone and crossed, and the page's layout: measures of its
lines, marks and capitals. Both are logistic models. Either has one more input, what the other view has taught it:

1. In each round either model scores every document that is not of the labelled sample. Those whose calibrated probability is in the upper or
   lower ``SURE`` of the class's share among held-out labels it hands to the other view, labelled with that probability.
2. The other view counts its own features in them, by label, over all such documents; a feature's lesson is the logarithm of how
   much more often good ones have it than bad ones, and a document's is the mean of its features'.
3. Both models are fitted anew, on the labelled sample, with their lesson as an input: so words and sources that no
   labelled document has weigh as well.

At last a logistic combination of the calibrated views is fitted on the held-out labels and scores every document.

Fitting takes a bounded sample of labels, the ``max_labelled`` with the least hashes of their ids; every fifth is held out for calibration, thresholds and the
combination. The driver gathers, per labelled document, the features that are chosen by their counts, and arrays of one number
per hashed feature, 2**18; counts over the pool are summed on the executors. Each round and the scoring is one pass over whole texts without
a shuffle of them.

Null texts count as empty, null metadata as a value of its own; several labels of one document make it
good only if all do; null labels are ignored. Without labels of both classes every document gets the
share of good labels (1 without labels). Documents that score at least ``threshold`` are kept,
and all in that last case. Repeated rows score alike; an empty table gives an empty result; further columns pass through, but for those that are added, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialize
from quillon.llm.shingles import U, mixed

BITS = 18
DIM = 1 << BITS
N_STYLE = 15
#: Labelled documents that are fitted on, and features of a view that a model may choose.
MAX_LABELLED, MAX_FEATURES = 12_000, 1 << 15
ROUNDS, SURE = 2, 0.5
THRESHOLD = 0.5
Z, LEAST = 4.0, 4
PREFIXES = (4, 5, 6)
#: Bytes of texts whose features are made together.
CHUNK = 1 << 20
#: Features are counted by slices of this many.
SLICE = 1 << 12
TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, U) * U(2) + U(1)
POWER = U(0xD6E8FEB86659FD93)
#: Bytes between words: blanks and marks, which words are split at.
BETWEEN = np.array([c <= 32 or chr(c) in ".,;:!?\"'()[]{}<>|#%$&*-_" for c in range(256)])
#: Classes of bytes that the layout counts, each a bit.
CLASSES = {"line": "\n", "bar": "|", "mark": "!", "stop": ".,", "digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbol": "#%$&*|<>{}\\^~"}
KIND = np.array([sum((chr(c) in s) << k for k, s in enumerate(CLASSES.values())) for c in range(128)] + [0] * 128, np.uint8)


@dataclass
class Rows:
    """Hashed features of documents, those of document k from ``at[k]`` to ``at[k + 1]``, and dense ones."""

    ids: np.ndarray
    at: np.ndarray
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def sums(self, per_feature: np.ndarray) -> np.ndarray:
        """The sum over each document's features."""
        return np.diff(np.concatenate([[0.0], np.cumsum(per_feature[self.ids], dtype=np.float64)])[self.at])

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        return Rows(self.ids[np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])], at, self.dense[rows])


def _distinct(doc: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(doc << BITS | ids)
    found = found[np.diff(found, prepend=-1) > 0]
    return (found & (DIM - 1)).astype(np.int32), np.searchsorted(found, np.arange(n + 1) << BITS)


def content(texts: list[str]) -> tuple[Rows, np.ndarray]:
    """The text view of non-empty ``texts``, and ``N_STYLE`` measures of their layout, between 0 and 1."""
    raw = [t.encode() for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw])
    starts = ends - [len(x) + 1 for x in raw]
    low = np.frombuffer("\n".join(t.lower() for t in texts).encode() + b"\n", np.uint8)
    low_starts = starts
    if len(low) != len(b):  # lower case of some letters is longer or shorter
        sizes = [len(t.lower().encode()) + 1 for t in texts]
        low_starts = np.cumsum(sizes) - sizes
    apart = BETWEEN[low]
    first = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
    last = np.flatnonzero(~apart & np.concatenate([apart[1:], [True]]))
    size = last - first + 1
    body = first[0] if len(first) else len(low)
    start = first - body
    within = np.arange(len(low) - body) - np.repeat(start, np.diff(start, append=len(low) - body))
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, POWER, U))
    term = np.where(apart[body:], U(0), TABLE[low[body:]] * powers[np.minimum(within, len(powers) - 1)])
    word = mixed(np.add.reduceat(term, start)) if len(first) else np.zeros(0, U)
    doc = np.searchsorted(low_starts, first, "right") - 1
    n_docs = len(texts)
    # the first of equal words of a text stands for all
    _, once = np.unique(mixed(word + doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    of, at, long = doc[once], start[once], size[once]
    ids, docs = [(word[once] & U(DIM - 1)).astype(np.int64)], [of]
    for k in PREFIXES:
        some = long > k
        beginning = sum((term[at[some] + j] for j in range(k)), np.zeros(int(some.sum()), U))
        ids.append((mixed(beginning + U(k)) & U(DIM - 1)).astype(np.int64))
        docs.append(of[some])
    flat, where = _distinct(np.concatenate(docs), np.concatenate(ids), n_docs)

    kind = KIND[b]
    count = {name: np.add.reduceat(kind >> k & 1, starts, dtype=np.int64) for k, name in enumerate(CLASSES)}
    n = np.maximum(np.array([len(x.split()) for x in raw]), 1)
    n_words = np.bincount(doc, minlength=n_docs)
    chars, lines = ends - starts - 1, count["line"]
    repeats = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs)
    n_lines_once = np.array([len(set(x.split(b"\n"))) for x in raw])
    style = np.minimum(1.0, np.stack([
        n / 50, np.log1p(n) / 10, np.bincount(doc, size, n_docs) / np.maximum(n_words, 1) / 15, np.bincount(of, minlength=n_docs) / np.maximum(n_words, 1), count["symbol"] / n, count["bar"] / n, count["symbol"] / chars * 10, count["upper"] / chars * 2, count["mark"] / n,
        count["digit"] / chars * 4, count["stop"] / n, n_lines_once / lines, chars / lines / 400, repeats / n, n / lines / 80,
    ], 1))
    return Rows(flat, where, np.zeros((n_docs, 0))), style


@lru_cache(maxsize=1 << 16)
def record_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, ...]:
    size = -1 if n_chars is None else min(24, int(np.log2(max(1, n_chars)) * 1.5))
    names = (f"s{source!r}", f"l{lang!r}", f"n{size}", f"ln{lang!r}{size}", f"sl{source!r}{lang!r}", f"sn{source!r}{size}", f"b{(source or '')[:3]!r}")
    return tuple(crc32(x.encode()) & (DIM - 1) for x in names)


def both_views(texts: list[str | None], sources: list, langs: list, sizes: list) -> tuple[Rows, Rows]:
    """The text view and the metadata view of documents, made in chunks of bounded size."""
    full = [k for k, t in enumerate(texts) if t]
    style = np.zeros((len(texts), N_STYLE))
    flat, counts, chunk, room = [], np.zeros(len(texts), np.int64), [], 0
    for k in [*full, None]:
        if chunk and (k is None or room + len(texts[k]) > CHUNK):
            rows, made = content([texts[i] for i in chunk])
            style[chunk], counts[chunk] = made, np.diff(rows.at)
            flat.append(rows.ids)
            chunk, room = [], 0
        if k is not None:
            chunk.append(k)
            room += len(texts[k])
    at = np.concatenate([[0], np.cumsum(counts)])
    text = Rows(np.concatenate(flat) if flat else np.zeros(0, np.int32), at, np.zeros((len(texts), 0)))
    binned = (mixed((np.arange(N_STYLE) * 16 + (style * 12).astype(np.int64)).astype(U) + U(1)) & U(DIM - 1)).astype(np.int64)
    record = np.array([record_features(s, g, c) for s, g, c in zip(sources, langs, sizes, strict=True)], np.int64).reshape(len(texts), -1)
    every = np.concatenate([record, binned], 1)
    ids, at = _distinct(np.repeat(np.arange(len(texts)), every.shape[1]), every.ravel(), len(texts))
    return text, Rows(ids, at, style)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Hashed features count 1 each; dense ones, the lesson and a constant by their value."""

    l2: float = 1e-4
    steps: int = 60
    w: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lesson: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    def inputs(self, rows: Rows) -> np.ndarray:
        taught = np.zeros(len(rows)) if self.lesson is None else rows.sums(self.lesson) / np.maximum(np.diff(rows.at), 1)
        return np.column_stack([rows.dense, taught, np.ones(len(rows))])

    def margin(self, rows: Rows) -> np.ndarray:
        return rows.sums(self.w) + self.inputs(rows) @ self.v

    def fit(self, rows: Rows, inputs: np.ndarray, y: np.ndarray) -> Logistic:
        """Full-batch Adam from zero."""
        used, flat = np.unique(rows.ids, return_inverse=True)
        row = np.repeat(np.arange(len(rows)), np.diff(rows.at)).astype(np.int32)
        flat = flat.astype(np.int32)
        theta = np.zeros(len(used) + inputs.shape[1])
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, self.steps + 1):
            z = np.bincount(row, theta[: len(used)][flat], len(rows)) + inputs @ theta[len(used) :]
            r = (sigmoid(z) - y) / len(y)
            g = np.concatenate([np.bincount(flat, r[row], len(used)), inputs.T @ r]) + self.l2 * theta
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        self.w = np.zeros(DIM, np.float32)
        self.w[used] = theta[: len(used)]
        self.v = theta[len(used) :]
        return self

    def logit(self, rows: Rows) -> np.ndarray:
        return self.margin(rows) * self.scale[0] + self.scale[1]


def _logit_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a small logistic model; targets are smoothed as Platt does."""
    n1 = y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a = np.column_stack([x, np.ones(len(x))])
    theta, lam = np.zeros(a.shape[1]), ridge * len(y)

    def loss(t: np.ndarray) -> float:
        z = a @ t
        return float((np.logaddexp(0, z) - target * z).sum() + lam / 2 * (t[:-1] @ t[:-1]))

    for _ in range(100):
        p = sigmoid(a @ theta)
        pull = lam * np.append(np.ones(len(theta) - 1), 0)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9)
        step, size = np.linalg.solve(h, a.T @ (p - target) + pull * theta), 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(step).max() * size < 1e-7:
            break
    return theta


@dataclass
class Model:
    """``exchanged``: of each round, how many documents the text view and the metadata view labelled for the other."""

    text: Logistic
    meta: Logistic
    mix: np.ndarray
    prior: float | None = None
    #: Of the text and the metadata view: calibrated logits from which a document is surely good, and to which it is surely bad.
    sure: list[tuple[float, float]] = field(default_factory=list)
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def scores(self, text: Rows, meta: Rows) -> np.ndarray:
        """Probabilities of good by text, by metadata and by both."""
        if self.prior is not None:
            return np.full((len(meta), 3), self.prior)
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(np.stack([a, b, a * self.mix[0] + b * self.mix[1] + self.mix[2]], 1))


def lesson(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Per feature, how much more often good documents have it than bad ones; 0 for features of too few."""
    n, m = good.sum(), bad.sum()
    return np.where(good + bad >= LEAST, np.log((good + 1) / (n + 2)) - np.log((bad + 1) / (m + 2)), 0.0).astype(np.float32)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and y, 1 for good: the ``most`` labels with the least hashes of their ids."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    return known.select("doc_id", F.col("good").cast("int").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)


def _views(batch: pa.RecordBatch) -> tuple[Rows, Rows]:
    return both_views(*[batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, 512) for k in range(0, batch.num_rows, 512))


def _labelled(docs: DataFrame, chosen: DataFrame, where: str) -> DataFrame:
    """doc_id, y and features of the sample, one row per document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                views = _views(batch)
                lists = [pa.ListArray.from_arrays(pa.array(v.at.astype(np.int32)), pa.array(v.ids)) for v in views]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists, pa.array([x.tobytes() for x in views[1].dense], pa.binary())], names=["doc_id", "y", "text", "meta", "style"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("y int, text array<int>, meta array<int>, style binary").fields])
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", "source", "lang", "n_chars")
    made = materialize(rows.mapInArrow(run, schema), f"{where}/labelled")
    # repeated rows of an id add nothing but room
    return materialize(made.dropDuplicates(["doc_id"]), f"{where}/sample")


def _counts(sample: DataFrame, view: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature, how many fitted documents have it, and how many good ones."""
    rows = sample.where(~_is_held()).select("y", F.explode(view).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).toArrow()
    n, ones = np.zeros(DIM), np.zeros(DIM)
    n[rows["id"].to_numpy()], ones[rows["id"].to_numpy()] = rows["n"].to_numpy(), rows["ones"].to_numpy()
    return n, ones


def _is_held() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(5)) == 0


def _rows(table: pa.Table, view: str) -> Rows:
    lists = table[view].combine_chunks()
    style = np.frombuffer(b"".join(table["style"].to_pylist()), np.float64).reshape(-1, N_STYLE)
    return Rows(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), style if view == "meta" else style[:, :0])


def _exchange(pool: DataFrame, model: Model) -> tuple[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]:
    """What either view labels for the other: how many documents, and counts of the other's features in good and bad ones, summed over the whole pool."""
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts, told = np.zeros((2, 2, DIM)), [0, 0]
        for whole in batches:
            for batch in _pieces(whole):
                views = _views(batch)
                for k, logistic in enumerate((m.text, m.meta)):
                    z = logistic.logit(views[k])
                    sure = np.flatnonzero((z >= m.sure[k][0]) | (z <= m.sure[k][1]))
                    told[k] += len(sure)
                    other = views[1 - k].take(sure)
                    p = np.repeat(sigmoid(z[sure]), np.diff(other.at))
                    counts[1 - k] += np.bincount(other.ids, p, DIM), np.bincount(other.ids, 1 - p, DIM)
        for k in range(2):
            for start in range(0, DIM, SLICE):
                part = counts[k, :, start : start + SLICE]
                if part.any() or not start:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([start], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([0 if start else told[1 - k]], pa.int64())], names=["view", "start", "counts", "told"])

    def total(table: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(x.as_py(), np.float64) for x in table["counts"])
        return pa.table([table["view"][:1], table["start"][:1], pa.array([both.tobytes()], pa.binary()), pa.array([sum(table["told"].to_pylist())])], names=["view", "start", "counts", "told"])

    schema = "view int, start int, counts binary, told long"
    parts = pool.select("text", "source", "lang", "n_chars").mapInArrow(run, schema)
    # sums of sums, so that a slice is never gathered from all tasks at once
    some = parts.withColumn("_lane", F.pmod(F.monotonically_increasing_id() / F.lit(1 << 33), F.lit(64)).cast("int")).groupBy("view", "start", "_lane").applyInArrow(total, schema)
    counts, told = np.zeros((2, 2, DIM)), [0, 0]
    for row in some.groupBy("view", "start").applyInArrow(total, schema).toArrow().to_pylist():
        counts[row["view"], :, row["start"] : row["start"] + SLICE] += np.frombuffer(row["counts"], np.float64).reshape(2, -1)
        told[1 - row["view"]] += row["told"]
    return (told[0], told[1]), [(c[0], c[1]) for c in counts]


def fit(docs: DataFrame, labels: DataFrame, where: str, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """Co-train on at most ``max_labelled`` labels and all other documents; tables go below ``where``."""
    chosen = materialize(_sample(labels, max_labelled), f"{where}/chosen")
    sample = _labelled(docs, chosen, where)
    share = {(r["held"], r["y"]): r["count"] for r in sample.withColumn("held", _is_held()).groupBy("held", "y").count().collect()}
    good = sum(n for (_, y), n in share.items() if y) / max(1, sum(share.values()))
    if len(share) < 4:  # a class is missing from what is fitted or from what is held out
        return Model(Logistic(), Logistic(), np.zeros(3), prior=float(good) if share else 1.0)

    keep = []
    for view in ("text", "meta"):
        n, ones = _counts(sample, view)
        mean = share[False, 1] / (share[False, 1] + share[False, 0])
        z = np.where(n >= LEAST, np.abs(ones - n * mean) / np.sqrt(np.maximum(n, 1) * mean * (1 - mean)), 0)
        best = np.flatnonzero(z >= Z)
        keep.append(np.sort(best[np.argsort(-z[best], kind="stable")[:MAX_FEATURES]]))
    masks = []
    for k in keep:
        mask = np.zeros(DIM, bool)
        mask[k] = True
        masks.append(mask)
    shared = docs.sparkSession.sparkContext.broadcast(masks)

    def gathered(lessons: list[np.ndarray | None] | None) -> pa.Table:
        """The sample with chosen features, or with the mean lesson of all features in place of features."""
        taught = docs.sparkSession.sparkContext.broadcast(lessons)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k, view in enumerate(("text", "meta")):
                    lists = batch.column(view)
                    ids, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                    rows = Rows(ids, np.concatenate([[0], np.cumsum(size)]), np.zeros((batch.num_rows, 0)))
                    if taught.value is None:
                        kept = shared.value[k][ids]
                        at = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(batch.num_rows), size)[kept], minlength=batch.num_rows))])
                        out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids[kept])))
                    else:
                        out.append(pa.array(np.zeros(batch.num_rows) if taught.value[k] is None else rows.sums(taught.value[k]) / np.maximum(size, 1)))
                yield pa.RecordBatch.from_arrays([batch.column("held"), batch.column("y"), batch.column("doc_id"), *out, batch.column("style")], names=["held", "y", "doc_id", "text", "meta", "style"])

        kind = "array<int>" if lessons is None else "double"
        fields = T.StructType.fromDDL(f"held boolean, y int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text {kind}, meta {kind}, style binary")
        return sample.select(_is_held().alias("held"), "y", "doc_id", "text", "meta", "style").mapInArrow(run, fields).toArrow().sort_by("doc_id")

    table = gathered(None)
    held, y = table["held"].to_numpy(), table["y"].to_numpy().astype(np.float64)
    train, kept = np.flatnonzero(~held), np.flatnonzero(held)
    views = [_rows(table, view) for view in ("text", "meta")]
    del table
    model = Model(Logistic(), Logistic(), np.zeros(3))
    pool = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    lessons: list[np.ndarray | None] = [None, None]
    for r in range(rounds + 1):
        means = gathered(lessons)
        logits = []
        for k, (name, view) in enumerate(zip(("text", "meta"), views, strict=True)):
            inputs = np.column_stack([view.dense, means[name].to_numpy(), np.ones(len(view))])
            logistic = Logistic(lesson=lessons[k]).fit(view.take(train), inputs[train], y[train])
            z = view.sums(logistic.w) + inputs @ logistic.v
            logistic.scale = tuple(_logit_fit(z[kept][:, None], y[kept]))
            logits.append(z[kept] * logistic.scale[0] + logistic.scale[1])
            setattr(model, name, logistic)
        if r == rounds:
            break
        right = y[kept].mean()
        # documents that score like the one at the bound are in, whatever rounding does
        model.sure = [(float(np.quantile(z, 1 - SURE * right)) - 1e-6, float(np.quantile(z, SURE * (1 - right))) + 1e-6) for z in logits]
        told, counts = _exchange(pool, model)
        model.exchanged.append(told)
        lessons = [lesson(*c) for c in counts]
    both = np.stack(logits, 1)
    mix = _logit_fit(both, y[kept])
    if mix[1] < 0:  # a view that would count against itself is left out
        mix = np.insert(_logit_fit(both[:, :1], y[kept]), 1, 0.0)
    model.mix = mix
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` and text_score, meta_score, score, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["text_score", "meta_score", "score", "keep"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(c, T.DoubleType()) for c in added[:3]] + [T.StructField("keep", T.BooleanType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in _pieces(whole):
                p = np.round(m.scores(*_views(batch)) if m.prior is None else np.full((batch.num_rows, 3), m.prior), 6)
                keep = p[:, 2] >= threshold if m.prior is None else np.ones(len(p), bool)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, c]) for c in range(3)), pa.array(keep)], names=[*names, *added])

    return docs.select(*[docs[f"`{c}`"] for c in names]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, where: str, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    return score(docs, fit(docs, labels, where, **bounds), threshold)
