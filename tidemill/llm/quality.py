"""Document quality from random-indexing word vectors and a two-layer network.

Every word (a run of letters and digits, or of other visible characters) falls into one of
``BUCKETS`` buckets, each with a sparse random index vector. A bucket's word vector is the sum of
the index vectors of its neighbours over all documents, so both tables have a fixed size whatever
the corpus. A document is pooled to the mean and the spread of its words' vectors and the likeness
of neighbouring words; a two-layer network, fitted on a bounded sample of labelled rows, scores
that, and a temperature fitted on rows that it has not seen calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import crc_of_id, is_held_out, mapped

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Labelled rows that the network is fitted on, at most; the only bounded statistic here.
SAMPLE = 12_000
THRESHOLD = 0.3
FEATURES = 2 * DIM + 3
#: Words of one text that are handled together.
SLICE = 200_000
#: Words of several texts handled at once: to sum word vectors, and to pool them.
SUMMED, POOLED = 131_072, 32_768
MEMO = 50_000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_MEMO: dict[str, int] = {}


def bucket_ids(text: str) -> np.ndarray:
    memo = _MEMO
    if len(memo) > MEMO:
        memo.clear()
    out = []
    for w in _TOKEN.findall(text):
        k = memo.get(w)
        if k is None:
            k = memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        out.append(k)
    return np.array(out, np.int32)


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the places and signs of its ``NONZERO`` ternary entries."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _slices(texts, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of consecutive texts with the text's number, about ``at_once`` words at a time; only texts of over
    ``SLICE`` words are cut."""
    ids, owners, n = [], [], 0
    for k, text in enumerate(texts):
        own = bucket_ids(text)
        for i in range(0, len(own), SLICE):
            part = own[i : i + SLICE]
            ids.append(part)
            owners.append(np.full(len(part), k, np.int64))
            n += len(part)
            if n >= at_once:
                yield np.concatenate(ids), np.concatenate(owners)
                ids, owners, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(owners)


def _gather(batches):
    """A task's share of every bucket's word vector, as whole numbers."""
    places, signs = index_vectors()
    sums, count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for ids, owner in _slices((x.as_py() for x in batch.column(0)), SUMMED):
            count += np.bincount(ids, minlength=BUCKETS)
            for gap in range(1, WINDOW + 1):
                same = owner[gap:] == owner[:-gap]
                left, right = ids[:-gap][same], ids[gap:][same]
                for a, b in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        sums += np.bincount(a.astype(np.int64) * DIM + places[b, j], signs[b, j], BUCKETS * DIM)
    _MEMO.clear()  # the worker may serve other operators next
    seen = np.flatnonzero(count)
    rows = np.rint(sums).astype(np.int64).reshape(BUCKETS, DIM)[seen]
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen, pa.int32()), pa.array(count[seen]), pa.ListArray.from_arrays(np.arange(0, rows.size + 1, DIM, dtype=np.int32), pa.array(rows.ravel()))],
        names=["bucket", "n", "vector"],
    )


def word_vectors(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets, from every document. ``BUCKETS`` x ``DIM`` numbers reach the driver."""
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = texts.transform(mapped, _gather, "bucket int, n long, vector array<long>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(DIM)])
    out = np.zeros((BUCKETS, DIM), np.float32)
    for row in sums.toLocalIterator():
        out[row[0]] = row[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; zeros for one without words."""
    n = len(texts)
    total, square, like = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros(n)
    count = np.zeros(n)
    distinct = np.zeros(n)
    for ids, owner in _slices(texts, POOLED):
        v = vectors[ids]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = owner[starts]
        total[who] += np.add.reduceat(v, starts)
        near = np.einsum("ij,ij->i", v[1:], v[:-1]) * (owner[1:] == owner[:-1])
        like += np.bincount(owner[1:], near, n)
        v *= v
        square[who] += np.add.reduceat(v, starts)
        count += np.bincount(owner, minlength=n)
        pairs = np.unique(owner * BUCKETS + ids)
        distinct += np.bincount(pairs // BUCKETS, minlength=n)
    m = np.maximum(count, 1)[:, None]
    mean = total / m
    spread = np.sqrt(np.maximum(square / m - mean**2, 0))
    rest = np.stack([like / np.maximum(count - 1, 1), np.log1p(count), distinct / m[:, 0]], axis=1)
    return np.concatenate([mean, spread, rest], axis=1)


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the logit."""

    hidden: int = 32
    seed: int = 11
    epochs: int = 60
    temperature: float = 1.0
    constant: float | None = None
    weights: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
        """``held``: rows kept from the weights, for the temperature."""
        if not len(y) or y.min() == y.max():  # nothing to tell apart
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        own = np.flatnonzero(~held) if (~held).sum() > 10 and len(np.unique(y[~held])) == 2 else np.arange(len(y))
        d, h = x.shape[1], self.hidden
        w = [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, h), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(self.epochs):
            order = rng.permutation(own)
            rate = 5e-3 * 0.5 * (1 + np.cos(np.pi * epoch / self.epochs))
            for i in range(0, len(order), 128):
                k = order[i : i + 128]
                a = np.tanh(x[k] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-(a @ w[2] + w[3])))
                e = (p - y[k]) / len(k)
                back = np.outer(e, w[2]) * (1 - a * a)
                grads = [x[k].T @ back + 1e-4 * w[0], back.sum(0), a.T @ e + 1e-4 * w[2], np.array([e.sum()])]
                t += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] = w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        rows = np.flatnonzero(held) if held.any() else own
        logit, truth = self._logit(x[rows]), y[rows]
        heats = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(truth > 0.5, -logit, logit) / q).mean() for q in heats]
        self.temperature = float(heats[int(np.argmin(loss))])
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logit(np.clip((x - self.mean) / self.scale, -8, 8)) / self.temperature
        return 1 / (1 + np.exp(-z))


def fit(documents: DataFrame, labels: DataFrame, vectors, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fit on at most ``sample`` labelled ids, taken by the hash of the id; held-out ids are never used.

    Rows that repeat an id are one training row, the one with the least features, so the driver never gets more than ``sample``.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    # only ids that exist get a place; the bounded sample is what is broadcast
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("id", "y", crc_of_id("id").alias("crc"), "text")

    def features(batches):
        for batch in batches:
            x = pooled(batch.column("text").to_pylist(), vectors.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), batch.column("crc"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "crc", "x"]
            )

    found = rows.transform(mapped, features, "id long, y double, crc long, x array<double>")
    got = found.groupBy("id", "y", "crc").agg(F.min("x").alias("x")).toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable") if got.num_rows else np.empty(0, int)
    x = np.array(got.column("x").to_pylist()).reshape(got.num_rows, FEATURES)[order]
    y, crc = got.column("y").to_numpy()[order], got.column("crc").to_numpy()[order]
    return Network().fit(x, y, crc % 5 == 1)


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Whole texts are read; null and empty texts are scored as texts without words. Rows that repeat
    an id are scored by their own text. Without labels of both kinds the score is their share, or
    0.5 without any. Other columns are ignored.
    """
    spark = documents.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(documents, text_col))  # BUCKETS x DIM floats: 2 MB
    network = fit(documents, labels, vectors, sample, id_col, text_col)

    def run(batches):
        for batch in batches:
            p = network.predict(pooled([x.as_py() for x in batch.column(2)], vectors.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )
        _MEMO.clear()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.transform(mapped, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the documents that the classifier accepts, with all their columns.

    Null and empty texts are scored as texts without words; repeated rows stay or go together; without labels of
    both kinds all have one score; an empty table stays empty. Any other columns, whatever their names, are kept.
    """
    spark = documents.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(documents))
    network = fit(documents, labels, vectors)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            p = network.predict(pooled([x or "" for x in batch.column(at).to_pylist()], vectors.value))
            yield batch.filter(pa.array(p >= THRESHOLD))
        _MEMO.clear()

    return documents.transform(mapped, run, documents.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text; one row per document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
