"""Language of a text from a bidirectional gated recurrent network over its bytes.

A text is lower-cased and becomes its runs of letters, joined by single spaces, as UTF-8 bytes. It is
read in windows of ``SPAN`` bytes and ``CONTEXT`` more on either side, so that the state goes from word
to word and no position is labelled without what stands around it. One network reads a window forwards,
one backwards; their joined states label every position with probabilities of the languages. A
document's probability is the mean over all its letters' positions, each of which is in one window's
middle. The rest of a text (digits, marks) has no label.

The unit has one gate: ``h = z h + (1 - z) c`` with ``z`` and ``c`` from the byte and the state before. It
is written in numpy and trained by backpropagation through time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import is_held_out, mapped

#: Bytes that a window labels, and bytes of context that it reads before and after them.
SPAN, CONTEXT = 448, 32
EMBED, HIDDEN = 16, 16
#: Rows per language that training may see, and windows of ``TRAIN_SPAN`` bytes, from anywhere in the text, that each gives.
SAMPLE, PER_ROW, TRAIN_SPAN = 600, 24, 80
STEPS, BATCH = 420, 384
#: Windows that are labelled at once, and windows that are sorted by length before, so that those labelled together are alike.
AT_ONCE, HELD = 256, 8192

_WORD = re.compile(r"[^\W\d_]+")
#: Keeps bytes of lower-case letters and of characters beyond ASCII; makes all others spaces.
_SPACED = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[str]:
    """Runs of letters; what the pattern takes for letters besides (as a half, or a square) is none."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def letters(text: str) -> bytes:
    """The bytes that the network reads: words with a space before and after each; empty without words."""
    low = text.lower()
    other = [] if low.isascii() else [c for c in set(low) if c > "\x7f" and not c.isalpha()]
    if len(other) > 16:  # a pass for each would take longer than the pattern
        found = [w.encode("utf-8", "surrogatepass") for w in words(text)]
    else:
        for c in other:
            low = low.replace(c, " ")
        found = low.encode("utf-8", "surrogatepass").translate(_SPACED).split()
    return b" %b " % b" ".join(found) if found else b""


def windows(data: bytes) -> list[tuple[bytes, int, int]]:
    """(bytes, first, end) of every window: the positions from first to end are its to label."""
    out = []
    for i in range(0, len(data), SPAN):
        a = max(0, i - CONTEXT)
        out.append((data[a : i + SPAN + CONTEXT], i - a, min(i + SPAN, len(data)) - a))
    return out


class Gru:
    """One direction. Weights: embeddings ``e``, input weights ``w``, recurrent ``u``, bias ``b``; gate first, then candidate."""

    def __init__(self, rng):
        self.e = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.w = rng.normal(0, EMBED**-0.5, (EMBED, 2 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(2 * HIDDEN, np.float32)

    def parameters(self):
        return [self.e, self.w, self.u, self.b]

    def backward(self, x, mask, tape, out: np.ndarray):
        """Gradients of the parameters, from the gradient ``out`` of every state."""
        gt, gu = np.zeros((256, 2 * HIDDEN), np.float32), np.zeros_like(self.u)
        every, dh = np.empty((*x.shape, 2 * HIDDEN), np.float32), np.zeros_like(out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, c = tape[t]
            m = mask[t][:, None]
            d = (dh + out[t]) * m
            rest = (dh + out[t]) * ~m
            da = np.concatenate([d * (h - c) * z * (1 - z), d * (1 - z) * (1 - c * c)], axis=1)
            every[t] = da
            gu += h.T @ da
            dh = rest + d * z + da @ self.u.T
        order = np.argsort(x, axis=None, kind="stable")
        seen, first = np.unique(x.ravel()[order], return_index=True)
        gt[seen] = np.add.reduceat(every.reshape(-1, 2 * HIDDEN)[order], first)
        return [gt @ self.w.T, self.e.T @ gt, gu, gt.sum(0)]


def read(ahead: Gru, back: Gru, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (T, 2, B, H) for bytes (T, B), of one unit that reads forwards and one that reads backwards.

    Each unit's states are in the order in which it reads; a masked position keeps the state before it. Both
    units step together, with gates and candidates apart, so that what a step computes on is contiguous.
    """
    n, size = x.shape
    # the gate's logistic function as a hyperbolic tangent of half its input: one function for all columns
    half = np.concatenate([np.full(HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)])
    table = np.concatenate([(r.e @ r.w + r.b) * half for r in (ahead, back)]).reshape(512, 2, HIDDEN)
    u = np.stack([r.u * half for r in (ahead, back)]).reshape(2, HIDDEN, 2, HIDDEN)
    table, u = np.ascontiguousarray(table.transpose(1, 0, 2)), np.ascontiguousarray(u.transpose(2, 0, 1, 3))
    at = np.concatenate([x, x[::-1].astype(np.intp) + 256], axis=1)
    there = np.stack([mask, mask[::-1]], axis=1)[:, :, :, None]
    whole = mask.all(1) & mask.all(1)[::-1]
    h = np.zeros((2, size, HIDDEN), np.float32)
    states, tapes = np.empty((n, *h.shape), np.float32), ([], [])
    g, own = np.empty((2, *h.shape), np.float32), np.empty((2, 2 * size, HIDDEN), np.float32)
    for t in range(n):
        if keep:
            g = np.empty_like(g)
        np.matmul(h, u, out=g)
        table.take(at[t], axis=1, out=own, mode="clip")
        g += own.reshape(g.shape)
        np.tanh(g, out=g)
        z, c = g
        z *= 0.5
        z += 0.5
        new = np.subtract(h, c, out=states[t])
        new *= z
        new += c
        if not whole[t]:
            np.copyto(new, h, where=~there[t])
        if keep:
            for k, tape in enumerate(tapes):
                tape.append((h[k], z[k], c[k]))
        h = new
    return states, *tapes


class Labeller:
    """Both directions and a softmax over the languages at every position."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng), Gru(rng)
        self.v = rng.normal(0, 0.2, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    @staticmethod
    def padded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = max(map(len, rows))
        x = np.frombuffer(b"".join(r.ljust(n, b"\0") for r in rows), np.uint8).reshape(len(rows), n)
        return np.ascontiguousarray(x.T), np.arange(n)[:, None] < np.array([len(r) for r in rows])[None, :]

    def _states(self, x, mask, keep=False):
        states, tf, tb = read(self.ahead, self.back, x, mask, keep)
        return np.concatenate([states[:, 0], states[::-1, 1]], axis=2), tf, tb

    def _likely(self, x, mask) -> np.ndarray:
        """Probabilities (T, languages, B) of every position."""
        states, *_ = read(self.ahead, self.back, x, mask)
        z = self.v[:HIDDEN].T @ states[:, 0].swapaxes(1, 2)
        z += (self.v[HIDDEN:].T @ states[:, 1].swapaxes(1, 2))[::-1]
        z += self.c[:, None]
        if (np.abs(self.v).sum(0) + np.abs(self.c)).max() > 40:  # states lie between -1 and 1: else no logit overflows
            z -= z.max(1, keepdims=True)
        p = np.exp(z, out=z)
        p /= p.sum(1, keepdims=True)
        return p

    def label(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (T, B, languages) of every position, and which positions exist."""
        x, mask = self.padded(rows)
        return self._likely(x, mask).swapaxes(1, 2), mask

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities over each text's letters, and how many positions they are."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        held: list[tuple[bytes, int, int, int]] = []

        def settle():
            held.sort(key=lambda r: len(r[0]))
            for i in range(0, len(held), AT_ONCE):
                part = held[i : i + AT_ONCE]
                x, mask = self.padded([r[0] for r in part])
                at, who = np.arange(len(x))[:, None], np.array([r[3] for r in part])
                own = (x != 32) & (at >= np.array([r[1] for r in part])) & (at < np.array([r[2] for r in part]))
                p = self._likely(x, mask)
                p *= own[:, None]
                np.add.at(out, who, p.sum(0).T)
                np.add.at(n, who, own.sum(0))
            held.clear()

        for k, text in enumerate(texts):
            for w in windows(letters(text)):
                held.append((*w, k))
                if len(held) >= HELD:
                    settle()
        settle()
        return out / np.maximum(n, 1)[:, None], n

    def train(self, rows: list[bytes], truth: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        params = [*self.ahead.parameters(), *self.back.parameters(), self.v, self.c]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            k = rng.integers(0, len(rows), batch)
            x, mask = self.padded([rows[i] for i in k])
            s, tf, tb = self._states(x, mask, True)
            z = s @ self.v + self.c
            p = np.exp(z - z.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(batch), truth[k]] -= 1
            d = (p * mask[:, :, None] / mask.sum()).astype(np.float32)
            ds = d @ self.v.T
            grads = [
                *self.ahead.backward(x, mask, tf, ds[:, :, :HIDDEN]),
                *self.back.backward(x[::-1], mask[::-1], tb, ds[::-1, :, HIDDEN:]),
                np.einsum("tbh,tbl->hl", s, d),
                d.sum((0, 1)),
            ]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = 0.012 * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
            for i, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def _drawn(batches):
    """Windows from anywhere in each row's text; the row's text decides which."""
    for batch in batches:
        langs, found = [], []
        for lang, seed, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), strict=True):
            data = letters(text.as_py())
            rng = np.random.default_rng(seed % 2**63)
            for i in rng.integers(0, max(1, len(data) - TRAIN_SPAN + 1), min(PER_ROW, -(-len(data) // TRAIN_SPAN))).tolist():
                langs.append(lang)
                found.append(data[i : i + TRAIN_SPAN])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> Labeller | None:
    """Train on at most ``sample`` rows of each language, whose ids are not held out; None without any.

    Rows without text or language teach nothing; rows equal in id, language and text are one. The driver
    gets ``PER_ROW`` windows of a chosen row at most, from its whole text.
    """
    known = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "t")
    chosen = known.select("id", "lang", "t").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    # names of chosen rows are what is broadcast; equal rows meet before they are shuffled
    chosen = chosen.select(F.col("id").alias("i"), F.col("lang").alias("l"), F.col("t").alias("u")).distinct()
    rows = known.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.col("t") == F.col("u")))
    rows = rows.groupBy("id", "lang", "t").agg(F.first("text").alias("text")).select("lang", "t", "text")
    got = rows.transform(mapped, _drawn, "lang string, window binary").toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("window").to_pylist(), strict=True))
    languages = sorted({lang for lang, _ in pairs})
    if not languages:
        return None
    # every language alike: the same number of windows, drawn anew
    truth, rng = np.array([languages.index(lang) for lang, _ in pairs]), np.random.default_rng(1)
    pick = np.concatenate([rng.choice(np.flatnonzero(truth == k), 10_000) for k in range(len(languages))])
    return Labeller(languages).train([pairs[i][1] for i in pick], truth[pick], steps)


def identify(documents: DataFrame, model: Labeller | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letters, or no model
    could be trained. Whole texts are read; rows that repeat an id are predicted by their own text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            if model is None:
                p, seen, names = np.zeros((n, 1)), np.zeros(n), ["und"]
            else:
                p, seen = model.pooled([x.as_py() for x in batch.column(2)])
                names = model.languages
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([names[k] if s else "und" for k, s in zip(best, seen, strict=True)], pa.string()),
                    pa.array(np.where(seen > 0, np.clip(p[np.arange(n), best], 0, 1), 0.0), pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.transform(mapped, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text; one row per document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, learn(documents))
