"""Repeated passages by longest-previous-factor arrays, over a corpus of any size.

1. Anchors. The anchor of a passage of ``length`` bytes is the least hash of its byte 32-grams, so
   equal passages have equal anchors. Neighbouring passages mostly share theirs: a text falls into
   stretches, runs of passages with one anchor.
2. Contexts. An anchor seen once can't be a repeated passage's. Of the others, the context (the
   bytes of a stretch's passages) decides. Equal contexts are copies of one another outright; one
   of each kind goes on.
3. Suffix order. The contexts of an anchor are laid end to end and the suffixes long enough to
   start a passage are sorted. In that order the previous and the next smaller position are the
   nearest earlier places, and the larger of the two common prefixes is the longest previous
   factor. Where it reaches ``length``, the position is a later copy, and those smaller positions
   that share so much are what it copies.
4. Cutting. Positions become byte runs per text.

An anchor whose different contexts hold more than ``GROUP`` bytes is not sorted in one task: its
contexts are taken as texts of their own and go through the same steps with longer grams, which deal
them out to anchors that fewer share. With grams as long as a passage, an anchor has one context, all
of whose places are copies outright; so no task ever holds an unbounded group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import as_bytes, discard, mapped, numbered, renamed, split_by_keys, written

LENGTH = 400
GRAM = 32
#: Bytes of different contexts of one anchor that one task sorts, at some 100 bytes of memory each; a context has some 600.
GROUP = 1 << 20
#: Bytes of contexts sorted at once; so much stays in a core's cache.
CHUNK = 1 << 18
#: Passages of one text that are looked at together; longer texts are taken piece by piece.
SEGMENT = 4 << 20
#: Rows that a task hands on at once, or a few more.
ROWS = 100_000

_U = np.uint64
_MULT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by running extremes inside blocks."""
    n = len(x) - width + 1
    fill = x.max() if pick is np.minimum else x.min()
    rows = np.concatenate([x, np.full(-len(x) % width, fill, x.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    n = len(data) - gram + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = word[:n] * _MULT[0]
    for i, at in enumerate([*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])], 1):
        h = (h ^ (h >> _U(29))) * _MULT[1] if i > 3 else h ^ (h >> _U(29))
        h = h + word[at : at + n] * _MULT[i % 4]
    h ^= h >> _U(32)
    h *= _MULT[1]
    h ^= h >> _U(29)
    return h


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, last, anchor, multi``: runs of passages (by their first byte) with one anchor.

    Every passage of the text is in one run. ``multi``: the anchor is at several places of the run, so
    that the run may repeat itself. A run ends where a piece of ``SEGMENT`` passages does. With grams as
    long as a passage every run is one passage.
    """
    if len(data) > SEGMENT + length:
        parts = [(i, stretches(data[i : i + SEGMENT + length - 1], length, gram)) for i in range(0, len(data) - length + 1, SEGMENT)]
        first, last = (np.concatenate([i + p[k] for i, p in parts]) for k in (0, 1))
        return first, last, *(np.concatenate([p[k] for _, p in parts]) for k in (2, 3))
    width = length - gram + 1
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), none.astype(bool)
    h = gram_hashes(data, gram)
    if width == 1:
        every = np.arange(len(h))
        return every, every, h, np.zeros(len(h), bool)
    least = _slide(h, width, np.minimum)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, len(least) - 1]
    anchor = least[first]
    # the places of each run's anchor: grams that are the least of a window, those inside the run that equal it
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([edge, least, edge]), width, np.maximum))
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last + width)
    n = hi - lo
    run = np.repeat(np.arange(len(first)), n)
    inside = h[at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] == anchor[run]
    return first, last, anchor, np.bincount(run[inside], minlength=len(first)) > 1


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


_STRETCHES = "key long, at long, doc_id long, a long, b long, anchor long, multi boolean, context long"


def _stretch_rows(length: int, gram: int):
    """Stretches of ``pieces(key, at, doc_id, text)``, by their places in the whole text."""

    def packed(batch, cols):
        row, a, b, anchor, multi, own = (np.concatenate(c) for c in cols)
        taken = [batch.column(k).take(pa.array(row)) for k in ("key", "at", "doc_id")]
        return pa.RecordBatch.from_arrays([*taken, *map(pa.array, (a, b, anchor, multi, own))], names=[x.split()[0] for x in _STRETCHES.split(", ")])

    def run(batches):
        for batch in batches:
            cols, n = [[] for _ in range(6)], 0
            for k, (at, text) in enumerate(zip(batch.column("at").to_pylist(), batch.column("text"), strict=True)):
                data = text.as_py()
                first, last, anchor, multi = stretches(data, length, gram)
                if not len(first):
                    continue
                own = [xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                for col, part in zip(cols, (np.full(len(first), k), at + first, at + last + length, _signed(anchor), multi, _signed(np.array(own, np.uint64))), strict=True):
                    col.append(part)
                n += len(first)
                if n >= ROWS:
                    yield packed(batch, cols)
                    cols, n = [[] for _ in range(6)], 0
            if n:
                yield packed(batch, cols)

    return run


def _context_rows(batches):
    """The bytes of the wanted stretches of ``pieces``; each is a piece of its text in turn."""
    names = ["anchor", "key", "at", "doc_id", "text"]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=names)

    for batch in batches:
        docs = zip(*[batch.column(k).to_pylist() for k in ("key", "doc_id", "at", "wanted")], batch.column("text"), strict=True)
        out, size = [[], [], [], [], []], 0
        for key, doc, at, wanted, text in docs:
            data = text.as_py()
            for w in wanted:
                for col, x in zip(out, (w["anchor"], key, w["a"], doc, data[w["a"] - at : w["b"] - at]), strict=True):
                    col.append(x)
                size += w["b"] - w["a"]
                if size >= 8 << 20:
                    yield packed(out)
                    out, size = [[], [], [], [], []], 0
        yield packed(out)


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint32)


class SuffixOrder:
    """Suffixes of a text of at least ``length`` bytes each, sorted by their first ``length`` bytes.

    ``starts`` are their places. Ranks of 8 bytes are joined three by three (two by two where three
    don't fit a word) to ranks of 24, 72, 216 ... bytes; two overlapping ranks give the order.
    ``common`` has the bytes that neighbours in order share, as far as the ranks tell them apart.
    """

    def __init__(self, text: bytes, starts: np.ndarray, length: int = LENGTH):
        word = np.ndarray((len(text),), ">u8", text + b"\0" * 8, strides=(1,)).astype(np.uint64)
        self.length, self.starts, self.ranks = length, starts, {8: _rank(word)}
        size = 8
        while 2 * size < length:
            rank = self.ranks[size]
            base = int(rank.max()) + 2
            times = 3 if base**3 < 2**62 and 3 * size <= length else 2
            key = rank.astype(np.int64) + 1
            for k in range(1, times):
                key *= base
                if k * size < len(rank):
                    key[: -k * size] += rank[k * size :].astype(np.int64) + 1
            size *= times
            self.ranks[size] = _rank(key)
        head, tail = self.ranks[size][starts].astype(np.int64), self.ranks[size][starts + length - size].astype(np.int64)
        key = head * (int(tail.max(initial=0)) + 1) + tail
        self.order = np.argsort(key)
        key = key[self.order]
        self.same = key[1:] == key[:-1]  # neighbours equal over the whole length
        self.common = self._common()

    def _common(self) -> np.ndarray:
        out = np.zeros(max(0, len(self.order) - 1), np.int64)
        a, b = self.starts[self.order[:-1]], self.starts[self.order[1:]]
        todo = np.flatnonzero(~self.same)
        for size in sorted(self.ranks, reverse=True):
            rank = self.ranks[size]
            for _ in range(2):  # no rank fits a third time into what the larger ones left
                at, to = a[todo] + out[todo], b[todo] + out[todo]
                inside = (np.maximum(at, to) < len(rank)) & (out[todo] + size <= self.length)
                equal = inside & (rank[np.where(inside, at, 0)] == rank[np.where(inside, to, 0)])
                out[todo[equal]] += size
        out[self.same] = self.length
        return np.where(self.same, self.length, np.minimum(out, self.length - 1))


def smaller_before(value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest place before it with a smaller value (or -1) and the
    prefix in common with it. Places that aren't smaller are jumped over, and jumps are doubled."""
    n = len(value)
    at = np.arange(-1, n - 1)
    low = np.r_[0, common] if n else np.empty(0, np.int64)
    low = low.astype(np.int64)
    while True:
        todo = np.flatnonzero((at >= 0) & (value[np.maximum(at, 0)] >= value))
        if not len(todo):
            return at, np.where(at >= 0, low, 0)
        over = at[todo]
        low[todo] = np.minimum(low[todo], low[over])
        at[todo] = at[over]


def longest_previous(order: SuffixOrder, place: np.ndarray):
    """The longest-previous-factor array and its two sources, in suffix order.

    ``place`` numbers the suffixes by their place in the corpus; equal numbers are one place. Returns
    ``(lpf, previous smaller, its prefix, next smaller, its prefix)``, sources as indices or -1.
    """
    value = place[order.order]
    before, a = smaller_before(value, order.common)
    after, b = smaller_before(value[::-1], order.common[::-1])
    after, b = np.where(after >= 0, len(value) - 1 - after, -1)[::-1], b[::-1]
    return np.maximum(a, b), before, a, after, b


def copies(contexts: list[tuple[int, int, int, bytes]], length: int = LENGTH):
    """Passages with another place among ``contexts(key, doc_id, start, bytes)``.

    Returns arrays ``key, first byte, later``: every such passage once, and whether an equal one lies
    before it in the order of (doc_id, key, position).
    """
    text = b"".join(c[3] for c in contexts)
    sizes = np.array([len(c[3]) for c in contexts])
    offset = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    context = np.repeat(np.arange(len(contexts)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    docs = sorted({((c[1] is None, c[1] or 0), c[0]) for c in contexts})
    number = {key: k for k, (_, key) in enumerate(docs)}
    doc = np.array([number[c[0]] for c in contexts])
    start = np.array([c[2] for c in contexts])[context] + inside
    place = (doc[context] << 40) + start
    order = SuffixOrder(text, offset[context] + inside, length)
    lpf, before, a, after, b = longest_previous(order, place)
    mine = place[order.order]
    later = lpf >= length
    sources = np.concatenate([before[a >= length], after[b >= length]])
    hit = np.concatenate([mine[later], mine[sources]])
    hit, first = np.unique(hit[::-1], return_index=True)
    is_later = np.isin(hit, mine[later])
    keys = np.array([key for _, key in docs], np.int64)
    return keys[hit >> 40], hit & ((1 << 40) - 1), is_later


def _runs(key: np.ndarray, first: np.ndarray, length: int):
    """Passages sorted by key and position, as byte runs."""
    new = np.r_[True, (key[1:] != key[:-1]) | (first[1:] > first[:-1] + 1)]
    last = np.r_[new[1:], True]
    return key[new], first[new], first[last] + length


def _sorted_groups(length: int, keep_first: bool):
    """Contexts come sorted by anchor; whole groups are joined until there is a chunk to sort."""

    def run(batches):
        held: list = []
        size, group = 0, None

        def out():
            key, first, later = copies(held, length)
            if keep_first:
                key, first = key[later], first[later]
            if not len(key):
                return None
            by = np.lexsort([first, key])
            k, a, b = _runs(key[by], first[by], length)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(a), pa.array(b)], names=["key", "a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("anchor", "key", "doc_id", "at")]
            for anchor, key, doc, start, data in zip(*cols, batch.column("text"), strict=True):
                if anchor != group:
                    if size >= CHUNK:
                        if (got := out()) is not None:
                            yield got
                        held, size = [], 0
                    group = anchor
                held.append((key, doc, start, data.as_py()))
                size += len(held[-1][3])
        if held and (got := out()) is not None:
            yield got

    return run


_RUN = "key long, a long, b long"


def _grams(length: int) -> list[int]:
    """Gram lengths, from the first that anchors are taken from to a whole passage; what a passage has beside
    its gram shrinks by four, so that an anchor's contexts reach less and less beyond what they share."""
    rest = length - GRAM
    out = [GRAM]
    while rest >= 16:
        rest //= 4
        out.append(length - rest)
    return out if out[-1] == length else [*out, length]


def repeated_runs(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, group: int = GROUP) -> DataFrame:
    """Byte runs ``key, a, b`` covered by repeated passages in ``docs(key, doc_id, text)``; runs may overlap.

    With ``keep_first`` the first place of each passage, by (doc_id, key, position), isn't covered.
    """
    if length < 2 * GRAM:
        raise ValueError(f"passages have {2 * GRAM} bytes or more")
    pieces, found = docs.withColumn("at", F.lit(0).cast("long")), None
    for gram in _grams(length):
        runs, pieces = _level(pieces, length, gram, keep_first, group, first=found is None)
        found = runs if found is None else found.unionByName(runs)
        if pieces is None:
            return found
    raise AssertionError("an anchor as long as a passage has one context")


def _level(pieces: DataFrame, length: int, gram: int, keep_first: bool, group: int, first: bool) -> tuple[DataFrame, DataFrame | None]:
    """Runs among ``pieces(key, at, doc_id, text)`` of texts, and the contexts left to longer grams, if any."""
    every = written(pieces.transform(mapped, _stretch_rows(length, gram), _STRETCHES), "stretches")
    common = every.groupBy("anchor").agg(F.count("*").alias("c"), F.max("multi").alias("m")).where("c > 1 or m").select("anchor")
    kept = written(every.join(common, "anchor"), "shared")
    discard(every)

    # equal contexts have equal anchors: two hashes and the length tell them apart
    same = ["anchor", "context", "size"]
    shared = kept.withColumn("size", F.col("b") - F.col("a"))
    alike = shared.groupBy(same).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "a", "b", "at")).alias("first"), F.max("multi").alias("m")
    )
    alike = written(alike, "contexts")
    copied = shared.join(alike.where("n > 1").select(*same, "first"), same)
    if keep_first:
        copied = copied.where(~(F.struct("key", "a") == F.struct("first.key", "first.a")))
    outright = written(copied.select("key", "a", "b"), "copied")
    discard(kept)

    sizes = alike.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("k"), F.max("m").alias("m"))
    sizes = sizes.where("n > 1 or m").select("anchor", (F.col("k") > group).alias("large"))
    chosen = alike.join(sizes, "anchor").select("anchor", "large", "first.key", "first.a", "first.b", "first.at")
    wanted = chosen.groupBy("key", "at").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("wanted"))  # a text's own stretches
    wanted = written(wanted, "wanted")
    large = written(chosen.where("large").select("anchor").distinct(), "large")
    discard(alike)
    asked = split_by_keys(pieces, "key", wanted.select("key"))[0] if first else pieces
    contexts = asked.join(wanted, ["key", "at"]).transform(mapped, _context_rows, "anchor long, key long, at long, doc_id long, text binary")
    if large.isEmpty():
        parts, rest = contexts, None
    else:
        contexts = written(contexts, "contexts")
        parts = contexts.join(large, "anchor", "left_anti")
        rest = contexts.join(large, "anchor", "left_semi").drop("anchor")
    sorted_rows = parts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "at")
    return outright.unionByName(sorted_rows.transform(mapped, _sorted_groups(length, keep_first), _RUN)), rest


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows equal in id and text share a key: what holds for one holds for the other."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _with_spans(documents: DataFrame, length: int, keep_first: bool, id_col: str, text_col: str, group: int) -> DataFrame:
    docs = _keyed(documents, id_col, text_col)
    runs = repeated_runs(docs, length, keep_first, group)
    spans = written(runs.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")  # one text's own runs
    possible, clear = split_by_keys(docs, "key", spans.select("key"))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    return possible.join(spans, "key", "left").unionByName(clear.withColumn("spans", none))


def repeated_bytes(
    documents: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, text`` of every row.

    ``text`` is what is kept, without the halves of characters that a cut leaves. A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere, in this or
    another text (with ``keep_first``: starts before). Null and empty texts, and those shorter than
    ``length``, keep all. Rows equal in id and text are copies of one another (with ``keep_first``
    their shared text has one place and both rows keep it). Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data, spans = text.as_py(), _united(spans)
                left = without(data, spans)
                row = (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [a for a, _ in spans], [b for _, b in spans], left.decode("utf-8", "ignore"))
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "text"],
            )

    return _with_spans(documents, length, keep_first, id_col, text_col, group).transform(mapped, 
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, text string"
    )


def _cut(data: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left, as text; a cut inside a character takes the whole character."""
    return without(data, spans).decode("utf-8", "ignore")


def cut_later_copies(documents: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``documents`` with every passage of ``length`` bytes cut out wherever it starts again.

    Columns, whatever their names, and types stay; ``n_chars`` is counted anew if there. Rows of which nothing but white
    space is left go; rows that nothing is cut from, null and empty texts among them, stay as they are.
    Rows without an id are texts of their own that come after all ids. Rows that repeat an id with its text
    are one document and are cut alike (the stage before this one leaves one of them). An empty table stays empty.
    """
    given = documents.columns
    documents, id_col, text_col, size_col = renamed(documents, id_col, text_col, "n_chars")
    names = documents.columns
    doc, txt, keys = F.col("__id"), as_bytes(text_col), ["__key", "__spans"]
    documents, kinds = numbered(documents, id_col), documents.schema
    runs = repeated_runs(_keyed(documents, "__id", text_col), length, True, group)
    spans = runs.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    spans = written(spans, "spans")
    possible, clear = split_by_keys(documents.withColumn("__key", F.xxhash64(doc, txt)), "__key", spans.select("__key"))
    joined = possible.join(spans, "__key", "left")
    whole = joined.where("__spans is null").drop(*keys).select(names).unionByName(clear.select(names))

    def run(batches):
        for batch in batches:
            texts = [_cut(t.encode("utf-8", "surrogatepass"), _united(s)) for t, s in zip(batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if c == text_col else pa.array([len(t) for t in texts], batch.column(c).type) if c == size_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array([bool(t.strip()) for t in texts]))

    cut = joined.where("__spans is not null").select(*names, "__spans").transform(mapped, run, kinds)
    return whole.unionByName(cut).toDF(*given)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of whole texts in strings of 400 bytes that start anywhere else, and the text that is kept; one row per document."""
    found = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400, keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


ORACLE_OP6 = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 399)) AS i, h FROM d WHERE len(h) >= 800),
w AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 800)) AS s FROM p),
r AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - 400 <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY doc_id, span),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
c AS (SELECT t.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
             string_agg(substring(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
      FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256,
       CASE WHEN c.doc_id IS NULL THEN decode(unhex(h)) ELSE decode(unhex(array_to_string(list_filter(
         regexp_extract_all(kept || substring(h, 2 * last + 1),
           '[0-7].|(?:c[2-9a-f]|d.)[89ab].|e0[ab].[89ab].|e[1-9abcef](?:[89ab].){2}|ed[89].[89ab].|f0[9ab].(?:[89ab].){2}|f[123](?:[89ab].){3}|f48.(?:[89ab].){2}|..'),
         lambda x: len(x) > 2 OR x < '8'), ''))) END AS text
FROM d LEFT JOIN c USING (doc_id)
"""
