"""Near-duplicate documents from bottom-k MinHash sketches.

One hash function orders the shingles of a document; the ``K`` smallest values are its sketch.
Documents with equal sets are one class from the start. Then:

1. Inverted lists of retained values generate overlaps. Two sets of similarity 0.8 share at
   least ``OVERLAP`` of their ``K`` values (but for about one pair in 6 * 10^7, see ``OVERLAP``), so
   they meet in the list of one of the ``K - OVERLAP + 1`` rarest values of either sketch; only
   those values get list entries, and a word pair that half the corpus has gets none. Lists are
   kept apart by size: sets of which one has less than 0.8 of the other's size never meet.
2. Each entry's class is compared with the most central class of its lists, the one whose own
   sketch is shared most. Confirmed links give components.
3. Lists whose members are in several components leave pairs to decide. Members outside a
   list's largest component are indexed in blocks of bounded size, all members of their lists
   stream past, union-sketch estimation drops clear strangers and an exact comparison of the
   full sets of the others decides, as in step 2. No pair is ever a row: a task reports the components that it joins.

A list, a centre or a class may hold any share of all rows: lists are only counted, joined by
key and dealt out in salted blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import LOWER, as_bytes, discard, mapped, numbered, renamed, split_by_keys, written
from tidemill.llm.graph import components

K = 64
#: Of 64 draws at similarity 0.8, fewer than 32 are shared once in 6 * 10^7.
OVERLAP = 32
#: Classes indexed together, and classes that stream past one copy of an index.
BLOCK, STREAM = 2048, 8192
#: Words whose hash a Python worker remembers.
MEMO = 100_000

_HASHES: dict[bytes, int] = {}
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; of the whole sequence if it is shorter."""
    words = data.translate(LOWER).split()  # bytes split on exactly space and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    memo = _HASHES
    if len(memo) > MEMO:
        memo.clear()
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    h = np.array(out, np.uint64)
    m = min(n, len(h))
    acc = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - m + 1 + i])
    return np.unique(acc)


def _sketches(n: int):
    def run(batches):
        for batch in batches:
            sizes, sigs, sketches = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                sigs.append(_sig(s) if len(s) else None)
                sketches.append(s[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "sig", "sketch"],
            )
        _HASHES.clear()  # the worker may serve other operators next

    return run


def _bands(n: str):
    """The size bands of a set: two sets of which the smaller has 0.8 of the larger's size share one.

    Bands are three times as wide as that ratio, so that only the sets in the lower third of one are in
    the band below too.
    """
    x = F.log(F.col(n).cast("double")) / (3 * math.log(1.25))
    return F.array_distinct(F.array(F.floor(x), F.floor(x - (1 / 3 + 1e-9))))


def _entries(classes: DataFrame) -> DataFrame:
    """``v, sig, central``: the inverted lists' entries, of lists with two members or more.

    There is a list for each retained value and size band; its name ``v`` begins with how common it is,
    so that the order of names is the order of rarity.
    """
    k = F.least(F.col("n"), F.lit(K)).cast("int")
    banded = classes.select("sig", "sketch", k.alias("k"), F.explode(_bands("n")).alias("band"))
    own = F.xxhash64("v", "band").bitwiseAND(F.lit((1 << 56) - 1))
    # a set's band and how many values it retains go in one number: these are the most rows there are
    values = banded.select("sig", "band", (F.col("band") * 256 + F.col("k")).cast("int").alias("band_k"), F.explode("sketch").alias("v"))
    values = values.select("sig", "band_k", own.alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    rarity = F.least(F.lit(127), F.floor(F.log2("df") * 3)).cast("long")
    shared = shared.select("v", F.shiftleft(rarity, 56).bitwiseOR(F.col("v")).alias("name"))
    lists = values.join(shared, "v").groupBy("sig", "band_k").agg(F.collect_list("name").alias("e"))  # K at most
    k = F.pmod("band_k", F.lit(256))
    # a class of fewer than K values retains all: that is its size
    need = F.least(F.lit(OVERLAP), F.ceil(k * 4 / 5)).cast("int")
    # the values that no other class of the band has come first among the rarest, and make no entries
    take = F.greatest(F.lit(0), F.size("e") - need + 1)
    return lists.select(F.explode(F.slice(F.array_sort("e"), F.lit(1), take)).alias("v"), "sig", (F.size("e") / k).alias("central"))


#: Fills up short sketches; sketches are shipped as the upper 32 bits of their values, in order.
_NONE = np.uint32(0xFFFFFFFF)


def estimate(sketches: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``sketches`` with ``one``: shared values in the sketch of the union, and that sketch's size.

    Rows are sorted and filled up with the largest value; the sketch of a union is the ``K``
    smallest of both sketches' values.
    """
    both = np.sort(np.concatenate([sketches, np.tile(one, (len(sketches), 1))], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), ~again], axis=1), axis=1)
    real = both != _NONE
    inside = real & (rank <= K)
    return (again & inside[:, 1:]).sum(1), np.where(inside, rank, 0).max(1)


def _padded(brief: list[int]) -> np.ndarray:
    return np.concatenate([np.array(brief, np.int64).astype(np.uint32), np.full(K - len(brief), _NONE)])


class _Sketches:
    """Sketches of a block's indexed classes, looked up by the values they retain."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = np.stack(rows)
        flat = self.rows.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[: np.searchsorted(flat[order], _NONE)]
        self.values, self.owner = flat[order], order // K
        self.sizes = (self.rows != _NONE).sum(1)

    def near(self, one: np.ndarray) -> np.ndarray:
        """Which rows' similarity to ``one`` may reach 0.8, by shared values and then by the union's sketch."""
        own = one[one != _NONE]
        lo, hi = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        overlap = np.bincount(self.owner[at], minlength=len(self.rows))
        k = np.flatnonzero(overlap >= np.minimum(OVERLAP, np.ceil(0.8 * np.maximum(self.sizes, len(own)))))
        if len(k):
            shared, size = estimate(self.rows[k], one)
            k = k[shared >= np.minimum(OVERLAP, np.ceil(0.8 * size))]
        return k


def _screen(batches):
    """Of each block, the indexed and the streaming classes that a union sketch lets pass for near."""
    block, rows, held, used, index = None, [], [], np.zeros(0, bool), None
    kinds = {"block": pa.int64(), "salt": pa.int32(), "indexed": pa.bool_(), "sig": pa.int64(), "label": pa.int64()}

    def flush(out):
        for k in np.flatnonzero(used):
            out.append((*block, True, *held[k]))

    def packed(out):
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    for batch in batches:
        out = []
        for b, salt, indexed, sig, label, brief in zip(*[batch.column(k).to_pylist() for k in (*kinds, "brief")], strict=True):
            if (b, salt) != block:
                if block:
                    flush(out)
                block, rows, held, used, index = (b, salt), [], [], np.zeros(0, bool), None
            if indexed:
                rows.append(_padded(brief))
                held.append((sig, label))
                continue
            if not held:
                continue
            if index is None:
                index, used = _Sketches(rows), np.zeros(len(held), bool)
            near = [k for k in index.near(_padded(brief)) if held[k][1] != label]
            if near:
                used[near] = True
                out.append((b, salt, False, sig, label))
        yield packed(out)
    if block:
        out = []
        flush(out)
        yield packed(out)


class _Index:
    """Full sets of up to ``BLOCK`` classes, searched by the sets that stream past."""

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.labels: list[int] = []
        self.parent: dict[int, int] = {}
        self.values = None

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, label: int, s: np.ndarray) -> None:
        self.sets.append(s)
        self.labels.append(label)
        self.values = None

    def _build(self) -> None:
        every = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        order = np.argsort(every, kind="stable")
        self.values, self.owner = every[order], owner[order]
        self.sizes = np.array([len(x) for x in self.sets])

    def search(self, label: int, s: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Links that join two components not joined here before."""
        if self.values is None:
            self._build()
        lo, hi = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sets))
        out = []
        for k in np.flatnonzero(100 * common >= percent * (self.sizes + len(s) - common)):
            a, b = self.root(self.labels[k]), self.root(label)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((self.labels[k], label))
        return out


def _sig(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _verify(n: int, percent: int):
    """Rows come sorted by block, indexed classes first. A text that isn't its class's (rows can share
    an id) is passed over."""

    def run(batches):
        block, index = None, None
        for batch in batches:
            a, b = [], []
            cols = [batch.column(k).to_pylist() for k in ("block", "salt", "indexed", "sig", "label")]
            for where_block, salt, indexed, sig, label, text in zip(*cols, batch.column("text"), strict=True):
                if (where_block, salt) != block:
                    block, index = (where_block, salt), _Index()
                s = shingle_set(text.as_py(), n)
                if not len(s) or _sig(s) != sig:
                    continue
                if indexed:
                    index.add(label, s)
                elif index.sets:
                    for x, y in index.search(label, s, percent):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        _HASHES.clear()

    return run


def _confirm(blocks: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links between ``blocks(block, sig, label)`` and ``members(block, sig, label)``, written.

    A block that many classes stream past is copied to as many salts as it takes. Sketches go first;
    texts are fetched for the classes whose sketches pass.
    """
    size = members.groupBy("block").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("salts"))
    held = (
        blocks.join(size, "block")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("block", "salt", F.lit(True).alias("indexed"), "sig", "label")
    )
    stream = members.join(size, "block").select(
        "block", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("indexed"), "sig", "label"
    )
    brief = classes.select("sig", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("brief"))
    rows = held.unionByName(stream).join(brief, "sig").repartition("block", "salt").sortWithinPartitions("block", "salt", F.desc("indexed"))
    near = written(rows.transform(mapped, _screen, "block long, salt int, indexed boolean, sig long, label long"), "near")
    named = near.join(classes.select("sig", "rep"), "sig")
    ids = named.select("rep").distinct()
    asked, _ = split_by_keys(docs, "doc_id", ids)
    rows = named.withColumnRenamed("rep", "doc_id").join(asked, "doc_id").drop("doc_id")
    rows = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", F.desc("indexed"))
    links = written(rows.transform(mapped, _verify(n, percent), "a long, b long"), "links")
    discard(near)
    return links


def near_duplicates(
    documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: ``doc_id, n_shingles`` (distinct ``n``-word shingles),
    ``component_id`` (the smallest id reachable over links), ``kept`` (this row has that id).
    Texts without words, and null texts, have no shingles and no links. Rows that repeat an id
    are rows of one document: each is linked by its own text. Rows without an id take part in
    their class of equal sets but never get to name a group; without any id in it the group is
    null and its rows are kept. ``percent`` must be 80 or more, as the sketches are cut for it.
    """
    if percent < 80:
        raise ValueError("sketches are cut for similarities of 0.8 and more")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    sketches = written(docs.transform(mapped, _sketches(n), "doc_id long, n_shingles long, sig long, sketch array<long>"), "sketches")
    worded = sketches.where("sig is not null")
    # only sets that come again have to be shuffled
    again = worded.groupBy("sig").count().where("count > 1").select("sig")
    possible, clear = split_by_keys(worded, "sig", again)
    classes = possible.groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    reps = written(clear.select("sig", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch").unionByName(classes), "classes")
    documents = written(sketches.select("doc_id", "n_shingles", "sig"), "documents")
    discard(sketches)
    entries = written(_entries(reps.where("rep is not null")), "entries")

    # 2. each class against the centre that most of its lists name
    centres = entries.groupBy("v").agg(F.max(F.struct("central", "sig")).alias("c")).select("v", F.col("c.sig").alias("centre"))
    named = entries.join(centres, "v").where("sig <> centre").groupBy("sig", "centre").agg(F.count("*").alias("times"))
    best = named.groupBy("sig").agg(F.max(F.struct("times", "centre")).alias("b"))
    pairs = written(best.select("sig", F.col("b.centre").alias("block")), "centres")
    blocks = pairs.select("block").distinct().select("block", F.col("block").alias("sig"), F.col("block").alias("label"))
    first = _confirm(blocks, pairs.select("block", "sig", F.col("sig").alias("label")), reps, docs, n, percent)
    discard(pairs)
    joined = components(first)

    # 3. lists that hold several components
    at = entries.select("v", "sig").join(joined.withColumnRenamed("node", "sig"), "sig", "left")
    at = written(at.select("v", "sig", F.coalesce("component", "sig").alias("label")), "labelled")
    discard(entries)
    sizes = at.groupBy("v", "label").agg(F.count("*").alias("c")).groupBy("v")
    mixed = sizes.agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("size"), F.count("*").alias("k")).where("k > 1")
    minor = at.join(mixed.select("v", F.col("m.label").alias("major"), "size"), "v").where("label <> major")
    minor = written(minor.select("v", "sig", "label", "size"), "minor")
    # a family's classes share many lists of about one size: all of them go by the one with the largest value
    large = F.struct(F.floor(F.log2("size")).alias("size"), "v")
    home = minor.groupBy("sig", "label").agg(F.max(large).alias("h")).select("sig", "label", F.col("h.v").alias("home"))
    chunks = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    home = home.join(chunks, "home").select(
        "sig", "label", F.xxhash64("home", F.pmod(F.xxhash64("sig"), F.col("chunks"))).alias("block")
    )
    home = written(home, "blocks")
    lists = minor.select("v", "sig").join(home.select("sig", "block"), "sig").select("v", "block").distinct()
    members = lists.join(at, "v").select("block", "sig", "label").distinct()
    second = _confirm(home, members, reps, docs, n, percent)
    discard(at, minor, home)
    group = components(first.unionByName(second))

    labels = reps.select("sig", "rep").join(group.withColumnRenamed("node", "sig"), "sig", "left")
    labels = written(labels.select("sig", "rep", F.coalesce("component", "sig").alias("group")), "groups")
    discard(reps)
    ids = labels.groupBy("group").agg(F.min("rep").alias("component_id"))
    names = labels.join(ids, "group").select("sig", "component_id")
    out = documents.join(names, "sig", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Rows that repeat an id and are kept are one document: one of them stays. Rows without an id are
    documents of their own that come after all ids. Null and empty texts stay, but for repeated ids; an empty
    table stays empty; other columns, whatever their names, are kept. Only rows of ids that are dropped or
    repeated are shuffled.
    """
    plain, id_col, text_col = renamed(documents, id_col, text_col)
    keyed = numbered(plain, id_col)
    found = written(near_duplicates(keyed, n, percent, "__id", text_col).select("doc_id", "kept"), "kept")
    per = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = per.where("not kept or n > 1").select("doc_id")
    possible, clear = split_by_keys(keyed, "__id", odd)
    stay = per.where("kept").select(F.col("doc_id").alias("__id"))
    return clear.unionByName(possible.join(stay, "__id", "left_semi").dropDuplicates(["__id"])).select(plain.columns).toDF(*documents.columns)


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of whole documents by 2-word shingles; one row per document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2)


ORACLE_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
                             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, k) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.k FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(k) AS component_id, min(k) = r.doc_id AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
