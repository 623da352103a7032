"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark item becomes windows of ``n`` consecutive words. A text is reduced to its
words joined by single spaces, so a window is a byte string with a space at either end. The
search slides over that string: a block-shift table skips positions where no pattern can
end, a table from the block to the patterns that have it there selects test strings, and a
direct comparison confirms each occurrence.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, as_bytes, mapped, written

#: Patterns of like length share one automaton: its shifts are as long as its shortest pattern allows.
LENGTH_CLASSES = (4, 12, 24, 48)
#: Bytes of benchmark text whose tables a pass over the documents holds at once.
BLOCK_BYTES = 4 << 20


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD).split()


class WuManber:
    """Search for many byte patterns at once; all patterns are non-empty."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.block = b = max(1, min(8, m // 2))
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, int]]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                piece = p[end - b : end]
                if self.shift.get(piece, self.far) > m - end:
                    self.shift[piece] = m - end
            self.bucket[p[m - b : m]].append((p, k))

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern index) of every occurrence, overlapping ones too."""
        m, b, far, shift, bucket = self.m, self.block, self.far, self.shift.get, self.bucket
        end, n = m, len(text)
        while end <= n:
            piece = text[end - b : end]
            skip = shift(piece, far)
            if skip:
                end += skip
                continue
            start = end - m
            for p, k in bucket[piece]:
                if text.startswith(p, start):
                    yield start, k
            end += 1


class Windows:
    """The windows of a block of benchmark items, ready to search in a document."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        self.items_of: list[set] = []
        self.words_in: list[int] = []
        known: dict[bytes, int] = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        patterns: list[bytes] = []
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - n + 1) if words else 0):
                p = b" " + b" ".join(words[i : i + n]) + b" "
                k = known.setdefault(p, len(patterns))
                if k == len(patterns):
                    patterns.append(p)
                    self.items_of.append(set())
                    self.words_in.append(len(words[i : i + n]))
                    by_class[sum(len(p) >= x for x in LENGTH_CLASSES)].append(k)
                self.items_of[k].add(item)
        self.searchers = [(WuManber([patterns[k] for k in ks]), ks) for ks in by_class.values()]

    def found(self, words: list[bytes]) -> bool:
        text = b" " + b" ".join(words) + b" "
        return any(True for searcher, _ in self.searchers for _ in searcher.find(text))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word intervals [start, end) covered by occurrences, and the items found."""
        text = b" " + b" ".join(words) + b" "
        spans, items, spaces = [], set(), None
        for searcher, ks in self.searchers:
            for start, k in searcher.find(text):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                first = int(np.searchsorted(spaces, start))
                spans.append((first, first + self.words_in[ks[k]]))
                items |= self.items_of[ks[k]]
        return spans, items


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, as maximal intervals in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, list[tuple[int, bytes]]]]:
    """The benchmark a bounded block at a time, under a name of its own; the driver holds one, and the one that its caller works on."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t")).toLocalIterator():
        if row.i is None:
            continue
        block.append((row.i, bytes(row.t)))
        size += len(row.t)
        if size >= BLOCK_BYTES:
            yield uuid.uuid4().hex, block
            block, size = [], 0
    if block:
        yield uuid.uuid4().hex, block


_SEARCH: dict[tuple[str, int], Windows] = {}


def _windows(block: tuple[str, list], n: int) -> Windows:
    """The tables of a block; a worker keeps those of one block at a time."""
    key = (block[0], n)
    if key not in _SEARCH:
        _SEARCH.clear()
        _SEARCH[key] = Windows(block[1], n)
    return _SEARCH[key]


def _scan(n: int, items):
    """One pass over documents for one broadcast block of items."""

    def run(batches):
        windows = _windows(items.value, n)
        for batch in batches:
            rows = {"row": batch.column(0), "id": batch.column(1)}
            n_words, starts, ends, found = [], [], [], []
            for data in batch.column(2):
                words = words_of(data.as_py())
                spans, got = windows.hits(words) if words else ([], set())
                spans = covered(spans)
                n_words.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                found.append(sorted(got))
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.values(),
                    pa.array(n_words, pa.int64()),
                    pa.array(starts, pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "n_words", "starts", "ends", "items"],
            )

    return run


_SPANS = "row long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>"


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Word spans of benchmark windows in every document.

    Returns one row per input row: ``doc_id, n_words, starts, ends`` (maximal hit spans, in
    words), ``items`` (sorted ids whose windows occur). Null or empty text has no words; items
    without words or without an id have no windows; repeated ids stay separate rows; other
    columns are ignored. A benchmark over ``BLOCK_BYTES`` is searched in blocks, one pass over
    the documents each, whose spans are united per document; one block is broadcast at a time.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text")
    )
    block, found = (uuid.uuid4().hex, []), None
    for following in itertools.chain(blocks(benchmark, item_col, item_text), [None]):
        if following is None and found is None:  # one block, or none
            return docs.transform(mapped, _scan(n, spark.sparkContext.broadcast(block)), _SPANS).drop("row")
        if block[1]:
            if found is None:
                docs = written(docs, "numbered")  # a row has one number in all passes
            shared = spark.sparkContext.broadcast(block)
            spans = docs.transform(mapped, _scan(n, shared), _SPANS)
            spans = written(spans if found is None else spans.where(F.size("starts") > 0), "hits")
            shared.unpersist()
            found = spans if found is None else found.unionByName(spans)
        block = following
    merged = found.groupBy("row", "doc_id", "n_words").agg(
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def unite(batches):
        for batch in batches:
            spans = [covered([(x["starts"], x["ends"]) for x in s]) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())),
                    pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int64())),
                    batch.column("items"),
                ],
                names=["doc_id", "n_words", "starts", "ends", "items"],
            )

    return merged.transform(mapped, unite, _SPANS.removeprefix("row long, "))


def keep_clean(documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text has no word inside a benchmark window, with all their columns.

    A benchmark of several blocks is searched block by block, each over what the ones before kept, which is
    written between; one block is broadcast at a time. Null and empty texts have no words and stay, as do all rows
    where the benchmark is empty; repeated rows stay or go together; an empty table stays empty. Any other columns,
    whatever their names, are kept.
    """
    spark = documents.sparkSession
    at = documents.columns.index(text_col)
    items = None
    for block in blocks(benchmark, "item_id", "text"):
        if items is not None:
            documents = written(documents, "clean")
            items.unpersist()
        items = spark.sparkContext.broadcast(block)

        def run(batches, items=items):
            windows = _windows(items.value, n)
            for batch in batches:
                texts = (x.as_py() for x in batch.column(at))
                yield batch.filter(pa.array([x is None or not windows.found(words_of(x.encode("utf-8", "surrogatepass"))) for x in texts], pa.bool_()))

        documents = documents.transform(mapped, run, documents.schema)
    return documents


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in whole documents; one row per document."""
    found = benchmark_hits(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    as_text = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(as_text, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
pos AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM win) s, unnest(generate_series(1, greatest(len(w) - n + 1, 0))) t(i)
  WHERE len(w) >= n),
hits AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
