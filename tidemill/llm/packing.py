"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the lengths decide a packing, and a length is a number from 1 to the capacity. So the
plan is made on the histogram of lengths (at most ``capacity`` counters, whatever the corpus)
and says how many sequences of each layout to build; pieces are then dealt to the places of
the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import as_bytes, mapped, written

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a text that are encoded at once, and on to the next cut; so ids stand as Python numbers for a slice only.
SLICE = 1 << 16
#: Rank counters per length; ranks inside one are made by one task, so no length is one task's work.
SALTS = 256
#: A space between two visible characters is always where a token of this vocabulary begins.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of the public byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    The ids are those of the ``tokenizers`` file of the same vocabulary (the tests compare the
    two on whole texts); a text is encoded in long slices, which costs less than looking up its words one
    by one. The added tokens that the file lists are taken out of a text first, as ``tokenizers`` does, and
    have one id each.
    """

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        path = path or public_tokenizers.path(VOCABULARY)
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in json.load(f)["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.split is not None and self.split.search(text):
            return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self.split.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            out.append(np.array(self.encode(text[at:end]), "<u4").tobytes())
            at = end
        return b"".join(out)


_ENCODER: dict[str | None, Encoder] = {}  # one per Python worker

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(capacity: int, vocabulary: str | None):
    def run(batches):
        if vocabulary not in _ENCODER:
            _ENCODER[vocabulary] = Encoder(vocabulary)
        encoder = _ENCODER[vocabulary]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            docs, pieces, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.ids(text.as_py()) + end
                n = len(data) // 4
                cut = n % capacity or capacity
                start, k = 0, 0
                while start < n:
                    docs.append(doc)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(cut - start)
                    sums.append(zlib.crc32(data[4 * start : 4 * cut]))
                    start, cut, k = cut, cut + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(pieces, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (starts, lengths, sums)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(
    documents: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Tokenise whole documents and cut those longer than ``capacity``.

    A document is its ids and one end id; null or empty text is the end id alone. A longer
    document is cut into pieces of ``capacity``, of which the first takes what is left over.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.transform(mapped, _pieces(capacity, vocabulary), _PIECES)


class Plan:
    """Layouts for a histogram of lengths. ``groups``: (number of sequences, [(length, times)])."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        left = {n: c for n, c in counts.items() if c}
        self.open: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # gap -> groups
        self._match_large(left)
        self.gaps = sorted(self.open)
        for size in sorted((n for n in left if left[n]), reverse=True):
            self._fill(size, left[size])
        self.groups = [g for gap in sorted(self.open) for g in self.open[gap]]

    def _match_large(self, left: dict[int, int]) -> None:
        """Items over a third of the capacity: at most two fit a sequence. Largest first, each takes the
        largest partner that fits; what has none stands alone."""
        third = self.capacity // 3
        large = sorted(n for n in left if n > third)
        while large:
            big = large[-1]
            if not left[big]:
                large.pop()
                continue
            at = bisect.bisect_right(large, self.capacity - big) - 1
            while at >= 0 and not left[large[at]]:
                del large[at]
                at -= 1
            if at < 0:
                self.open[self.capacity - big].append((left[big], [(big, 1)]))
                left[big] = 0
                continue
            mate = large[at]
            times = left[big] // 2 if mate == big else min(left[big], left[mate])
            if not times:  # one item whose only partner would be itself: try a smaller one
                lower = [n for n in large[:at] if left[n]]
                mate, times = (lower[-1], 1) if lower else (0, 1)
            left[big] -= times
            if mate:
                left[mate] -= times
            layout = [(big, 2)] if mate == big else [(big, 1), (mate, 1)] if mate else [(big, 1)]
            self.open[self.capacity - big - mate].append((times, layout))

    def _take(self, size: int) -> tuple[int, int, list] | None:
        """A group of open sequences with the smallest gap of at least ``size``."""
        at = bisect.bisect_left(self.gaps, size)
        while at < len(self.gaps):
            gap = self.gaps[at]
            if self.open.get(gap):
                return (gap, *self.open[gap].pop())
            del self.gaps[at]
            self.open.pop(gap, None)
        return None

    def _put(self, gap: int, count: int, layout: list) -> None:
        if gap not in self.open or gap not in self.gaps:
            bisect.insort(self.gaps, gap)
        self.open[gap].append((count, layout))

    def _fill(self, size: int, count: int) -> None:
        """Best fit: the smallest gaps that can hold an item of this size, as often as it fits."""
        while count:
            got = self._take(size)
            if got is None:
                times = min(self.capacity // size, count)
                bins = count // times
                self._put(self.capacity - times * size, bins, [(size, times)])
                count -= bins * times
                continue
            gap, bins, layout = got
            times = min(gap // size, count)
            used = min(bins, count // times)
            if used < bins:
                self._put(gap, bins - used, layout)
            self._put(gap - times * size, used, [*layout, (size, times)])
            count -= used * times

    def places(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, sequences, times, first sequence, offset), by length and rank."""
        rank: dict[int, int] = defaultdict(int)
        out, sequence = [], 0
        for bins, layout in self.groups:
            offset = 0
            for size, times in layout:
                out.append((size, rank[size], bins, times, sequence, offset))
                rank[size] += bins * times
                offset += size * times
            sequence += bins
        return sorted(out)

    @property
    def sequences(self) -> int:
        return sum(bins for bins, _ in self.groups)


def _deal(bases, places):
    """Sequence and offset of each piece from its length and its rank among equals."""

    def run(batches):
        base, table = bases.value, places.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("at").to_numpy() + base[length, batch.column("salt").to_numpy()]
            i = np.searchsorted(table["key"], (length.astype(np.int64) << 40) + rank, "right") - 1
            inside = rank - table["first"][i]
            sequence = table["sequence"][i] + inside // table["times"][i]
            offset = table["offset"][i] + inside % table["times"][i] * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``; sequences are gapless from offset 0.

    ``pieces`` has at least the columns of ``token_pieces``; lengths run from 1 to ``capacity``.
    The driver sees ``capacity`` x ``SALTS`` counters, never pieces. Equal and repeated rows are
    packed like any others. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    # written with its salt, which no column decides: rows that are all alike are dealt out too
    salted = written(pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "pieces")
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    for row in salted.groupBy("length", "salt").count().toLocalIterator():
        counts[row["length"], row["salt"]] = row["count"]
    plan = Plan({n: int(c) for n, c in enumerate(counts.sum(1)) if c}, capacity)
    bases = np.cumsum(counts, axis=1) - counts
    at = np.array(plan.places(), np.int64).reshape(-1, 6)
    table = {
        "key": (at[:, 0] << 40) + at[:, 1], "first": at[:, 1], "times": at[:, 3], "sequence": at[:, 4], "offset": at[:, 5]
    }
    ranks = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("at", (F.row_number().over(ranks) - 1).cast("long")).transform(mapped, 
        _deal(spark.sparkContext.broadcast(bases), spark.sparkContext.broadcast(table)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """``token_pieces`` of every document, packed: null and empty texts are their end id, repeated rows and rows
    without an id are packed like any others, an empty table gives an empty result, other columns are ignored."""
    return pack(token_pieces(documents, capacity, **options), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens; one row per piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
