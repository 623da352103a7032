"""Cropped and edited copies of images, by local descriptors.

Corners are found at several scales; around each, a patch is turned by its own orientation and
pairs of its points are compared, which gives 128 bits that survive cropping, turning, and changes
of brightness or contrast. The bits are dealt into parts; two descriptors within ``DISTANCE`` differ
in at most ``PROBE`` bits of one of them, so keys of each part and all their neighbours propose every
such pair, and the Hamming distance confirms it. Images that meet so at their closest corners are compared
corner by corner. Pairs of matches give the shift, turn and zoom that
take one image to the other. Only images in which enough matches agree are copies.

Images are 8-bit grey PGM (``P5``) bytes. Images with equal bytes are one class and are read once.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, mapped, split_by_keys, written

SCALES = (1.0, 0.75, 0.5)
RADIUS = 9
BITS = 128
#: Bits in which two descriptors of one corner may differ, and agreeing corners that make a copy.
DISTANCE, VOTES = 20, 6
#: Parts of a descriptor, and bits in which one of them may differ: PARTS * (PROBE + 1) > DISTANCE, so no pair is missed.
PARTS, PROBE = 7, 2
#: Matches with so few differing bits in some part make a pair of images noticed, and how many it takes; all matches
#: of noticed images are then found. Of six matches at the full distance five would have to escape (each does so once
#: in six times) for a copy to go unnoticed.
NOTICE, NOTICED = 1, 2
#: Corners of query images that are searched at once, corners of other images beside them, and pairs that are compared at once.
ASKED, CORNERS, PAIRS = 1 << 18, 1 << 11, 1 << 17
#: Pixels by which a match may lie off, at least and as a part of the matched region; how far its own angle (radians) and zoom (log2) may be off.
OFF, OFF_PART, OFF_ANGLE, OFF_ZOOM = 2.5, 0.02, math.pi / 4, 0.75
#: How often matches that agree by chance may pass for a copy, among pairs of images.
CHANCE = 1e-3


def _pattern(seed: int = 17):
    rng = np.random.default_rng(seed)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS / math.sqrt(2), RADIUS / math.sqrt(2))
    return points, _parted(points, [len(x) for x in np.array_split(rng.permutation(BITS), PARTS)])


def _parted(points: np.ndarray, sizes: list[int], reach: float = 1.5) -> list[np.ndarray]:
    """Bits dealt into parts so that tests of nearby points, which often agree, lie in different parts.

    A part's keys then tell most descriptors apart. Neighbouring pixels of a blurred image are alike up to
    about ``reach``; from that follows how alike two tests are.
    """
    near = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / (2 * reach**2))
    a, b = points[:, 0], points[:, 1]
    alike = near(a, a) - near(a, b) - near(b, a) + near(b, b)
    scale = np.sqrt(np.maximum(np.diag(alike), 1e-6))
    alike = (alike / np.outer(scale, scale)) ** 2
    parts: list[list[int]] = [[] for _ in sizes]
    for bit in np.argsort(-alike.sum(0), kind="stable"):
        cost = [alike[bit, p].sum() if len(p) < n else np.inf for p, n in zip(parts, sizes, strict=True)]
        parts[int(np.argmin(cost))].append(int(bit))
    return [np.array(p) for p in parts]


def decode(data: bytes | None) -> np.ndarray | None:
    """A PGM as an array, or None for anything else."""
    if not data or not data.startswith(b"P5"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) % (len(data) + 1)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    if len(fields) < 3 or fields[2] > 255:
        return None
    w, h = fields[:2]
    body = np.frombuffer(data, np.uint8, offset=min(at + 1, len(data)))
    return body[: w * h].reshape(h, w) if w and h and len(body) >= w * h else None


def encode(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + np.ascontiguousarray(image, np.uint8).tobytes()


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    h, w = (max(1, int(n * scale)) for n in a.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    i, j = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    fy, fx = (y - i)[:, None], (x - j)[None, :]
    i2, j2 = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    top = a[i][:, j] * (1 - fx) + a[i][:, j2] * fx
    low = a[i2][:, j] * (1 - fx) + a[i2][:, j2] * fx
    return top * (1 - fy) + low * fy


def _blur(a: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = a.shape[axis]
        take = lambda i, p=p, n=n, axis=axis: p[i : i + n] if axis == 0 else p[:, i : i + n]
        a = (take(0) + 4 * take(1) + 6 * take(2) + 4 * take(3) + take(4)) / 16
    return a


def corners(a: np.ndarray) -> np.ndarray:
    """(y, x) of local maxima of the Harris response with room for a patch."""
    if min(a.shape) < 2 * RADIUS + 3:
        return np.empty((0, 2), int)
    gy, gx = np.gradient(a)
    yy, xx, xy = _blur(gy * gy), _blur(gx * gx), _blur(gx * gy)
    r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    best = np.full_like(r, -np.inf)
    p = np.pad(r, 2, constant_values=-np.inf)
    for dy in range(5):
        for dx in range(5):
            if (dy, dx) != (2, 2):
                np.maximum(best, p[dy : dy + r.shape[0], dx : dx + r.shape[1]], out=best)
    ok = (r > best) & (r > 1.0)
    ok[: RADIUS + 1] = ok[-RADIUS - 1 :] = False
    ok[:, : RADIUS + 1] = ok[:, -RADIUS - 1 :] = False
    return np.argwhere(ok)


_POINTS, _PART_BITS = _pattern()
_DISC = np.argwhere(np.hypot(*np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]) <= RADIUS) - RADIUS


def describe(image: np.ndarray):
    """``y, x, scale, angle`` of every corner in the image's own pixels, and its bits."""
    frames, bits = [np.empty((0, 4))], [np.empty((0, BITS), bool)]
    for scale in SCALES:
        a = _blur(_resized(image.astype(np.float64), scale))
        at = corners(a)
        if not len(at):
            continue
        patch = a[at[:, :1] + _DISC[:, 0], at[:, 1:] + _DISC[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        y = np.rint(at[:, 0, None, None] + c * _POINTS[:, :, 0] + s * _POINTS[:, :, 1]).astype(int)
        x = np.rint(at[:, 1, None, None] - s * _POINTS[:, :, 0] + c * _POINTS[:, :, 1]).astype(int)
        value = a[np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)]
        bits.append(value[:, :, 0] < value[:, :, 1])
        frames.append(np.column_stack([(at + 0.5) / scale - 0.5, np.full(len(at), scale), angle]))
    return np.concatenate(frames), np.concatenate(bits)


#: Corners of an image: frames (y, x, scale, angle) one after the other, and two words of bits each.
_ROWS = "class_id long, n int, frames array<float>, words array<long>"


def _describe(batches):
    """One row per image, so that an image's corners are never dealt out to several tasks."""
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int64())]
    for batch in batches:
        out = [[] for _ in kinds]
        for owner, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = decode(data.as_py())
            if image is None:
                continue
            frame, bits = describe(image)
            words = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">i8").astype(np.int64)
            for col, x in zip(out, (owner, len(frame), frame.astype(np.float32).ravel(), words.ravel()), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def _corners(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of images, each corner's image (by its row), frame and words."""
    n = batch.column("n").to_numpy()
    frames = pa.compute.list_flatten(batch.column("frames")).to_numpy().reshape(-1, 4)
    words = pa.compute.list_flatten(batch.column("words")).to_numpy().view(np.uint64).reshape(-1, 2)
    return np.repeat(np.arange(len(n)), n), frames, words


def _part_keys(bits: np.ndarray) -> list[np.ndarray]:
    """Each part of the descriptors as a number."""
    return [bits[:, part] @ (1 << np.arange(len(part))) for part in _PART_BITS]


def _neighbours(n: int, probe: int) -> np.ndarray:
    """Every number of ``n`` bits of which at most ``probe`` are set."""
    return np.array([sum(1 << b for b in c) for k in range(probe + 1) for c in itertools.combinations(range(n), k)])


_NEAR = {probe: [_neighbours(len(part), probe) for part in _PART_BITS] for probe in range(PROBE + 1)}


class Matcher:
    """Finds every pair of descriptors within ``DISTANCE`` of a fixed set, as two rows of 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.size, self.parts = len(words), []
        for part, key in zip(_PART_BITS, _part_keys(_bits(words)), strict=True):
            order = np.argsort(key, kind="stable")
            begin = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << len(part)))])
            # the words lie in the order of the part's keys, so that those of one key are neighbours
            self.parts.append((order, begin, *(np.ascontiguousarray(words[order, k]) for k in (0, 1))))

    def search(self, words: np.ndarray, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray]:
        """(index in ``words``, index in the set) of every pair, once.

        With a smaller ``probe``, only of the pairs that differ in so few bits of some part.
        """
        found = [np.empty(0, np.int64)]
        high, low = (np.ascontiguousarray(words[:, k]) for k in (0, 1))
        for key, near, (order, begin, theirs_high, theirs_low) in zip(_part_keys(_bits(words)), _NEAR[probe], self.parts, strict=True):
            keys = (key[:, None] ^ near[None, :]).ravel()
            lo = begin[keys]
            size = begin[keys + 1] - lo
            some = np.flatnonzero(size)
            lo, size, mine = lo[some], size[some], some // len(near)
            ends = np.cumsum(size)
            at = 0
            while at < len(some):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                n, begins, own = size[at:to], ends[at:to] - size[at:to] - done, mine[at:to]
                place = np.repeat(lo[at:to] - begins, n)
                place += np.arange(len(place))
                d = np.bitwise_count(np.repeat(high[own], n) ^ theirs_high.take(place))
                d += np.bitwise_count(np.repeat(low[own], n) ^ theirs_low.take(place))
                ok = np.flatnonzero(d <= DISTANCE)
                found.append(own[np.searchsorted(begins, ok, "right") - 1] * self.size + order[place[ok]])
                at = to
        return np.divmod(np.unique(np.concatenate(found)), max(1, self.size))


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, np.uint64).astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64)


def needed(m: int, p: float, votes: int) -> int:
    """Agreeing corners that ``m`` matches, each fitting by chance with probability ``p``, reach once in ``1 / CHANCE`` pairs of images."""
    term, tail, k = math.exp(-m * p), 1.0, 0
    while tail * m * m > CHANCE and k < m:
        tail -= term
        k += 1
        term *= m * p / k
    return max(votes, k + 2)


def agree(m: np.ndarray, votes: int) -> bool:
    """Whether ``votes`` corners of either image fit one shift, turn and zoom, and more than chance would bring.

    Rows of ``m``: corner, y, x, scale, angle of the query image, then of the other. Each match in turn is
    taken as the fixed point; the others then tell turn and zoom by where they lie, not by their angles.
    """
    q, c = m[:, 2] + 1j * m[:, 1], m[:, 7] + 1j * m[:, 6]
    own_turn, own_zoom = m[:, 9] - m[:, 4], np.log2(m[:, 3] / m[:, 8])
    high, wide = np.ptp(c.imag), np.ptp(c.real)
    tolerance = max(OFF, OFF_PART * max(high, wide))
    chance = min(1.0, math.pi * tolerance**2 / max(high * wide, 1.0)) * OFF_ANGLE / math.pi / 2
    least = needed(len(m), chance, votes)
    few = max(3, 3 * (least - 1) // 4)
    apart = lambda a: np.abs((a + math.pi) % (2 * math.pi) - math.pi)
    _, q_place = np.unique(np.rint(m[:, 1:3] / OFF), axis=0, return_inverse=True)
    _, c_place = np.unique(np.rint(m[:, 6:8] / OFF), axis=0, return_inverse=True)

    def enough(ok) -> bool:
        """At least ``votes`` corners, in as many places as chance would not bring."""
        if np.count_nonzero(ok) < least or min(len(np.unique(m[ok, 0])), len(np.unique(m[ok, 5]))) < votes:
            return False
        return least == votes or min(len(np.unique(q_place[ok])), len(np.unique(c_place[ok]))) >= least

    if not enough(np.ones(len(m), bool)):
        return False
    _, anchors = np.unique(np.stack([q_place.ravel(), c_place.ravel(), np.rint(own_turn / OFF_ANGLE).astype(int)]), axis=1, return_index=True)
    for i in anchors:
        far = np.abs(q - q[i]) >= 4 * OFF
        z = np.where(far, (c - c[i]) / np.where(far, q - q[i], 1), 1)
        turn, zoom = np.angle(z), np.log2(np.maximum(np.abs(z), 1e-9))
        at = np.flatnonzero(far & (apart(own_turn - turn) <= OFF_ANGLE) & (np.abs(own_zoom - zoom) <= OFF_ZOOM))
        if len(at) < few:
            continue
        # cells of 15 degrees and a quarter octave, overlapping by half either way
        for dt, dz in ((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)):
            cell = np.floor(np.mod(turn[at] / (math.pi / 12) + dt, 24)).astype(int) * 64 + np.floor(zoom[at] * 4 + dz).astype(int) + 32
            count = np.bincount(cell, minlength=1)
            for k in np.flatnonzero(count >= few):
                near = at[cell == k]
                best = np.median(z[near].real) + 1j * np.median(z[near].imag)
                t = c[i] - best * q[i]
                for _ in range(3):  # the best fit of those that agree may bring others in
                    ok = np.abs(c - best * q - t) <= tolerance
                    if np.count_nonzero(ok) < few:
                        break
                    ok &= (apart(own_turn - np.angle(best)) <= OFF_ANGLE) & (np.abs(own_zoom - np.log2(max(abs(best), 1e-9))) <= OFF_ZOOM)
                    if np.count_nonzero(ok) < few:
                        break
                    if enough(ok):
                        return True
                    dq, dc = q[ok] - q[ok].mean(), c[ok] - c[ok].mean()
                    spread = (np.abs(dq) ** 2).sum()
                    if spread < OFF * OFF:
                        break
                    best = (dq.conj() * dc).sum() / spread
                    t = c[ok].mean() - best * q[ok].mean()
    return False


def _matches(q_frames, q_words, c_frames, c_words) -> np.ndarray:
    """Every match of two images' corners, as ``agree`` takes them."""
    d = np.bitwise_count(q_words[:, None, 0] ^ c_words[None, :, 0]) + np.bitwise_count(q_words[:, None, 1] ^ c_words[None, :, 1])
    q, c = np.nonzero(d <= DISTANCE)
    return np.column_stack([q, q_frames[q], c, c_frames[c]]).astype(np.float64)


def _agreeing(asked, votes: int):
    """Images past which a lot of asked images streams: which of those each is a copy of.

    All corners of both images are here, so their matches are never written or shuffled.
    """

    def run(batches):
        asked_ids, asked_row, asked_frames, asked_words = asked.value
        matcher = Matcher(asked_words)
        edges = np.searchsorted(asked_row, np.arange(len(asked_ids) + 1))
        for batch in batches:
            ids = batch.column("class_id").to_numpy()
            n = batch.column("n").to_numpy()
            begin, pairs = 0, []
            while begin < len(ids):  # some thousand corners at a time, whole images
                end = max(begin + 1, int(np.searchsorted(np.cumsum(n[begin:]), CORNERS, "right")) + begin)
                row, frames, words = _corners(batch.slice(begin, end - begin))
                at = np.searchsorted(row, np.arange(end - begin + 1))
                a, b = matcher.search(words, NOTICE)
                pair, times = np.unique(row[a] * len(asked_ids) + asked_row[b], return_counts=True)
                for x, y in zip(*np.divmod(pair[times >= NOTICED], len(asked_ids)), strict=True):
                    if ids[begin + x] != asked_ids[y]:
                        mine, theirs = slice(at[x], at[x + 1]), slice(edges[y], edges[y + 1])
                        m = _matches(asked_frames[theirs], asked_words[theirs], frames[mine], words[mine])
                        if len(m) >= votes and agree(m, votes):
                            pairs.append((int(asked_ids[y]), int(ids[begin + x])))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["q", "c"])

    return run


def _linked(found: DataFrame, classes: DataFrame, votes: int) -> DataFrame:
    """``q, c``: classes with a query and the classes of which they hold a copy.

    The asked images are taken in lots of about ``ASKED`` corners, and all images are read past each lot.
    """
    spark = found.sparkSession
    asked = written(found.join(classes.where("asked").select("class_id"), "class_id", "left_semi").where("n > 0"), "asked")
    lots = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // ASKED))
    links = None
    for lot in range(lots):
        t = asked.where(F.pmod(F.xxhash64("class_id"), F.lit(lots)) == lot).toArrow().combine_chunks()
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((t.column("class_id").to_numpy(), *_corners(t)))
        some = written(found.transform(mapped, _agreeing(shared, votes), "q long, c long"), "links")
        shared.destroy()
        links = some if links is None else links.unionByName(some)
    discard(asked)
    return links if links is not None else spark.createDataFrame([], "q long, c long")


def copies(media: DataFrame, id_col: str = "media_id", image_col: str = "image", every: int = 20, votes: int = VOTES) -> DataFrame:
    """Copies of the query images (ids divisible by ``every``) among all images.

    Returns one row per input row: ``media_id, class_id`` (smallest id with equal bytes), ``is_query,
    n_links`` and ``links`` (the classes of other bytes that are crops or edits; for classes that hold
    a query, else empty). Null, empty and unreadable images have no corners and no links, rows without
    an id no class; rows that repeat an id stay. Other columns are ignored.
    """
    rows = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(image_col).cast("binary").alias("image"))
    rows = rows.withColumn("sum", F.sha1(F.coalesce("image", F.lit(b""))))
    listed = written(rows.select("media_id", "sum", F.coalesce(F.col("media_id") % every == 0, F.lit(False)).alias("is_query")), "media")
    classes = listed.groupBy("sum").agg(F.min("media_id").alias("class_id"), F.max("is_query").alias("asked"))
    classes = written(classes.where("class_id is not null"), "classes")
    # only images of ids that aren't the first of their class, or come again, have to be shuffled
    other = listed.join(classes.select("sum", "class_id"), "sum").where("media_id <> class_id").select("media_id")
    again = listed.groupBy("media_id").count().where("count > 1").select("media_id")
    possible, clear = split_by_keys(rows, "media_id", other.unionByName(again))
    firsts = possible.join(classes.select("sum", F.col("class_id").alias("media_id")), ["sum", "media_id"]).dropDuplicates(["sum", "media_id"])
    firsts = clear.where("media_id is not null").select("media_id", "image").unionByName(firsts.select("media_id", "image"))
    found = written(firsts.transform(mapped, _describe, _ROWS), "corners")

    agreed = _linked(found, classes, votes)
    discard(found)
    links = agreed.groupBy("q").agg(F.array_sort(F.collect_set("c")).alias("links"))
    none = F.array().cast("array<long>")
    named = classes.join(links.withColumnRenamed("q", "class_id"), "class_id", "left").select("sum", "class_id", F.coalesce("links", none).alias("links"))
    out = listed.join(named, "sum", "left").withColumn("links", F.coalesce("links", none))
    return out.select("media_id", "class_id", "is_query", F.size("links").alias("n_links"), "links")


SIDE = 64


def _textures() -> np.ndarray:
    """One fixed smoothed-noise texture for each place of a vector."""
    rng = np.random.default_rng(29)
    return np.stack([_blur(rng.normal(0, 1, (SIDE, SIDE))) for _ in range(64)]).reshape(64, -1)


def rendered(vectors: DataFrame) -> DataFrame:
    """The media column of the tests and of the query: an image per vector of ``embeddings``.

    The tables hold no images, so each vector is drawn as a mix of fixed textures: equal vectors give
    equal images, near ones similar images. Every id that ends in 7 gets an edited crop of the image
    that is 7 ids before it, where there is one.
    """
    base = vectors.select(F.col("vec_id").alias("media_id"), F.col("embedding").alias("v"))
    donors = base.select((F.col("media_id") + 7).alias("media_id"), F.col("v").alias("donor")).where("media_id % 10 = 7")
    rows = base.join(donors, "media_id", "left")

    def draw(batches):
        textures = _textures()
        for batch in batches:
            ids, images = batch.column(0).to_pylist(), []
            for k, v, donor in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                use = donor if donor is not None else v
                if use is None:
                    images.append(None)
                    continue
                w = np.zeros(64)
                w[: min(64, len(use))] = [x or 0.0 for x in use[:64]]
                flat = (w @ textures).reshape(SIDE, SIDE)
                image = 128 + 45 * flat / (flat.std() + 1e-9)
                if donor is not None:
                    top, left = k // 10 % 8, k // 80 % 8
                    image = (image[top : top + 56, left : left + 56] - 128) * (0.8 + 0.05 * (k // 10 % 9)) + 120
                images.append(encode(np.clip(np.rint(image), 0, 255).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["media_id", "image"])

    return rows.transform(mapped, draw, "media_id long, image binary")


def op9_media_copies(spark, sf_dir: str) -> DataFrame:
    """Copies among the images of all vectors; one row per image."""
    return copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
