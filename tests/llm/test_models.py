"""Trained operators: held-out accuracy, gradients, calibration, and odd rows; media and the pipeline."""

import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import common, language, media, neardup, quality, repeats
from tidemill.llm.common import is_held_out

HERE = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")


def test_held_out_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", is_held_out("id").alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 5 == 0 for r in got]


def test_gradients_of_the_recurrent_network():
    model = language.Labeller(["a", "b", "c"])
    for p in (*model.ahead.parameters(), *model.back.parameters()):
        p *= 0.7
    rows, truth = [b" abc ", b" zz ", b" q "], np.array([0, 1, 2])
    x, mask = model.padded(rows)

    def loss():
        p, m = model.label(rows)
        return -(np.log(p[:, np.arange(3), truth]) * m).sum() / m.sum()

    s, tf, tb = model._states(x, mask, True)
    z = s @ model.v + model.c
    p = np.exp(z - z.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(3), truth] -= 1
    ds = (p * mask[:, :, None] / mask.sum()) @ model.v.T
    grads = model.ahead.backward(x, mask, tf, ds[:, :, : language.HIDDEN]) + model.back.backward(x[::-1], mask[::-1], tb, ds[::-1, :, language.HIDDEN :])
    for p, g in zip([*model.ahead.parameters(), *model.back.parameters()], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.03 * abs(g[at]) + 2e-4


def test_windows_carry_state_and_label_each_position_once():
    model = language.Labeller(["a", "b"])
    data = language.letters("Straße " * 300 + "ende 12 x½")
    assert data.startswith(b" stra") and data.endswith(b" ende x ")
    parts = language.windows(data)
    assert b"".join(d[a:b] for d, a, b in parts) == data
    # a window's label of a position is what the whole sequence gives it, up to what lies beyond the context
    whole, _ = model.label([data])
    own = np.concatenate([model.label([d])[0][a:b, 0] for d, a, b in parts])
    assert np.abs(own - whole[:, 0]).max() < 1e-3
    seen = np.frombuffer(data, np.uint8) != 32
    p, n = model.pooled(["", "Straße " * 300 + "ende 12 x½", "1 2"])
    assert n.tolist() == [0, seen.sum(), 0] and np.abs(p[1] - whole[seen, 0].mean(0)).max() < 1e-3
    alone, joined = model.label([b" aaa "])[0][1:4, 0], model.label([b" zz aaa zz "])[0][4:7, 0]
    assert np.abs(alone - joined).max() > 1e-6  # the words around count


def _read_plainly(unit, x, mask):
    """States of one unit: one step and one unit at a time, gate and candidate side by side."""
    half = np.repeat(np.float32([0.5, 1]), language.HIDDEN)
    table, u, h, out = (unit.e @ unit.w + unit.b) * half, unit.u * half, np.zeros((x.shape[1], language.HIDDEN), np.float32), []
    for t in range(len(x)):
        g = np.tanh(h @ u + table.take(x[t], axis=0))
        z, c = 0.5 * g[:, : language.HIDDEN] + np.float32(0.5), g[:, language.HIDDEN :]
        new = h - c
        new *= z
        new += c
        out.append(h := np.where(mask[t][:, None], new, h))
    return np.stack(out)


def test_both_units_read_alike_and_in_less_time():
    rng, model = np.random.default_rng(8), language.Labeller(["a", "b", "c"])
    x, mask = model.padded([bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(1, 90, 40)])
    states, *_ = language.read(model.ahead, model.back, x, mask)
    assert np.abs(states[:, 0] - _read_plainly(model.ahead, x, mask)).max() < 1e-5
    assert np.abs(states[:, 1] - _read_plainly(model.back, x[::-1], mask[::-1])).max() < 1e-5
    x, mask = model.padded([bytes(rng.integers(97, 123, 400).astype(np.uint8)) for _ in range(language.AT_ONCE)])

    def seconds(run):
        start = time.thread_time()
        run()
        return time.thread_time() - start

    both = [(seconds(lambda: language.read(model.ahead, model.back, x, mask)), seconds(lambda: [_read_plainly(r, x, mask) for r in (model.ahead, model.back)])) for _ in range(5)]
    assert min(a for a, _ in both) < 0.85 * min(b for _, b in both)


def test_letters_are_those_of_the_words():
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x300), rng.randrange(0x110000)])) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for text in ["", "Ää-ß\x00_x9y", "½ ² Ⅷ", "İx", "a\ud800b", "".join(map(chr, range(0x2000, 0x2100))).join("ab"), *odd]:
        found = language.words(text)
        assert language.letters(text) == (f" {' '.join(found)} ".encode("utf-8", "surrogatepass") if found else b"")


@needs_data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    model = language.learn(docs, steps=200)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    short = [r for r in rows if r.n < 100]
    assert len(short) > 3 and np.mean([r.lang == r.lang_pred for r in short]) > 0.9
    marks = spark.createDataFrame([(1, "½ ² Ⅷ 7"), (2, "½x")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(marks, model).collect()] == [True, False]
    # rows that share an id with a null text, and a hot id, teach like any others
    again = docs.select("doc_id", "text", "lang").limit(200).unionByName(docs.selectExpr("doc_id", "cast(null as string) as text", "lang").limit(200)).unionByName(docs.selectExpr("cast(7 as long) as doc_id", "text", "lang").limit(50))
    assert language.learn(again, steps=2).languages == sorted({r.lang for r in docs.limit(200).collect() if r.lang})
    odd = spark.createDataFrame([(1, None, "de"), (2, "", "x"), (3, "12 %%", "x"), (3, rows and "der und die das ist nicht schön", None), (None, "a" * 5000, None)], "doc_id long, text string, lang string")
    got = [(r.lang_pred == "und", r.score == 0) for r in language.identify(odd, model).collect()]
    assert got == [(True, True)] * 3 + [(False, False)] * 2
    assert language.identify(odd.where("doc_id > 9"), model).count() == 0
    assert [r.lang_pred for r in language.identify(odd, language.learn(odd.where("doc_id > 9"))).collect()] == ["und"] * 5


@needs_data
def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{HERE}/documents.parquet"), spark.read.parquet(f"{HERE}/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "word " * 20000, 5)], "doc_id long, text string, score long")
    assert quality.score(odd, labels.where("doc_id < 0")).count() == 3
    assert quality.score(odd.where("doc_id > 9"), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.schema.names == docs.schema.names and 0 < kept.count() < docs.count()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    held = np.arange(3000) % 3 == 0
    net = quality.Network(epochs=30).fit(x[:2400], y[:2400], held[:2400])
    p = net.predict(x[2400:])
    assert abs(p.mean() - y[2400:].mean()) < 0.06 and net.temperature > 0.5
    assert quality.Network().fit(x[:0], y[:0], held[:0]).predict(x[:2]).tolist() == [0.5, 0.5]
    assert quality.Network().fit(x[:5], np.ones(5), held[:5]).predict(x[:1]).tolist() == [1.0]


def test_media_finds_crops_and_edits_only(spark):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(k, rng.normal(0, 1, 64).tolist()) for k in range(100)], "vec_id long, embedding array<double>")
    images = media.rendered(vectors).union(spark.createDataFrame([(200, None), (201, b""), (202, b"P5 junk"), (None, b"x"), (220, b"P5\n3 3\n255\n" + bytes(9))], "media_id long, image binary"))
    twice = images.union(images.where("media_id in (20, 40)").selectExpr("media_id + 1000 as media_id", "image"))
    rows = {r.media_id: r for r in media.copies(twice.withColumn("links", F.lit(1))).collect()}
    for q in range(0, 100, 20):
        assert rows[q].is_query and list(rows[q].links) == [q + 7], q
    assert rows[1020].class_id == 20 and list(rows[1020].links) == [27] and rows[None].class_id is None
    assert all(r.n_links == 0 for k, r in rows.items() if k is not None and k % 20 and k < 1000)
    assert media.copies(images.where("media_id > 5000")).count() == 0


def _warped(image, degrees, zoom, side):
    """The middle of an image, turned and zoomed, as a square of ``side`` pixels."""
    z = np.exp(1j * np.deg2rad(degrees)) / zoom
    y, x = np.mgrid[:side, :side] - (side - 1) / 2
    at = (x + 1j * y) * z + (image.shape[1] - 1) / 2 + 1j * (image.shape[0] - 1) / 2
    i, j = np.floor(at.imag).astype(int), np.floor(at.real).astype(int)
    fy, fx = at.imag - i, at.real - j
    return (image[i, j] * (1 - fx) + image[i, j + 1] * fx) * (1 - fy) + (image[i + 1, j] * (1 - fx) + image[i + 1, j + 1] * fx) * fy


def planted_images(n, side=220):
    """Images ``100 * k`` and edits of each under the ids after it: turned, scaled, noisy, and all at once."""
    rng = np.random.default_rng(4)
    edits = {1: (1, 1.0, 0), 2: (10, 1.0, 0), 3: (37, 1.0, 0), 4: (90, 1.0, 0), 5: (0, 0.6, 0), 6: (0, 0.8, 0), 7: (0, 1.3, 0), 8: (0, 1.0, 8), 9: (15, 0.7, 4)}
    out = {}
    for k in range(n):
        flat = rng.normal(0, 1, (side, side))
        for _ in range(3):
            flat = media._blur(flat)
        image = 128 + 45 * flat / flat.std()
        out[100 * k] = image
        for e, (degrees, zoom, noise) in edits.items():
            part = _warped(image, degrees, zoom, int(side * 0.68 * min(1, zoom)))
            out[100 * k + e] = part + rng.normal(0, 1, part.shape) * noise
    return {k: media.encode(np.clip(np.rint(v), 0, 255).astype(np.uint8)) for k, v in out.items()}


def test_media_finds_turned_scaled_and_noisy_copies(spark):
    images = planted_images(3)
    rows = media.copies(spark.createDataFrame([*images.items()], "media_id long, image binary"), every=100).collect()
    found = {(r.media_id, c) for r in rows if r.is_query for c in r.links}
    true = {(k // 100 * 100, k) for k in images if k % 100}
    missed = sorted(true - found)
    assert not found - true, sorted(found - true)
    assert len(missed) <= 0.1 * len(true), missed


def test_media_matches_against_brute_force():
    words = []
    for data in [*planted_images(2).values()]:
        words.append(np.packbits(media.describe(media.decode(data))[1], axis=1).view(">u8").astype(np.uint64).reshape(-1, 2))
    asked, every = words[0], np.concatenate(words)
    near = np.bitwise_count(every[:, None, 0] ^ asked[None, :, 0]).astype(int) + np.bitwise_count(every[:, None, 1] ^ asked[None, :, 1]) <= media.DISTANCE
    a, b = media.Matcher(asked).search(every)
    assert near.sum() == len(a) and near[a, b].all() and near.sum() > len(asked)


def test_noticed_images_against_brute_force(spark):
    """Recall of the noticed pairs, by the kind of edit and in all, against links from all pairs of descriptors."""
    images = planted_images(2)
    seen = {k: media.describe(media.decode(data)) for k, data in images.items()}
    words = {k: np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1, 2) for k, (_, bits) in seen.items()}
    frames = {k: f.astype(np.float32) for k, (f, _) in seen.items()}
    true = set()
    for q in (0, 100):
        for c in set(images) - {q}:
            m = media._matches(frames[q], words[q], frames[c], words[c])
            if len(m) >= media.VOTES and media.agree(m, media.VOTES):
                true.add((q, c))
    rows = media.copies(spark.createDataFrame([*images.items()], "media_id long, image binary"), every=100).collect()
    found = {(r.media_id, c) for r in rows if r.is_query for c in r.links}
    assert found <= true and len(found) >= 0.99 * len(true)
    for edit in range(1, 10):  # each kind: turned, scaled by 0.6 to 1.3, noisy, all at once
        assert any((q, q + edit) in found for q in (0, 100)), edit
    assert len(found) >= 0.9 * 18


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, HERE), "stage")
        assert out.schema.names == docs.schema.names, name
        assert out.select("doc_id").distinct().count() == out.count()
        if name == "minhash near-dedup":
            groups = neardup.near_duplicates(docs, 5)
            assert out.count() == groups.where("kept").count()
            assert neardup.near_duplicates(out, 5).where("not kept").count() == 0
        if name == "suffix-array dedup":  # what is cut is what the operator finds, but for halves of characters
            found = repeats.repeated_bytes(docs, pipeline.PASSAGE, keep_first=True)
            gone, spans = found.agg(F.sum("n_removed"), F.sum("n_spans")).first()
            size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
            lost = docs.agg(size).first()[0] - out.agg(size).first()[0]
            left = docs.count() - out.count()
            assert gone > 0 and gone <= lost <= gone + 6 * spans + 10 * left
        docs = out
        counts.append(out.count())
    packed = pipeline.STAGES[-1][1](spark, docs, HERE)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] < counts[3]
