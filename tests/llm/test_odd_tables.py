"""Every pipeline stage on odd tables, and blocks of a benchmark against one."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemill.llm import decontaminate, packing, quality

WORDS = ["river", "stone", "quiet", "garden", "letter", "morning", "window", "silver", "people", "travel", "number", "winter", "simple", "market", "forest"]
CLASHING = ("__id", "__key", "__spans", "__places", "__row", "id", "key", "row", "y", "x", "crc", "sig", "n", "salt", "at", "text_", "label", "quality")


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with ``labels`` and ``benchmark``, and rows of ``documents`` that are odd in every way."""
    rng = random.Random(7)
    good = [_prose(rng, 80) for _ in range(40)]
    item = _prose(rng, 14)
    long = _prose(rng, 30_000)
    texts = {**dict(enumerate(good)), 40: None, 41: "", 42: " \n\t ", 43: long, 44: good[3], 45: good[5] + " and an end", 46: "x " + item + " y", 47: "퟿\U0010ffff é " + good[7][:90], 48: good[0]}
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "web", None if t is None or k % 11 == 0 else len(t)) for k, t in texts.items()]
    rows += [rows[1], rows[1], (None, good[9], None, None, None), (None, None, None, None, None), (None, _prose(rng, 60), "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    home = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, k % 9 and 1, 0) for k in range(40)] + [(1, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([("a", item), ("b", None), ("c", ""), ("a", item)], "item_id string, text string").write.parquet(f"{home}/benchmark.parquet")
    return docs, f"file://{home}", item, long


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_tables(spark, tables, name):
    docs, home, item, long = tables
    home, stage = home if name != "benchmark decontamination" else _numbered_items(spark, home), dict(pipeline.STAGES)[name]
    out = stage(spark, docs, home)
    wide = docs.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in docs.columns])
    with_more = stage(spark, wide, home)
    empty = stage(spark, docs.limit(0), home)
    assert empty.schema.names == out.schema.names and empty.count() == 0
    if name == "best-fit packing":
        assert sorted(map(tuple, out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str) == sorted(map(tuple, with_more.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
        assert out.where("piece = 0").count() == docs.count()  # null and empty texts have their end
        return
    assert out.schema.names == docs.schema.names and with_more.columns == wide.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, with_more.select(docs.columns).collect()))
    assert with_more.where(" or ".join(f"`{c}` <> 7" for c in CLASHING if c not in docs.columns)).count() == 0
    texts = [r.text for r in out.collect()]
    if name == "minhash near-dedup":
        assert long in texts and len([t for t in texts if t]) == len({*texts} - {None, ""})
    if name == "benchmark decontamination":
        assert len(texts) == docs.count() - 1 and not any(t and item in t for t in texts)
    if name == "suffix-array dedup":
        assert long in texts and texts.count(docs.where("doc_id = 1").first().text) == 3  # one document, three times
        once = [r.text for r in out.where("doc_id is null or doc_id <> 1").collect() if r.text and len(r.text) > 400]
        assert len(once) == len({*once})


def _numbered_items(spark, home):
    path = f"{home}/numbered"
    items = spark.read.parquet(f"{home}/benchmark.parquet").select(F.ascii("item_id").cast("long").alias("item_id"), "text")
    items.write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path


def test_blocks_of_a_benchmark_find_what_one_does(spark, tables, monkeypatch):
    docs, home, item, _ = tables
    rng = random.Random(3)
    items = spark.createDataFrame([(k, " ".join(_prose(rng, 12).split())) for k in range(6)] + [(9, item), (10, None), (None, item)], "item_id long, text string")
    more = docs.unionByName(items.limit(4).select(F.lit(77).cast("long").alias("doc_id"), F.concat(F.lit("so "), "text"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "int"))]).toDF(*docs.columns))

    def found():
        hits = decontaminate.benchmark_hits(more, items)
        return sorted(map(str, hits.collect())), sorted(map(str, decontaminate.keep_clean(more, items).collect()))

    whole = found()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    assert len(list(decontaminate.blocks(items, "item_id", "text"))) > 2
    assert found() == whole and len(whole[1]) == more.count() - 5


def test_a_repeated_label_is_one_training_row(spark, monkeypatch):
    rng = random.Random(1)
    good, bad = [_prose(rng, 30) for _ in range(30)], ["zz qq " * 20 + str(k) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows + [rows[0], (0, "other words"), (0, None)] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(60)], "doc_id long, quality int")
    seen = []
    fit = quality.Network.fit
    monkeypatch.setattr(quality.Network, "fit", lambda self, x, y, held: (seen.append(len(x)), fit(self, x, y, held))[1])
    scores = quality.score(docs, labels)
    known = docs.select("doc_id").distinct().where(~quality.is_held_out("doc_id")).count()
    assert seen == [known] and scores.count() == docs.count()


def test_one_document_repeated_is_packed_over_many_windows(spark):
    docs = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    packed = packing.pack_documents(docs)
    rows = packed.select("sequence_id", "offset", "length").collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 2000
    each = rows[0].length
    assert len({r.sequence_id for r in rows}) == -(-2000 // (1024 // each))
