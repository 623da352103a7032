"""What the corpus operators share: the shared folder, written tables, text as bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and keeps every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every byte that is no ASCII letter, digit or part of a non-ASCII character made a space.
WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Word characters of the licence and benchmark scans, as a regular expression.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session in one process (``local``) names none, a folder of this machine is set; on a cluster
    that is an error, since executors would not see it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), "tidemill-shared")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor; a lost one costs its running tasks only. They stay until ``discard``
    or ``sweep``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of plans that have ended."""
    for table in tables:
        _delete(table.sparkSession, table._written_at)
    gc.collect()  # the driver's handles on finished plans
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete everything that operators wrote to the shared folder, once no result of theirs is needed."""
    _delete(spark, f"{shared_dir(spark)}/tidemill")


#: Bytes of rows handed to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, whose worker gives its memory back when a task ends.

    Spark's own batches of up to 64 MB stand several times in an executor's memory; the setting is lowered for
    the session where it has its default.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH).rstrip("bB") == str(64 << 20):
        conf.set(_BATCH, str(BATCH_BYTES))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def release() -> None:
    """Free memory that this process's allocators hold for later; a worker may serve another operator next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


#: Bits of the filter that tells which rows a set of keys may concern.
FILTER_BITS = 1 << 26


def _places(key: str):
    """Three places of a key in the filter; -1 for null, which is in no set."""
    some = F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)).cast("int") for i in range(3)])
    return F.when(F.col(key).isNull(), F.array(*[F.lit(-1)] * 3)).otherwise(some)


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows whose key may be in ``keys`` and rows whose key surely isn't, without a shuffle of ``df``.

    A Bloom filter of fixed size (8 MB, whatever the number of keys) is made by summing in Spark and
    broadcast. Where keys fill it more rows count as possible, none is lost: the possible rows are for
    an exact join. Only they have to be shuffled, which spares the texts of all others.
    """
    place = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).select(F.explode(_places(key)).alias("p"))
    words = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1, p & 31)")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.int32)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bits)
    n = len(df.columns)

    def part(possible: bool):
        def run(batches):
            for batch in batches:
                p = batch.column(n).flatten().to_numpy().reshape(-1, 3)
                there = ((shared.value[p >> 5] >> (p & 31)) & 1).all(1) & (p[:, 0] >= 0)
                yield batch.select(list(range(n))).filter(pa.array(there if possible else ~there))

        return run

    marked = df.withColumn("__places", _places(key))
    return marked.transform(mapped, part(True), df.schema), marked.transform(mapped, part(False), df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame, *columns: str) -> tuple[DataFrame, ...]:
    """``df`` with columns c0, c1 and so on, which no name of an operator's own clashes with, and the new names of some."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), *[new[df.columns.index(c)] if c in df.columns else None for c in columns]


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``__id``: the row's id in the order of ids, or for a row without one a number of its own after all ids.

    Rows without an id are written once, so that a number stays with its row. Where the numbers don't
    fit above the ids, ids move down as far as it takes.
    """
    own = F.col(id_col).cast("long")
    bare, low, high = df.agg(F.count_if(own.isNull()), F.min(own), F.max(own)).first()
    if not bare:
        return df.withColumn("__id", own)
    rest = written(df.where(own.isNull()).withColumn("__row", F.monotonically_increasing_id()), "unnamed")
    low, high = (0, -1) if high is None else (low, high)
    down = max(0, high + 1 + rest.agg(F.max("__row")).first()[0] - (2**63 - 1))
    if low - down < -(2**63):
        raise ValueError("the ids leave no numbers for rows without an id")
    rest = rest.withColumn("__id", F.col("__row") + F.lit(high + 1 - down).cast("long")).drop("__row")
    return df.where(own.isNotNull()).withColumn("__id", own - F.lit(down).cast("long")).unionByName(rest)


def as_bytes(column: str):
    """A text column as UTF-8 bytes, null as empty; Arrow then hands Python ``bytes``."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def crc_of_id(column: str):
    """crc32 of the id written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def is_held_out(column: str = "doc_id"):
    return crc_of_id(column) % 5 == 0
