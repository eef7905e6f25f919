"""What the operators of this subpackage share: reading tables, cutting lineage, picking labelled rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.webloom.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.webloom.scratch", found)
    return found


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    for made in _MADE:
        made.append(out)
    return out


def save_in_buckets(df: DataFrame, name: str, by: str) -> DataFrame:
    """save() as a table whose rows lie in buckets of column `by`, so that joins on it don't move them again."""
    spark = df.sparkSession
    n, as_table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{as_table}"
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(as_table)
    out = spark.table(as_table)
    out.saved_at, out.saved_as = path, as_table
    for made in _MADE:
        made.append(out)
    return out


_MADE: list[list[DataFrame]] = []


def settled(make, name: str) -> DataFrame:
    """make() as a saved table; what it saved on its way is deleted."""
    _MADE.append(made := [])
    try:
        out = save(make(), name)
    finally:
        _MADE.pop()
    forget(*(df for df in made if df is not out))
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that save() wrote and that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        if hasattr(df, "saved_as"):
            spark.sql(f"DROP TABLE IF EXISTS {df.saved_as}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def out_of_the_way(docs: DataFrame, names: list[str], step) -> DataFrame:
    """The columns of docs of step(docs), during which those of docs that have one of these names have another."""
    other = {c: "_" * (1 + max(map(len, docs.columns))) + c for c in docs.columns if c in names}
    return step(docs.withColumnsRenamed(other)).select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns))


def slices(batches, rows: int = 256):
    """The rows of Arrow batches in small batches, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def light_slices(batches, column: str, most: int = 1 << 21, rows: int = 1024):
    """The rows of Arrow batches in slices of at most `rows` rows and about `most` bytes of a column; a longer value is a slice alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return the memory that a fit in the driver has freed to the system, where the C library has a call for that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


LEAST_BITS, MOST_BITS = 16, 25  # a filter has at least 8 KB and at most 4 MB


def bit_filter(hashes: DataFrame, spare: int = 16) -> tuple[int, np.ndarray]:
    """(power, a set of 2 ** power bits) of the hashes in the first column: `spare` bits for each, up to MOST_BITS.

    It passes every hash that is in the column, and one in `spare` others until they outgrow it.
    """
    h = F.col(hashes.columns[0])
    n = hashes.agg(F.approx_count_distinct(h)).first()[0]
    power = min(MOST_BITS, max(LEAST_BITS, (spare * n).bit_length()))
    parts = hashes.select(F.shiftrightunsigned(h, 64 - power).alias("place"))
    parts = parts.groupBy(F.shiftright("place", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 AS int))")).alias("bits"))
    words = np.zeros(1 << (power - 5), dtype="<u4")
    for at, bits in parts.collect():  # at most 2 ** (MOST_BITS - 5) rows
        words[at] = bits
    return power, words.view(np.uint8)


def passes(found: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes a bit_filter() passes."""
    power, bits = found
    place = (hashes >> np.uint64(64 - power)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def passing(df: DataFrame, column: str, found: tuple[int, np.ndarray]) -> DataFrame:
    """Rows whose hash of a column a bit_filter() passes; only the hashes go to Python."""
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def known(h: pa.Array) -> pa.Array:
        return pa.array(passes(shared.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return df.filter(known(F.xxhash64(column)))


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; -1 for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def bounded(df: DataFrame, by: list[str], total: int, most: int, salt: int) -> DataFrame:
    """About `most` of the `total` rows at most, by a hash of the columns `by`: the same rows in every run.

    Where rows that repeat those columns would bring far more or none, the rows' places in the input count as well.
    """
    if total <= most:
        return df
    below = lambda *more: F.pmod(F.xxhash64(*by, F.lit(salt), *more), F.lit(1_000_003)) < int(1_000_003 * most / total)
    share = df.filter(below()).count() / most
    return df.filter(below() if 0.5 < share < 1.5 else below(F.monotonically_increasing_id()))
