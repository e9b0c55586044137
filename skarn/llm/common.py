"""Shared plumbing of the text operators: shipping code to executors, shared storage, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers look here for this package where the cluster has not been given it by --py-files.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that a function of arrow_map sees at once.
SLICE = 1024
#: A key that holds more than one row in so many is joined by broadcast; at most so many keys can.
HEAVY = 1000
#: Folders of materialise() that are still there.
_WRITTEN: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package by name (they then keep caches between tasks)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE))  # texts are long: small batches bound memory
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine (as in tests) gets a new local one; a cluster is refused.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: work done once, lineage cut, safe from lost executors.

    The result's ``stored_at`` is its path; discard() removes it, clear() removes all that the session has left.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any storage that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> None:
    """Remove all tables of materialise() that are left; results that still read them fail from then on."""
    for path in sorted(_WRITTEN):
        remove(spark, path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns (a dict of lists or arrays)."""
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]  # one parameter: transform would hand a second one the index


def meet(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table (key, n, ...), which has one row a key; n: how many rows hold it, total: of all rows.

    Keys that hold more than one row in HEAVY are at most HEAVY, so they are broadcast and their rows stay
    where they are; the rest is shuffled, and there no key can fill a task.
    """
    heavy = F.col("n") * HEAVY > total
    hot = F.broadcast(table.where(heavy).drop("n"))
    rest = rows.join(F.broadcast(table.where(heavy).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(~heavy).drop("n"), key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), as (node, root) with root the smallest node reachable.

    Alternating large-star and small-star rounds: every round replaces links by links to a smaller
    neighbour, so rounds grow with the logarithm of the longest path. Each round ends in a written
    table, and the one before it is removed. Nodes of many links are met by broadcast (see meet()).
    Self links and nulls are ignored; nodes without links are not returned.
    """
    now = materialise(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct(), "edges"
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.select("x", "y").union(now.select("y", "x"))
        low = both.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"), F.sum((F.col("y") > F.col("x")).cast("long")).alias("n")).where("n > 0")
        low = low.select("k", F.least("k", "m").alias("m"), "n")
        large = materialise(meet(now.select("x", F.col("y").alias("k")), low, "k", before[0]).select("x", F.col("m").alias("y")).distinct(), "large")
        down = large.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
        small = meet(large.select(F.col("x").alias("k"), "y"), down, "k", before[0]).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        last, now = now, materialise(small.union(down.select("k", "m")).distinct(), "small")
        discard(last, large)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(now.select("y", "y")).distinct()
