"""Spark helpers that the operators share: staged tables, checked broadcasts, dense ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A side with at most so many rows and bytes may be broadcast; beyond it the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or in a local session without it a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL:
        _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[name]


#: Temporary folders of local sessions; staged tables to delete, for each temporary_tables() that is open.
_LOCAL: dict[str, str] = {}
_STAGED: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end, so results must be written before."""
    _STAGED.append([])
    try:
        yield
    finally:
        for path in _STAGED.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, temporary: bool = True) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors. A table
    that is not temporary outlasts temporary_tables()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if _STAGED and temporary:
        _STAGED[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, whose texts or images go to Python in batches of at most so many rows from now on, as those of the session
    do: a worker holds few of them at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; one that Spark reads in fewer tasks than it has cores is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _width(field: T.StructField) -> Column:
    """About the bytes that a column takes in memory."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.greatest(F.size(c), F.lit(0)) * 16 + 16
    return F.lit(32 if isinstance(field.dataType, T.StructType) else 8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """A staged table has at most so many rows and bytes; it looks at one row more at most."""
    found = df.select(sum(map(_width, df.schema), F.lit(0)).cast("long").alias("width")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a staged right side: broadcast if it is small, else shuffled (AQE splits skewed keys)."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right.hint("merge"), on, how)


def dense_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """Positions 0, 1, ... of the distinct values of column in code-point order, null last, without a global window.

    Range partitions are numbered in themselves; a table with one row for each partition carries the offsets.
    """
    key = F.struct(F.col(column).isNull().alias("n"), F.col(column).alias("v"))
    spread = df.select(column).distinct().repartitionByRange(key)
    ranked = stage(spread.withColumn("_part", F.spark_partition_id()))
    from pyspark.sql import Window

    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())
    return (
        ranked.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")
        .select(column, (F.col("_row") + F.col("_offset")).cast("long").alias(out))
    )


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge list: (node, component), the smallest node id of each component.

    Hook each node to its smallest neighbour, shorten the paths by doubling, contract, and repeat until no edge
    is left; contraction at least halves the nodes that still have edges. Nodes without edges are not listed.
    All state lives in staged tables; the driver only asks whether edges are left.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    e = stage(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        p = stage(p)
        for _ in range(2):
            q = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            p = p.join(q, "p").select("u", F.col("pp").alias("p"))
        p = stage(p)
        maps.append(p)
        a = p.select("u", F.col("p").alias("pu"))
        b = p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(a, "u").join(b, "v").where("pu <> pv")
        e = stage(e.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("u").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return stage(out) if len(maps) > 1 else out
