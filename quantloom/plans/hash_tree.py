"""A tree of content hashes over a long factor table: rows, dates, years, factors. Two tables are compared from the top, so
dates are looked at only in years that differ, of factors that differ, and only changed dates are written again.

A node's hash is that of its children as a set (xor, sum and count of their hashes), so the order of rows, files and
columns doesn't matter, and equal rows count. Equal hashes of different contents occur by chance of about 2^-64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import frame_hash
from ..session import delete, scratch_dir

#: Levels from the top, and the columns that name their nodes.
LEVELS = {"factor": ("factor_name",), "year": ("factor_name", "year"), "date": ("factor_name", "year", "trade_date")}


def _node(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One hash for each group of children."""
    return frame_hash(df, list(names)).select(*names, F.xxhash64("hash_xor", "hash_sum", "n").alias("hash"))


def write_tree(df: DataFrame, path: str) -> None:
    """Hashes of a table (factor_name, trade_date, ...) at path, a folder for each level. The table is read once."""
    spark = df.sparkSession
    _node(df.withColumn("year", F.year("trade_date")), LEVELS["date"]).write.mode("overwrite").parquet(f"{path}/date")
    for level, below in (("year", "date"), ("factor", "year")):
        _node(spark.read.parquet(f"{path}/{below}"), LEVELS[level]).write.mode("overwrite").parquet(f"{path}/{level}")


def changed_dates(spark: SparkSession, new: str, old: str) -> DataFrame:
    """(factor_name, trade_date, change) between the trees at two paths: change is added, removed or changed."""
    inside, above = None, ()
    for level, names in LEVELS.items():
        sides = []
        for path, alias in ((new, "_new"), (old, "_old")):
            side = spark.read.parquet(f"{path}/{level}").withColumnRenamed("hash", alias)
            # children of nodes that differ; the level above is a small part of this one, and Spark knows its size
            sides.append(side if inside is None else side.join(inside, list(above), "left_semi"))
        differ = sides[0].join(sides[1], list(names), "full").where(~F.col("_new").eqNullSafe(F.col("_old")))
        inside, above = differ.select(*names), names
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return differ.select("factor_name", "trade_date", kind.alias("change"))


def sync_factors(df: DataFrame, path: str) -> DataFrame:
    """Brings the stored factor table at path (by factor and date, its tree beside it) to the content of df; only dates
    that differ are written or deleted. Returns what changed, as changed_dates() does."""
    spark = df.sparkSession
    tree, now, table = f"{path}/tree", scratch_dir(spark, "tree"), f"{path}/table"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{tree}/factor")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    write_tree(df, now)
    if not store.exists(where):
        write_tree(df.limit(0), tree)
    found = scratch_dir(spark, "changes")
    changed_dates(spark, now, tree).write.parquet(found)
    changes = spark.read.parquet(found)
    fresh = changes.where("change <> 'removed'").select("factor_name", "trade_date")
    rows = df.join(fresh, ["factor_name", "trade_date"], "left_semi")
    rows.repartition("factor_name", "trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_name", "trade_date").parquet(table)
    for r in changes.where("change = 'removed'").toLocalIterator():  # dates that a factor has lost
        delete(spark, f"{table}/factor_name={r['factor_name']}/trade_date={r['trade_date']}")
    for level in reversed(LEVELS):  # the top last: an update that is cut off finds its dates again
        spark.read.parquet(f"{now}/{level}").write.mode("overwrite").parquet(f"{tree}/{level}")
    delete(spark, now)
    return changes
