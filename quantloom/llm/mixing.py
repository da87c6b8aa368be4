"""Mixing sources to target weights: capped water-filling of the budget, then seeded whole and part repetitions.

Targets are proportional to the weights. A source whose target exceeds max_epochs times its size stops there, and
the excess goes to the others by weight, again and again until no source is above. A source whose target is e
epochs gives floor(e) whole repetitions of each document, and the rest in the order of a seeded hash: documents
once more until the words are used up; the last one gives its first words only. So every source meets its rounded
target exactly, and no document exceeds ceil(e) <= max_epochs times its size.

Cases: null text has size 0 and is never taken; null source is a source of its own, the last; identical rows share
their extra words evenly (rounded down); an empty table gives an empty result; other columns stay as they are, but
mixed() replaces those that are named like its results (repeat_rows() keeps them).
Sources are ranked by a range-partitioned count, documents by hash buckets; no source is ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .spark_tools import dense_index, is_small, join_checked, stage, table

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
#: About so many documents are in each hash bucket; there are at most MOST_BUCKETS for a source.
BUCKET_ROWS, MOST_BUCKETS = 512, 65536


@dataclass
class Mix:
    sources: DataFrame  #: _key, source_size, target, _whole, _extra, _edge (bucket where the extra words end), _before
    edges: DataFrame  #: _h, _id, _size, _part: documents of the edge buckets and their extra words
    buckets: int
    options: dict


def _prepared(docs: DataFrame, buckets: int, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"),
    ).withColumn("_b", F.pmod("_h", F.lit(buckets)))


def water_level(sources: DataFrame, total: float) -> float:
    """The level l for which the sum of least(cap, l * weight) is total; infinite if the caps do not reach it.

    sources: cap, weight. Each round is one aggregate whose two numbers come to the driver; the set of capped
    sources only grows, so it ends.
    """
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if not row["w"]:
            return float("inf")
        if row["n"] == capped:
            return level
        capped, level = row["n"], (total - row["c"]) / row["w"]


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """weights are given to the sources in code-point order, again and again; share: the mix's words over all words."""
    options = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "seed": seed}
    rows = stage(_prepared(docs, 1, **options).select("_key", "_id", "_size", "_h"))
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    parts = stage(rows.groupBy("_key", "_b").agg(F.sum("_size").alias("words")))
    sizes = stage(parts.groupBy("_key").agg(F.sum("words").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_index", F.lit(len(weights))) + 1).cast("int"))
    sources = stage(
        sizes.join(dense_index(sizes, "_key", "_index"), "_key").select("_key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    )
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    target = F.least("cap", F.lit(water_level(sources, total)) * F.col("weight"))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    sources = sources.withColumn("target", target).withColumn("_whole", whole).withColumn("_extra", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        parts.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(sources.select("_key", "_extra"), "_key")
        .where("_before < _extra and _extra < _before + words")
        .select("_key", F.col("_b").alias("_edge"), "_before")
    )
    # no edge: the extra words are none, or all of the source
    sources = stage(
        sources.join(cut, "_key", "left").select("_key", "source_size", "target", "_whole", "_extra", F.coalesce("_edge", F.when(F.col("_extra") > 0, buckets).otherwise(-1)).cast("long").alias("_edge"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    same = join_checked(rows, sources.where(f"_edge between 0 and {buckets - 1}").select("_key", "_edge", "_extra", "_before"), ["_key"], "inner").where("_b = _edge")
    same = same.groupBy("_key", "_h", "_id", "_size", "_extra", "_before").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_key").orderBy("_h", F.col("_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_size") * F.col("_n"), F.col("_extra") - ahead))
    edges = stage(same.select("_h", F.col("_id"), F.col("_size").alias("_edge_size"), F.floor(part / F.col("_n")).alias("_part")).where("_part > 0"))
    return Mix(sources, edges, buckets, options)


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with size, source_size, target, whole (times taken), part (words taken beside) and taken (words in all)."""
    o = mix.options
    rows = _prepared(docs, mix.buckets, **o)
    rows = join_checked(rows, mix.sources, ["_key"], "left")
    ends = mix.edges.select(F.col("_h").alias("_eh"), F.col("_id").alias("_eid"), "_edge_size", "_part")
    rows = rows.join(F.broadcast(ends) if is_small(ends) else ends, (F.col("_h") == F.col("_eh")) & F.col("_id").eqNullSafe(F.col("_eid")) & (F.col("_size") == F.col("_edge_size")) & (F.col("_b") == F.col("_edge")), "left")
    part = F.when(F.col("_b") < F.col("_edge"), F.col("_size")).otherwise(F.coalesce("_part", F.lit(0)))
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "whole", "part", "taken")],
        F.col("_size").alias("size"), "source_size", "target", F.col("_whole").alias("whole"), part.cast("long").alias("part"),
        (F.col("_whole") * F.col("_size") + part).cast("long").alias("taken"),
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    return mixed(docs, plan_mix(docs, **options))


def repeat_rows(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with docs' columns; a part has the text up to the end of its
    last word."""
    m = mixed(docs.select(F.struct("*").alias("_docs"), *[F.col(options.get(k, d)) for k, d in (("id_col", "doc_id"), ("source_col", "source"))], F.col(text_col)), plan_mix(docs, text_col=text_col, **options))
    copies = F.col("whole") + F.when(F.col("part") == F.col("size"), F.sign("part")).otherwise(0)
    whole = m.where(copies > 0).select("_docs", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("_copy")).select("_docs.*")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({SPACE}{WORD})"), 1), F.lit(1), F.col("part").cast("int")), "")
    part = m.where("part > 0 and part < size").select("_docs", cut.alias("_cut")).select(*[F.col("_cut").alias(c) if c == text_col else F.col("_docs").getField(c).alias(c) for c in docs.columns])
    return whole.unionByName(part)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "whole", "part")
