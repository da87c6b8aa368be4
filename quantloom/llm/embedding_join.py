"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosine checks.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. A table hashes a vector by `functions` random projections, each
shifted and cut into steps of `width`; near vectors fall into one bucket of some table with high chance. Equal
vectors (bit for bit) are one node with a number of copies. Buckets are cut into blocks, so that a bucket may hold
any share of the rows; pairs of blocks are compared by matrix products in double precision, and a pair that shares
several tables counts in the first of them only. Labels are part of the bucket's key.

Cases: a null vector or label, a zero vector and one with null, NaN or infinite components link with nothing;
vectors of unlike lengths do not link; rows that share a vec_id have one component and the links
of all of them; a row without a vec_id is compared like any other and has the component of what it links with, null if
nothing there has a vec_id (its kept is null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .spark_tools import components, stage, table
from .text_kernels import lists

COSINE = 0.98
#: Vectors in a block of a bucket.
BLOCK = 256


def same_cell(distance: float, width: float) -> float:
    """The chance that a Gaussian projection puts two points of this distance into one cell of this width."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def _buckets(vectors: DataFrame, tables: int, functions: int, width: float, seed: int) -> DataFrame:
    """(node, label, vector) with keys, a bucket number for each table; the projections depend on the seed and the
    vector's length only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        odd = np.random.default_rng(seed).integers(1, 1 << 62, functions, dtype=np.int64) | 1
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            values, starts = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)[:-1]
            sizes = np.diff(np.asarray(column.offsets))
            keys = np.empty((batch.num_rows, tables), np.int64)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    rng = np.random.default_rng([seed, size])
                    planes[size] = rng.standard_normal((size, tables * functions)), rng.uniform(0, width, tables * functions)
                a, b = planes[size]
                own = np.flatnonzero(sizes == size)
                x = values[starts[own][:, None] + np.arange(size)]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(own), tables, functions)
                with np.errstate(over="ignore"):
                    keys[own] = (cells * odd).sum(2) + np.arange(tables) * 1_000_003 + size
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(keys.ravel(), np.full(len(keys), tables), pa.int64())], [*batch.schema.names, "keys"])

    return vectors.mapInArrow(scan, T.StructType([*vectors.schema, T.StructField("keys", T.ArrayType(T.LongType()))]))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, width: float = 1.0, recall: float = 0.97, seed: int = 5) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    width: step of the projections. A table gets as many of them as keep unrelated vectors from meeting by chance in
    more than about one pair a vector, and there are as many tables as find a pair at the threshold with chance
    `recall` (nearer pairs are found more surely). Both follow from the number of rows, by the collision chance of
    p-stable projections.
    """
    all_rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0)
    all_rows = stage(all_rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h", F.when(F.col("usable"), F.xxhash64("label", "vector"))).withColumn("h2", F.when(F.col("usable"), F.hash("label", "vector"))))
    apart = same_cell(math.sqrt(2), width)
    functions = max(4, math.ceil(math.log(max(2, all_rows.count())) / -math.log(apart)))
    hit = same_cell(math.sqrt(2 - 2 * cosine), width) ** functions
    tables = math.ceil(math.log(1 - recall) / math.log(1 - hit))
    nodes = all_rows.where("usable").groupBy("label", "h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    # a vector that no row with an id has is named by its hash, behind all ids
    nodes = nodes.withColumn("node", F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", "h").alias("id")))
    nodes = stage(_buckets(nodes.select("node", "label", "h", "h2", "copies", "vector"), tables, functions, width, seed))

    # buckets that hold one vector are done; the others are cut into blocks
    spread = nodes.select("node", "label", "h", F.posexplode("keys").alias("t", "key"))
    sizes = spread.groupBy("label", "t", "key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    placed = spread.hint("merge").join(sizes, ["label", "t", "key"]).withColumn("block", F.pmod(F.xxhash64("node", "t"), "blocks"))
    placed = stage(placed.join(nodes.select("node", "h", "copies", "vector", "keys").hint("merge"), ["node", "h"]))
    # a pair of blocks is compared where both meet: a vector goes to each pair that has its block
    meet = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda j: F.struct(F.least(j, F.col("block").cast("int")).alias("i"), F.greatest(j, F.col("block").cast("int")).alias("j")))
    fanned = placed.withColumn("pair", F.explode(meet)).select("label", "t", "key", "pair.i", "pair.j", "block", F.col("node.none").cast("long").alias("none"), F.col("node.id").alias("node"), "copies", "vector", "keys")
    task = F.xxhash64("label", "t", "key", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pair of blocks; a pair that is cut by a batch's end waits for the next batch."""
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if len(batch):
                start = borders(batch)[-2]
                rest = batch.iloc[start:]
                if start:
                    yield links(batch.iloc[:start])
        if rest is not None and len(rest):
            yield links(rest)

    def borders(batch: pd.DataFrame) -> np.ndarray:
        keys = batch[["group", "t", "key", "i", "j"]].to_numpy()
        return np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])

    def links(batch: pd.DataFrame) -> pd.DataFrame:
        edges = borders(batch)
        a, b, ca, cb = [], [], [], []
        node = batch[["none", "node"]].to_numpy()
        copies, block = (batch[c].to_numpy() for c in ("copies", "block"))
        t, i, j = (batch[c].to_numpy() for c in ("t", "i", "j"))
        vectors, keys = batch["vector"].to_numpy(), batch["keys"].to_numpy()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            x = np.stack(vectors[lo:hi])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            k = np.stack(keys[lo:hi])
            left = np.flatnonzero(block[lo:hi] == i[lo])
            right = np.flatnonzero(block[lo:hi] == j[lo])
            near = x[left] @ x[right].T >= cosine
            if i[lo] == j[lo]:
                place = np.empty(hi - lo, np.int64)
                place[np.lexsort((node[lo:hi, 1], node[lo:hi, 0]))] = np.arange(hi - lo)
                near &= place[left][:, None] < place[right][None, :]
            for s in range(t[lo]):  # an earlier table has the pair
                near &= k[left, s][:, None] != k[right, s][None, :]
            p, q = np.nonzero(near)
            a.append(node[lo + left[p]])
            b.append(node[lo + right[q]])
            ca.append(copies[lo + left[p]])
            cb.append(copies[lo + right[q]])
        if not a:
            return pd.DataFrame({c: [] for c in ("a0", "a", "b0", "b", "n")}).astype("int64")
        a, b, ca, cb = map(np.concatenate, (a, b, ca, cb))
        # a row for each node of the batch: its links, and the smallest node that it reaches here
        ids, at = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
        p, q = at[: len(a)], at[len(a) :]
        least = np.arange(len(ids))
        while True:
            new = least.copy()
            np.minimum.at(new, p, least[q])
            np.minimum.at(new, q, least[p])
            new = new[new]
            if (new == least).all():
                break
            least = new
        return pd.DataFrame({"a0": ids[:, 0], "a": ids[:, 1], "b0": ids[least, 0], "b": ids[least, 1], "n": (np.bincount(p, cb, len(ids)) + np.bincount(q, ca, len(ids))).astype(np.int64)})

    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = fanned.withColumn("group", task).repartition(n, "group").sortWithinPartitions("group", "label", "t", "key", "i", "j")
    named = lambda none, x: F.struct((F.col(none) > 0).alias("none"), F.col(x).alias("id"))
    found = stage(grouped.mapInPandas(compare, "a0 long, a long, b0 long, b long, n long").select(named("a0", "a").alias("a"), named("b0", "b").alias("b"), "n"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    comps = components(found, "a", "b")
    per_node = nodes.select("node", "label", "h", "h2", "copies").join(counts, "node", "left").join(comps, "node", "left")
    least: Column = F.coalesce("component", "node")
    per_node = stage(per_node.select("label", "h", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(~least["none"], least["id"]).alias("comp")))
    out = all_rows.select("id", "label", "h", "h2").hint("merge").join(per_node, ["label", "h", "h2"], "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op8_embedding_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
