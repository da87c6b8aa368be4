"""N-gram Jaccard join: all documents whose word-shingle sets have a Jaccard similarity of 0.8 or more, exactly.

1. One pass hashes each text's shingles to a set digest and a few min-hash bands, and counts shingles that recur
   within a task. Equal sets are one node from here on.
2. Stars: within each band the nodes are compared with the band's smallest document only, so a group of copies costs
   its size, not its square. Verified links give first components.
3. Signature trees find what is left. Every linking pair shares a shingle among the first n - ceil(0.8 n) + 1 of
   either set in one global order (frequent shingles last), so each such shingle is the root of a tree over the
   documents that have it there. A root whose documents are all in one component is pruned by a map-side
   aggregate. Below the others come size classes, two levels by the documents' smallest shingle hash, which brings
   similar ones together, and levels of FAN children each down to leaves of about LEAF documents. Every node has its
   documents' OR-combined token bitmap, size range and component range. The traversal goes down level by level: the
   pairs of children of surviving pairs of nodes are joined, and pruned if sizes, components or the largest overlap
   that the bitmaps permit rule out a link; at the leaves, pairs of documents alike. A root with up to LEAF documents
   is a leaf.
4. Surviving pairs are verified on whole texts; the rest is connected components.

Nothing is approximate: bands only save work, step 3 misses no pair of different components.

Cases: null and empty texts have no shingles and link with nothing; a text of one to four words has one shingle;
rows that share a doc_id count as one document and get one component; a null doc_id is reported with its number
of shingles and the component of its equals, or null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .spark_tools import components, join_checked, stage, table, text_batches
from .text_kernels import lists, mix, released, shingle_slices

SHINGLE, PERCENT = 5, 80
BANDS, SEGMENTS = 8, 16
#: 64-bit words of a node's bitmap and least ones of a document's, bits that a document's has for each shingle; documents in a leaf.
BITMAP, DENSITY, LEAF = 16, 4, 32
#: Bits of a path that one level of a tree takes (FAN is 8), those that come from the smallest shingle, and all.
LEVEL_BITS, LIKE_BITS, PATH_BITS = 3, 6, 45
#: A shingle counts as frequent from so many occurrences on; that only changes the order. At most MOST_FREQUENT are told apart.
FREQUENT, MOST_FREQUENT = 100, 200_000
#: Shingles that a task sorts at once to find recurring ones, and the least count that it reports.
SORTED_AT_ONCE, REPORTED = 1_500_000, 3
#: Bits for each root in the filter that goes to all tasks, and its largest size (16 MB); a full filter lets all pass.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


def _least(percent: int) -> int:
    """The size from which on a set can link with another one."""
    return -(-percent // (100 - percent))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (n, h1, h2, bands), and rows with n null for recurring shingles (shingle, times)."""

    def recurring(parts: list[np.ndarray]) -> pa.RecordBatch:
        s, times = np.unique(np.concatenate(parts), return_counts=True)
        s, times = s[times >= REPORTED], times[times >= REPORTED]
        nulls = pa.nulls(len(s), pa.int64())
        return pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.nulls(len(s), pa.list_(pa.int64())), pa.array(s.view(np.int64)), pa.array(times.astype(np.int64))], names)

    names = ["doc_id", "n", "h1", "h2", "bands", "shingle", "times"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for lo, hi, t, s in shingle_slices(batch.column(1), k):
                rows = hi - lo
                n = np.bincount(t, minlength=rows)
                first = np.zeros(rows + 1, np.int64)
                np.cumsum(n, out=first[1:])
                sums = []
                for salt in (0x1234567, 0x89ABCDEF):
                    total = np.zeros(len(s) + 1, np.uint64)
                    np.cumsum(mix(s ^ np.uint64(salt)), out=total[1:])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                # one-permutation min-hash: the smallest shingle of each sixteenth of the hash space
                segment = (s >> np.uint64(60)).astype(np.int64)
                head = np.ones(len(s), bool)
                head[1:] = (t[1:] != t[:-1]) | (segment[1:] != segment[:-1])
                least = np.zeros((rows, SEGMENTS), np.uint64)
                least[t[head], segment[head]] = s[head]
                pairs = SEGMENTS // BANDS
                bands = np.zeros((rows, BANDS), np.uint64)
                for j in range(pairs):
                    bands = mix(bands * np.uint64(31) + least[:, j * BANDS : (j + 1) * BANDS] + np.uint64(j))
                bands = mix(bands ^ np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists(bands.view(np.int64).ravel(), np.full(rows, BANDS), pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                    names,
                )
                seen.append(s)
                waiting += len(s)
                if waiting >= SORTED_AT_ONCE:
                    yield recurring(seen)
                    seen, waiting = [], 0
        if waiting:
            yield recurring(seen)
            seen.clear()
        released()

    return docs.mapInArrow(scan, "doc_id long, n long, h1 long, h2 long, bands array<long>, shingle long, times long")


def _prefixes(docs: DataFrame, k: int, percent: int, frequent, wanted=None) -> DataFrame:
    """(doc_id, n, prefix[, places, bits, node, smallest]): the first shingles of each set in the global order.

    frequent: broadcast (sorted shingles, places in the order); wanted: broadcast bit filter over shingles to which the
    prefix is restricted; then documents without any are left out and the others have their bitmaps.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = frequent.value
        for batch in batches:
            for lo, hi, t, s in shingle_slices(batch.column(1), k):
                rows = hi - lo
                n = np.bincount(t, minlength=rows)
                order, length = None, np.where(n >= _least(percent), n - (n * percent + 99) // 100 + 1, 0)
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    rank = np.where(late[at] == s, place[at], 0)
                    if rank.any():
                        order = np.lexsort((s, rank, t))
                first = np.zeros(rows + 1, np.int64)
                np.cumsum(n, out=first[1:])
                keep = np.arange(len(s)) - first[t] < length[t]
                chosen = s if order is None else s[order]
                pt, ps = t[keep], chosen[keep]
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(n), lists(ps.view(np.int64), length, pa.int64())], ["doc_id", "n", "prefix"])
                    continue
                at = ps & np.uint64(64 * len(wanted.value) - 1)
                hit = (wanted.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                pos = (np.flatnonzero(keep) - first[pt])[hit]
                pt, ps = pt[hit], ps[hit]
                has = np.unique(pt)
                if not len(has):
                    continue
                of = np.full(rows, -1)
                of[has] = np.arange(len(has))
                mine = of[t] >= 0
                # a power of two of words for each document, so that a longer bitmap folds onto a shorter one
                size = BITMAP << np.ceil(np.log2(np.maximum(1, DENSITY * n[has] / (64 * BITMAP)))).astype(np.int64)
                base = np.r_[0, np.cumsum(size)]
                bits = np.zeros(base[-1], np.uint64)
                b, d = s[mine], of[t[mine]]
                at = b & (64 * size[d] - 1).astype(np.uint64)
                np.bitwise_or.at(bits, base[d] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                node = np.zeros((len(has), BITMAP), np.uint64)
                np.bitwise_or.at(node, (np.repeat(np.arange(len(has)), size), (np.arange(len(bits)) - np.repeat(base[:-1], size)) % BITMAP), bits)
                per = np.bincount(of[pt], minlength=len(has))
                smallest = s[first[has]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows).take(pa.array(has)), pa.array(n[has]), lists(ps.view(np.int64), per, pa.int64()), lists(pos, per, pa.int64()), lists(bits.view(np.int64), size, pa.int64()), lists(node.view(np.int64).ravel(), np.full(len(has), BITMAP), pa.int64()), pa.array(smallest.view(np.int64))],
                    ["doc_id", "n", "prefix", "places", "bits", "node", "smallest"],
                )
        released()

    return docs.mapInArrow(scan, "doc_id long, n long, prefix array<long>" + (", places array<long>, bits array<long>, node array<long>, smallest long" if wanted is not None else ""))


def verified(docs: DataFrame, pairs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The staged pairs (a, b) of document ids that link, by the shingle sets of their whole texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            for lo in range(0, len(a), 256):
                m = min(256, len(a) - lo)
                both = pa.concat_arrays([x.slice(lo, m), y.slice(lo, m)])
                ts, ss, sizes = [], [], np.zeros(2 * m, np.int64)
                for l2, h2, t, s in shingle_slices(both, k):
                    sizes[l2:h2] = np.bincount(t, minlength=h2 - l2)
                    ts.append((t + l2) % m)
                    ss.append(s)
                t, s = np.concatenate(ts), np.concatenate(ss)
                order = np.lexsort((s, t))
                t, s = t[order], s[order]
                same = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
                common = np.bincount(t[1:][same], minlength=m)
                union = sizes[:m] + sizes[m:] - common
                ok = pa.array((100 * common >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([a.slice(lo, m).filter(ok), b.slice(lo, m).filter(ok)], ["a", "b"])
        released()

    left = join_checked(docs, stage(pairs.select(F.col("a").alias("doc_id")).distinct()), ["doc_id"], "left_semi")
    right = join_checked(docs, stage(pairs.select(F.col("b").alias("doc_id")).distinct()), ["doc_id"], "left_semi")
    texts = pairs.hint("merge").join(left.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    texts = texts.hint("merge").join(right.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return stage(texts.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long"))


def _bit_count(a: Column, b: Column | None = None) -> Column:
    """Bits set in an array of longs, or in the AND of two."""
    each = a if b is None else F.zip_with(a, b, lambda p, q: p.bitwiseAND(q))
    return F.aggregate(each, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def _tree_pairs(rows: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) from staged rows (key, pos, doc_id, comp, n), by dual traversal of each key's tree.

    pos: the key's place in the document's order; a linking pair passes the test of places at its first common key.
    bits: (doc_id, bits, node, smallest), a document's bitmap, the same folded to a node's size, and its smallest shingle.
    Pairs are made by sizes and components first, once for all keys that they share; then they meet their bitmaps.
    """
    # sizes of linking sets differ by at most this factor; a class holds sizes within it
    ratio = percent / 100
    share = ratio / (1 + ratio)
    document = F.struct("doc_id", "comp", "n", "pos")
    large = stage(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LEAF).select("key"))
    leaves = [join_checked(rows, large, ["key"], "left_anti").select("key", F.lit(-1).cast("long").alias("id"), document.alias("doc"))]
    pairs = [leaves[0].select("key", "id", F.col("id").alias("other")).distinct()]
    if not large.isEmpty():
        many = join_checked(rows, large, ["key"], "inner").join(bits.select("doc_id", "node", "smallest"), "doc_id")
        # a path: the size class, bits of the smallest shingle, bits of the document
        like = F.shiftrightunsigned(F.xxhash64("smallest"), 64 - LIKE_BITS)
        many = many.withColumn("class", F.floor(-F.log(F.col("n").cast("double")) / F.log(F.lit(ratio))).cast("long"))
        many = many.withColumn("path", F.shiftleft(like, PATH_BITS - LIKE_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - PATH_BITS + LIKE_BITS)))
        many = stage(many.withColumn("like", like))
        # a tree is as deep as its fullest part needs
        full = many.groupBy("key", "class", "like").agg(F.count("*").alias("m")).groupBy("key").agg(F.max("m").alias("m"))
        levels = LIKE_BITS // LEVEL_BITS + F.greatest(F.lit(0), F.ceil(F.log(F.col("m") / F.lit(float(LEAF))) / F.log(F.lit(2.0**LEVEL_BITS))))
        depth = stage(full.select("key", F.least(levels, F.lit(PATH_BITS // LEVEL_BITS)).cast("int").alias("depth")))
        deepest = depth.agg(F.max("depth")).first()[0]
        many = join_checked(many, depth, ["key"], "inner").withColumn("id", F.expr(f"shiftleft(class, {PATH_BITS}) | shiftrightunsigned(path, {PATH_BITS} - {LEVEL_BITS} * depth)"))
        leaves.append(many.select("key", "id", document.alias("doc")))
        ranges = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.array(*[F.bit_or(F.col("bits")[i]) for i in range(BITMAP)]).alias("bits"), F.min("b0").alias("b0")]
        own = many.select("key", "id", "depth", F.lit(0).alias("up"), F.col("n").alias("lo"), F.col("n").alias("hi"), F.col("comp").alias("c0"), F.col("comp").alias("c1"), F.col("node").alias("bits"), _bit_count(F.col("node")).alias("b0"))
        level = stage(own.groupBy("key", "id", "depth", "up").agg(*ranges))
        nodes = [level]
        for _ in range(deepest):  # up to the size classes
            mask = F.expr(f"shiftleft(shiftrightunsigned(id, {PATH_BITS}), {PATH_BITS}) | shiftrightunsigned(id & {(1 << PATH_BITS) - 1}L, {LEVEL_BITS})")
            level = stage(level.where("up < depth").withColumns({"id": mask, "up": F.col("up") + 1}).groupBy("key", "id", "depth", "up").agg(*ranges))
            nodes.append(level)
        tree = nodes[0]
        for level in nodes[1:]:
            tree = tree.union(level)
        tree = tree.withColumn("parent", F.expr(f"shiftleft(shiftrightunsigned(id, {PATH_BITS}), {PATH_BITS}) | shiftrightunsigned(id & {(1 << PATH_BITS) - 1}L, {LEVEL_BITS})")).withColumn("level", F.col("depth") - F.col("up"))
        kept = ("id", "lo", "hi", "c0", "c1", "bits", "b0")
        node = lambda name: F.struct(*kept).alias(name)

        def fits(p: str, q: str) -> Column:
            """Documents of p and q may have bitmaps that overlap enough: |a - b| is at most (1 - share) |a| - share |b|."""
            missing = (1 - share) * F.col(f"{p}.hi") - share * F.col(f"{q}.lo")
            return _bit_count(F.col(f"{p}.bits"), F.col(f"{q}.bits")) >= F.col(f"{p}.b0") - missing

        near = (F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent)
        apart = (F.col("x.c0") != F.col("x.c1")) | (F.col("y.c0") != F.col("y.c1")) | (F.col("x.c0") != F.col("y.c0"))
        linkable = (F.col("x.id") <= F.col("y.id")) & near & apart & fits("x", "y") & fits("y", "x")
        at = tree.where("level = 0")
        front = stage(at.select("key", "depth", node("x")).hint("merge").join(at.select("key", node("y")).hint("merge"), "key").where(linkable).select("key", "depth", F.col("x.id").alias("id"), F.col("y.id").alias("other")))
        for k in range(1, deepest + 1):
            below = tree.where(F.col("level") == k)
            front = front.where(F.col("depth") >= k).hint("merge").join(below.select("key", F.col("parent").alias("id"), node("x")).hint("merge"), ["key", "id"])
            front = front.hint("merge").join(below.select("key", F.col("parent").alias("other"), node("y")).hint("merge"), ["key", "other"]).where(linkable)
            front = stage(front.select("key", "depth", F.col("x.id").alias("id"), F.col("y.id").alias("other")))
            pairs.append(front.where(F.col("depth") == k).select("key", "id", "other"))
    leaf, nodes = leaves[0], pairs[0]
    for more in leaves[1:]:
        leaf = leaf.union(more)
    for more in pairs[1:]:
        nodes = nodes.union(more)
    leaf = stage(leaf.groupBy("key", "id").agg(F.collect_list("doc").alias("docs")))
    own = F.col("id") == F.col("other")
    nodes = nodes.hint("merge").join(leaf.select("key", "id", F.col("docs").alias("x")), ["key", "id"]).hint("merge").join(leaf.select("key", F.col("id").alias("other"), F.col("docs").alias("y")), ["key", "other"])
    nodes = nodes.select(own.alias("own"), "x", "y")

    def sized(p: Column, q: Column) -> Column:
        # where the key is the first common shingle, all common ones stand from it on in both orders
        left = F.least(p["n"] - p["pos"], q["n"] - q["pos"])
        return (p["comp"] != q["comp"]) & (~F.col("own") | (p["doc_id"] < q["doc_id"])) & (left * (100 + percent) >= (p["n"] + q["n"]) * percent)

    pair = lambda p, q: F.struct(F.least(p["doc_id"], q["doc_id"]).alias("a"), F.greatest(p["doc_id"], q["doc_id"]).alias("b"), F.when(p["doc_id"] < q["doc_id"], p["n"]).otherwise(q["n"]).alias("na"), F.when(p["doc_id"] < q["doc_id"], q["n"]).otherwise(p["n"]).alias("nb"))
    found = nodes.select("own", F.col("x").alias("p"), F.col("y").alias("q"))
    found = found.select(F.explode(F.flatten(F.transform("p", lambda a: F.transform(F.filter("q", lambda b: sized(a, b)), lambda b: pair(a, b))))).alias("e"))
    found = found.select("e.a", "e.b", "e.na", "e.nb").distinct()
    found = found.join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("p")), "a").join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("q")), "b")
    # sizes of linking sets are close, so their bitmaps are alike or one folds once
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseOR(y))
    found = found.withColumns({"p": F.when(F.size("p") > F.size("q"), half("p")).otherwise(F.col("p")), "q": F.when(F.size("q") > F.size("p"), half("q")).otherwise(F.col("q"))})
    bound = lambda p, q, m, n: _bit_count(F.col(p), F.col(q)) >= _bit_count(F.col(p)) - ((1 - share) * F.col(m) - share * F.col(n))
    return found.where(bound("p", "q", "na", "nb") & bound("q", "p", "nb", "na")).select("a", "b").distinct()


def _bit_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A bit for each value of the keys' low bits, as an array of 64-bit words (a power of two of them)."""
    bits = 1 << 20
    while bits < min(MOST_FILTER_BITS, FILTER_BITS * n):
        bits *= 2
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, stars: bool = True) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs, which is read several times and so best a stored table.

    Without stars the trees make all links but those of equal sets; the result is the same.
    """
    spark = docs.sparkSession
    docs = _texts(docs, id_col, text_col)
    scanned = stage(_signatures(docs, k))
    signed = scanned.where("n is not null").drop("shingle", "times")
    times = scanned.where("n is null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    top = times.orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT).toPandas()
    late = top["shingle"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(late)
    frequent = spark.sparkContext.broadcast((late[by], (len(late) - np.arange(len(late)))[by]))

    # 1. equal sets
    sets = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("copies"))
    sets = stage(sets)
    members = signed.select("doc_id", "n", "h1", "h2").hint("merge").join(sets.where("copies > 1").select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left")
    members = stage(members.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")))
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # 2. stars
    if stars:
        banded = sets.where(F.col("n") >= _least(percent)).select("rep", F.explode("bands").alias("band"))
        hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").select("band", "hub")
        hubbed = banded.hint("merge").join(hubs, "band").where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("m"))
        hubbed = stage(hubbed.groupBy("rep").agg(F.max_by("hub", F.struct("m", -F.col("hub"))).alias("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    known = copies.union(verified(docs, hubbed, k, percent)) if stars else copies
    comps = components(known, "a", "b")
    comps = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))

    # 3. trees
    with_comp = lambda df: join_checked(df, comps, ["doc_id"], "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    roots = with_comp(_prefixes(docs.where("doc_id is not null"), k, percent, frequent)).select("comp", F.explode("prefix").alias("key"))
    roots = roots.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    roots = stage(roots)
    n_roots = roots.count()
    if not n_roots:
        final = comps
    else:
        filter_ = spark.sparkContext.broadcast(_bit_filter(roots, n_roots))
        near = stage(_prefixes(docs.where("doc_id is not null"), k, percent, frequent, filter_))
        # the filter lets some others pass; one document of each set is enough
        rows = near.select("doc_id", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("doc_id", "n", F.col("p.prefix").alias("key"), F.col("p.places").alias("pos")).hint("merge").join(roots, "key", "left_semi")
        extra = stage(copies.select(F.col("a").alias("doc_id")).distinct())
        rows = with_comp(join_checked(rows, extra, ["doc_id"], "left_anti")).select("key", "pos", "doc_id", "comp", "n").distinct()
        links = verified(docs, stage(_tree_pairs(stage(rows), near.select("doc_id", "bits", "node", "smallest").dropDuplicates(["doc_id"]), percent)), k, percent)
        linked = with_comp(links.select(F.col("a").alias("doc_id"), "b")).select(F.col("comp").alias("a"), F.col("b").alias("doc_id"))
        linked = with_comp(linked).select("a", F.col("comp").alias("b"))
        merged = components(linked, "a", "b").select(F.col("node").alias("comp"), F.col("component").alias("to"))
        final = stage(comps.join(merged, "comp", "left").select("doc_id", F.coalesce("to", "comp").alias("comp")).union(join_checked(merged.select(F.col("comp").alias("doc_id"), F.col("to").alias("comp")), comps.select("doc_id"), ["doc_id"], "left_anti")))
    # a row without an id has the component of its equals
    node = members.select("doc_id", "n", F.coalesce("doc_id", "rep").alias("node"))
    out = node.hint("merge").join(final.select(F.col("doc_id").alias("node"), "comp"), "node", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
