"""Periodic runs of words: stretches that repeat a block of words, found by branching tandem repeats in an enhanced suffix
array (suffixes, their inverse, longest common prefixes), without a suffix tree.

A square of period q at i whose two halves part right behind it (i and i + q share exactly q words) ends a run. Such
suffixes stand in one interval of common prefix q, in different children of it. So for each interval the suffixes i of
all children but the largest are asked whether i + q or i - q stands in the interval, in another child; with the largest
left out, that is O(n log n) questions. From the square the run goes left as long as its words rotate; squares of a run
by a multiple of its period give the same stretch, of which the smallest period stays.

The arrays are built for a slice of texts at once, with numpy: suffixes by doubling, where only suffixes that are not
yet told apart move on; the ranks of each doubling give common prefixes; intervals and children come from the nearest
smaller prefixes. Suffixes of different texts are never equal. In a run of the least exponent e, each three words in a row
stand e - 1 times at least, so places where they are rarer split a text before its suffixes are sorted.

Cases: null and empty texts have no words and no runs; repeated rows are judged each by itself; an empty table gives an
empty result; other columns of the input are ignored. The job is one pass without a shuffle; a task holds the arrays of
one slice, that is of a megabyte of text or of one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .spark_tools import table, text_batches
from .text_kernels import SLICE_BYTES, released

#: A run has at least so many words, and its period at least so many times.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
GRAM = 3
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def frequent_stretches(codes: np.ndarray, part: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and the number of their stretch: in it each three words in a row stand `times` times or more in their part."""
    at = np.arange(len(codes))
    for _ in range(3):
        if times < 2 or not len(codes):
            break
        code = codes[at]
        m = max(0, len(at) - GRAM + 1)
        key = code[:m].astype(np.int64)
        for j in range(1, GRAM):
            key = pd.factorize(key)[0] * np.int64(code.max() + 1) + code[j : j + m]
        key = pd.factorize(pd.factorize(key)[0] * np.int64(part.max() + 1) + part[:m])[0] if m else key
        good = np.zeros(len(at), bool)
        good[:m] = (np.bincount(key)[key] >= times if m else False) & (part[:m] == part[GRAM - 1 :])
        first = np.flatnonzero(good & ~np.r_[False, good[:-1] & (part[1:] == part[:-1])])
        last = np.flatnonzero(good & ~np.r_[good[1:] & (part[1:] == part[:-1]), False])
        sizes = last - first + GRAM
        kept = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        before, at, part = len(at), at[kept], np.repeat(np.arange(len(first)), sizes)
        if len(at) > 0.9 * before or not len(at):
            break
    return at, part


def suffix_order(codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of all parts in order, and the ranks by 1, 2, 4, ... words: equal ranks at a level, equal words.

    A rank is the first place of its group; behind the last position stands a rank of its own.
    """
    n = len(codes)
    rank = np.full(n + 1, n, np.int64)
    key = part * np.int64(codes.max() + 1) + codes
    order = np.argsort(key, kind="stable")
    active, ordered = np.arange(n), key[order]
    levels: list[np.ndarray] = []
    step = 0
    while True:
        # ordered: the keys of the active places, in order; equal neighbours are a group
        same = ordered[1:] == ordered[:-1]
        rank[order[active]] = np.maximum.accumulate(np.where(np.r_[True, ~same], active, 0))
        levels.append(rank.astype(np.int32))
        active = active[np.r_[False, same] | np.r_[same, False]]
        if not len(active):
            return order, levels
        step = 2 * step or 1
        here = order[active]
        ahead = np.minimum(here + step, n)
        inside = ahead < n
        inside[inside] = part[ahead[inside]] == part[here[inside]]
        key = rank[here] * np.int64(n + 2) + np.where(inside, rank[ahead] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[active], ordered = here[by], key[by]


def common_prefix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at i and at j (never the same) share."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][i + out] == levels[k][j + out]).astype(np.int64) << k
    return out


def common_suffix(levels: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words before i equal those before i + q."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        back = i - out - (1 << k)
        ok = back >= 0
        safe = np.where(ok, back, 0)
        out += (ok & (levels[k][safe] == levels[k][safe + np.where(ok, q, 0)])).astype(np.int64) << k
    return out


def nearest_smaller(lcp: np.ndarray) -> list[np.ndarray]:
    """For each place r: the last place before it with lcp <= lcp[r], with lcp < lcp[r], and the first ones behind it.
    lcp begins and ends with -1, which have none; theirs are themselves."""
    n = len(lcp)
    mins = [lcp]  # mins[k][r]: the least of lcp[r : r + 2 ** k]
    while 2 << (len(mins) - 1) <= n:
        h = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][: len(mins[-1]) - h], mins[-1][h:]))
    inner, out = np.arange(1, n - 1), []
    for direction in (-1, 1):
        for bound in (lcp[inner] + 1, lcp[inner]):  # the nearest with lcp < bound
            at = inner + direction  # all places between r and at have lcp >= bound
            for k in range(len(mins) - 1, -1, -1):
                lo = at - (1 << k) + 1 if direction < 0 else at
                ok = (lo >= 0) & (lo < len(mins[k]))
                ok[ok] = mins[k][lo[ok]] >= bound[ok]
                at = at + direction * (ok.astype(np.int64) << k)
            out.append(at)
    return out


def tandem_repeats(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) of all branching tandem repeats: i and i + q share exactly q words. lcp[r]: of the suffixes at places r - 1
    and r, with -1 at both ends."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    same_left, lower_left, same_right, lower_right = nearest_smaller(lcp)
    r = np.arange(1, n)
    depth = lcp[1:n]
    deep = depth > 0
    # the child on the right of each border inside an interval, and the first child of each interval
    begins = deep & (same_left == lower_left)
    lo = np.r_[r[deep], lower_left[begins]]
    hi = np.r_[same_right[deep], r[begins]]  # the place behind the child
    left, right, q = (np.r_[x[deep], x[begins]] for x in (lower_left, lower_right, depth))
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # all children of an interval but the largest
    by = np.lexsort((lo - hi, q, left))
    largest = np.r_[True, (left[by][1:] != left[by][:-1]) | (q[by][1:] != q[by][:-1])]
    by = by[~largest]
    lo, hi, left, right, q = lo[by], hi[by], left[by], right[by], q[by]
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    i = order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]]
    found = []
    for side in (1, -1):
        j = i + side * q[which]
        ok = np.flatnonzero((j >= 0) & (j < n))
        p, w = place[j[ok]], which[ok]
        ok = ok[(left[w] <= p) & (p < right[w]) & ((p < lo[w]) | (p >= hi[w]))]
        found.append(np.c_[np.minimum(i[ok], j[ok]), q[which[ok]]])
    found = np.unique(np.concatenate(found), axis=0)
    return found[:, 0], found[:, 1]


def runs_of(codes: np.ndarray, text: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; codes: numbers of the words of all texts in
    a row, text: the number of each word's text; starts count from the row's first word."""
    at, part = frequent_stretches(codes, text, min(max(least, exponent) - GRAM + 1, exponent - 1))
    none = np.zeros(0, np.int64)
    if len(at) < 2:
        return none, none, none, none
    order, levels = suffix_order(codes[at], part)
    lcp = np.r_[-1, common_prefix(levels, order[:-1], order[1:]), -1]
    i, q = tandem_repeats(order, lcp)
    # a run ends behind the square, since its halves part there
    back = common_suffix(levels, i, q)
    length = back + 2 * q
    long_ = length >= np.maximum(least, exponent * q)
    start, length, q = at[(i - back)[long_]], length[long_], q[long_]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, q = start[first], length[first], q[first]
    by = np.lexsort((q, start))
    return text[start[by]], start[by], length[by], q[by]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row for each row of docs: its id, n_words, runs (start, length, period in words, by start, then period) and
    collapsed: its words joined by blanks, without those that a run has beyond its first period.

    A run is a longest stretch with smallest period q, of at least `least` words and `exponent` * q words (2 or more).
    """
    if exponent < 2:
        raise ValueError("a run has its period twice at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            lo = 0
            while lo < len(texts):
                words: list[bytes] = []
                ends, size, hi = [], 0, lo
                while hi < len(texts) and (hi == lo or size < SLICE_BYTES):
                    data = (texts[hi].as_py() or "").encode()
                    words += data.split()  # at ASCII white space, as these are bytes
                    ends.append(len(words))
                    size += len(data)
                    hi += 1
                yield described(batch.column(0).slice(lo, hi - lo), words, np.array(ends))
                lo = hi
        released()

    def described(ids: pa.Array, words: list[bytes], ends: np.ndarray) -> pa.RecordBatch:
        begins = np.r_[0, ends[:-1]]
        of, start, length, period = np.zeros((4, 0), np.int64)
        if words:
            codes = pd.factorize(np.array(words, object))[0].astype(np.int64)
            of, start, length, period = runs_of(codes, np.repeat(np.arange(len(ends)), ends - begins), least, exponent)
        # a word is dropped where more runs have begun to repeat than have ended
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        drop, hit = np.cumsum(change) > 0, np.zeros(len(ends), bool)
        hit[of] = True
        out = []
        for a, b, h in zip(begins.tolist(), ends.tolist(), hit.tolist(), strict=True):
            kept = words[a:b] if not h else [w for w, d in zip(words[a:b], drop[a:b].tolist(), strict=True) if not d]
            out.append(b" ".join(kept).decode())
        inner = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
        offsets = pa.array(np.searchsorted(of, np.arange(len(ends) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([ids, pa.array(ends - begins), pa.ListArray.from_arrays(offsets, inner), pa.array(out, pa.string())], schema.names)

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(SCHEMA)])
    return rows.mapInArrow(find, schema).withColumnRenamed("id", id_col)


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first, then the one with the smallest period.

    Ratios of numbers below 2 ** 26 are equal as doubles only if they are equal.
    """
    places = F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length")))
    return F.array_max(places)


def repeating(doc_id: Column, text: Column) -> Column:
    """Text of which one in ten ids repeats a block of its words from some word on; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text")))
    best, lines = greatest_run(F.col("runs")), F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    start, period, length = -F.col("best.s"), -F.col("best.p"), F.col("best.length")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
