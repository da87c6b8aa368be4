"""Toxicity: nearest labelled examples by exact TF-IDF cosine, with block-max inverted indexes and weighted votes.

The examples are the distinct vectors of a bounded sample of the labelled rows that may be learned from, with the
number of rows and of toxic rows. The terms are all words of the examples; none is left out. A word weighs
(1 + log count) * idf * tie: idf counts all documents, and tie is how closely the word goes with the label among the
examples (the phi coefficient, FLOOR where it is not significant), as plain TF-IDF finds examples on the same subject
more often than toxic ones (README: measured). Postings are sorted by term. Terms that many examples have are cut into
blocks of rows with each block's greatest weight; a search adds up the rarer terms, visits blocks by falling upper bound
and stops when no block can hold one of the `k` nearest, so cosines are exact (to single precision). Neighbours vote by
rows, with weights that fall with the distance; the prior of all examples is added as a few more votes, which
calibrates thin evidence. A text without any term has the share of toxic rows among such examples.

Cases: null and empty texts are texts without terms; unlabelled and null labels are not learned from; without any
labelled row every score is 0; identical rows score alike; rows that share a doc_id are scored each by itself, and are
one example, their smallest text; equally near examples are taken by their place in the index, which depends on the
examples only; an empty table gives an empty result; other columns are never looked at. A null doc_id is scored, and
learned from by no one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .spark_tools import stage, table, text_batches
from .text_kernels import ALNUM, lists, released, slices, word_hashes, words

#: Bound of the sample that is learned from; chi-squared and rows that a word needs to weigh more than FLOOR.
FIT_ROWS, CHI2, LEAST_ROWS, FLOOR = 20_000, 15.0, 4, 0.01
K, BLOCK, SHARPNESS, PRIOR_VOTES = 10, 64, 4.0, 0.5
#: A term has blocks if more than one of so many examples has it; blocks that are visited first; texts that are searched together, and
#: those of them with one product; results that a worker keeps for equal texts.
COMMON, FIRST, TOGETHER, GROUP, KEPT = 12, 4, 256, 64, 5_000
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Vocabulary:
    """Sorted word hashes, with the place where each value of their first bits begins."""

    BITS = 20

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.begin = np.searchsorted(words, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.words)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.words):
            return out
        at, left = self.begin[(h >> np.uint64(64 - self.BITS)).astype(np.int64)].astype(np.int64), np.arange(len(h))
        while len(left):
            word = self.words[np.minimum(at, len(self.words) - 1)]
            hit = word == h
            out[left[hit]] = at[hit]
            more = (word < h) & (at < len(self.words) - 1)
            at, left, h = at[more] + 1, left[more], h[more]
        return out


def _counted(column: pa.Array, vocabulary: Vocabulary | None = None) -> Iterator[tuple]:
    """(first row, row after the last, row, word, count) for each slice of a text column, by row and word.

    A word is its hash, or its place in the vocabulary; then words that it lacks are left out.
    """
    for lo, hi, raw, off in slices(column):
        start, end, bounds = words(raw, off, ALNUM)
        word = word_hashes(raw, start, end)
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        if vocabulary is None:
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
        else:
            at = vocabulary.places(word)
            code = np.sort(row[at >= 0] * max(1, len(vocabulary)) + at[at >= 0])
            row, word = np.divmod(code, max(1, len(vocabulary)))
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])]) if len(word) else np.zeros(0, np.int64)
        yield lo, hi, row[first], word[first], np.diff(np.r_[first, len(word)])


def _words(fit: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted word hashes of the sample's texts, and how many texts and toxic texts have each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, word, _ in _counted(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(word.view(np.int64))], ["toxic", "word"])

    rows = fit.select("toxic", "text").mapInArrow(scan, "toxic int, word long")
    found = rows.groupBy("word").agg(F.count("*").alias("m"), F.sum("toxic").alias("m1")).toArrow()
    word = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], *(found.column(c).to_numpy()[order].astype(np.float64) for c in ("m", "m1"))


def _examples(fit: DataFrame, vocabulary: Broadcast, weight: Broadcast, parts: int = 8) -> pa.Table:
    """(id, toxic, place, terms, weights) of the sample's texts, unit vectors; they come to the driver in parts.

    place: an example's two most frequent words, which tell languages apart, and its heaviest one that goes with a label.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, tied = weight.value
        for batch in batches:
            for lo, hi, row, term, n in _counted(batch.column(2), vocabulary.value):
                per = np.bincount(row, minlength=hi - lo)
                ends = np.r_[0, np.cumsum(per)]
                w = (1 + np.log(n)) * all_[term]
                w /= np.sqrt(np.bincount(row, w * w, hi - lo))[row]
                place = np.full((hi - lo, 3), -1)
                for i in np.flatnonzero(per):
                    own = slice(ends[i], ends[i + 1])
                    often = term[own][np.lexsort((all_[term[own]], -n[own]))[:2]]
                    place[i, : len(often)] = often
                    heavy = np.where(tied[term[own]], w[own], 0)
                    place[i, 2] = term[own][heavy.argmax()] if heavy.any() else -1
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in (0, 1)], lists(place.ravel(), np.full(hi - lo, 3), pa.int32()), lists(term, per, pa.int32()), lists(w, per, pa.float32())], ["id", "toxic", "place", "terms", "weights"])

    fields = [T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType()))]
    schema = T.StructType([*fit.schema.fields[:2], *fields])
    found = [fit.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).mapInArrow(scan, schema).toArrow() for i in range(parts)]
    # by id, so that equal samples give equal indexes
    return pa.concat_tables(found).combine_chunks().sort_by("id")


def _document_counts(texts: DataFrame, vocabulary: Broadcast) -> tuple[np.ndarray, int]:
    """In how many texts each word of the broadcast vocabulary is, and the number of texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary.value), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for *_, word, _ in _counted(batch.column(0), vocabulary.value):
                total += np.bincount(word, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), pa.array(np.r_[rows, total[seen]])], ["word", "n"])
        released()

    # at most a row for each word of the examples
    found = texts.mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = (found.column(i).to_numpy() for i in (0, 1))
    out = np.zeros(len(vocabulary.value), np.int64)
    out[word[word >= 0]] = n[word >= 0]
    return out, int(n[word < 0].sum())


def _distinct(term: np.ndarray, w: np.ndarray, ends: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """The examples of each different vector, and those without a word."""
    kinds: dict[int, list[int]] = {}
    for i in range(len(ends) - 1):
        own = slice(ends[i], ends[i + 1])
        kinds.setdefault(hash((term[own].tobytes(), w[own].tobytes())), []).append(i)
    groups: list[list[int]] = []
    for same in kinds.values():
        rest = same
        while rest:  # those that only share a hash are told apart
            first = slice(ends[rest[0]], ends[rest[0] + 1])
            alike = [i for i in rest if np.array_equal(term[ends[i] : ends[i + 1]], term[first]) and np.array_equal(w[ends[i] : ends[i + 1]], w[first])]
            groups.append(alike)
            done = set(alike)
            rest = [i for i in rest if i not in done]
    return [g for g in groups if ends[g[0] + 1] > ends[g[0]]], [i for g in groups if ends[g[0] + 1] == ends[g[0]] for i in g]


class BlockMaxIndex:
    """Postings of unit vectors by term; nearest() gives the k nearest rows exactly."""

    def __init__(self, vectors: np.ndarray, block: int = BLOCK) -> None:
        row, term = np.nonzero(vectors)
        self._build(row, term, vectors[row, term], vectors.shape, block)

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, shape: tuple[int, int], block: int = BLOCK) -> BlockMaxIndex:
        out = cls.__new__(cls)
        out._build(row, term, weight, shape, block)
        return out

    def _build(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, shape: tuple[int, int], block: int) -> None:
        self.n, terms = shape
        self.block, self.blocks = block, -(-self.n // block)
        size = np.bincount(term, minlength=terms)
        often = size > self.n // COMMON
        self.column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        common = often[term]
        # a common term's weights by block, and the greatest of each block
        self.dense = np.zeros((int(often.sum()), self.blocks, block), np.float32)
        self.dense[self.column[term[common]], row[common] // block, row[common] % block] = weight[common]
        self.most = self.dense.max(2)
        order = np.lexsort((row[~common], term[~common]))
        # a posting is a row and the weight's bits, side by side
        self.postings = np.empty((len(order), 2), np.int32)
        self.postings[:, 0] = row[~common][order]
        self.postings[:, 1] = weight[~common][order].astype(np.float32).view(np.int32)
        self.start = np.r_[0, np.cumsum(np.where(often, 0, size))].astype(np.int32)

    def _rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the rarer terms add to each row, by block."""
        if not len(terms):
            return np.zeros((self.blocks, self.block), np.float32)
        lo, hi = self.start[terms], self.start[terms + 1]
        found = np.concatenate(list(map(self.postings.__getitem__, map(slice, lo.tolist(), hi.tolist()))))
        added = np.ascontiguousarray(found[:, 1]).view(np.float32) * np.repeat(weights.astype(np.float32), hi - lo)
        return np.bincount(found[:, 0], added, self.blocks * self.block).astype(np.float32).reshape(self.blocks, self.block)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((rows, -scores))[:k]
        return rows[best], scores[best]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the k nearest for each query (terms, weights), best first, equals by row."""
        columns = [self.column[t] for t, _ in queries]
        q = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (c, (_, w)) in enumerate(zip(columns, queries, strict=True)):
            q[i, c[c >= 0]] = w[c >= 0]
        bounds = q @ self.most
        out: list = [None] * len(queries)
        rest = []
        for i, (c, (t, w)) in enumerate(zip(columns, queries, strict=True)):
            part = self._rare(t[c < 0], w[c < 0])
            bound = bounds[i] + part.max(1)
            order = np.argsort(-bound, kind="stable")
            c, w = c[c >= 0], q[i, c[c >= 0]]
            rows, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
            for at in (order[:FIRST], order[FIRST:]):
                least = max(1e-9, scores[k - 1] - 1e-6 if len(scores) >= k else 0)
                at = at[bound[at] >= least]
                if len(at) > max(FIRST, self.blocks // 8):  # many blocks: one product for several such queries
                    rest.append((int(bounds[i].argmax()), i, part, at, order[:FIRST]))
                    break
                if len(at):
                    s = part[at] + (w @ self.dense[c[:, None], at[None, :]].reshape(len(c), len(at) * self.block)).reshape(len(at), self.block)
                    b, r = np.nonzero(s > least)
                    rows, scores = self._best(np.r_[rows, at[b] * self.block + r], np.r_[scores, s[b, r]], k)
            else:
                out[i] = rows, scores
        # queries whose common terms have the same best block have many terms and blocks in common
        rest.sort(key=lambda x: x[:2])
        for lo in range(0, len(rest), GROUP):
            group = rest[lo : lo + GROUP]
            mine = q[[x[1] for x in group]]
            c, at = np.flatnonzero(mine.any(0)), np.unique(np.concatenate([x[3] for x in group] + [x[4] for x in group]))
            if 2 * len(at) > self.blocks:  # whole rows are copied faster
                at = np.arange(self.blocks)
                dense = self.dense[c]
            else:
                dense = self.dense[c[:, None], at[None, :]]
            products = (mine[:, c] @ dense.reshape(len(c), len(at) * self.block)).reshape(len(group), len(at), self.block)
            for s, (_, i, part, _, _) in zip(products, group, strict=True):
                s += part if len(at) == self.blocks else part[at]
                top = s.max(1)
                least = np.partition(top, -k)[-k] if len(top) >= k else 0
                b, r = np.nonzero(s >= max(least, 1e-9))
                out[i] = self._best(at[b] * self.block + r, s[b, r], k)
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", k: int = K, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, score, evidence) for each row of docs; evidence: array of (id, cosine, rows, toxic) of the neighbours,
    id being one row with that vector. labels: the labelled ids that may be learned from."""
    context = docs.sparkSession.sparkContext
    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = stage(usable.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_rows))
    # at most fit_rows rows, also where ids repeat
    fit = stage(rows.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    counts = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    total = max(1, sum(counts.values()))
    prior = counts.get(1, 0) / total
    words_, m, m1 = _words(fit)
    shared = context.broadcast(Vocabulary(words_))
    df, all_rows = _document_counts(rows.select("text"), shared)
    # how closely a word goes with the label
    phi2 = (m1 - m * prior) ** 2 / np.maximum(m * prior * (1 - prior) * (total - m), 1e-9)
    tie = np.where((phi2 * total >= CHI2) & (m >= LEAST_ROWS), np.maximum(np.sqrt(phi2), FLOOR), FLOOR)
    weights = context.broadcast(((np.log((1 + all_rows) / (1 + df)) + 1) * tie, tie > FLOOR))
    terms = len(words_)
    del words_, m, m1, df, phi2, tie

    # equal vectors are one example; alike ones are neighbours in the index
    found = _examples(fit, shared, weights)
    ids, toxic = found.column("id"), found.column("toxic").to_numpy().astype(np.float64)
    place = found.column("place").combine_chunks().flatten().to_numpy().reshape(-1, 3).tolist()
    term, w = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "weights"))
    ends = np.asarray(found.column("terms").combine_chunks().offsets)
    groups, blank = _distinct(term, w, ends)
    groups = [groups[i] for i in sorted(range(len(groups)), key=lambda i: (place[groups[i][0]], groups[i][0]))]
    own = np.concatenate([np.arange(ends[g[0]], ends[g[0] + 1], dtype=np.int32) for g in groups]) if groups else np.zeros(0, np.int32)
    term, w = term[own], w[own]
    row = np.repeat(np.arange(len(groups), dtype=np.int32), [ends[g[0] + 1] - ends[g[0]] for g in groups])
    index = BlockMaxIndex.of(row, term, w, (len(groups), terms))
    votes, bad = np.array([float(len(g)) for g in groups]), np.array([toxic[g].sum() for g in groups])
    names = ids.take(pa.array([g[0] for g in groups], pa.int64())).combine_chunks()
    blank_score = float((toxic[blank].sum() + PRIOR_VOTES * prior) / (len(blank) + PRIOR_VOTES)) if counts else 0.0
    model = context.broadcast((index, votes, bad, names))
    del found, ids, term, w, own, row, index
    released()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index, votes, bad, names), weight = model.value, weights.value[0]
        known: dict = {}

        def judge(vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
            """(score, rows, cosines) for each vector (terms, counts)."""
            asked = [i for i, (t, _) in enumerate(vectors) if len(t) and index.n]
            weighted = [(1 + np.log(c)) * weight[t] for t, c in map(vectors.__getitem__, asked)]
            found = index.nearest_of([(vectors[i][0], q / np.linalg.norm(q)) for i, q in zip(asked, weighted, strict=True)], k) if asked else []
            out = [(blank_score, np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
            for i, (near, cosine) in zip(asked, found, strict=True):
                cosine = np.minimum(cosine.astype(np.float64), 1)
                v = votes[near] * np.exp(SHARPNESS * (cosine - 1))
                out[i] = float((v @ (bad[near] / votes[near]) + PRIOR_VOTES * prior) / (v.sum() + PRIOR_VOTES)), near, cosine
            return out

        for batch in batches:
            for lo, hi, row, term, n in _counted(batch.column(1), shared.value):
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                own = [(term[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                keys = [(t.tobytes(), c.tobytes()) for t, c in own]
                if len(known) > KEPT:
                    known.clear()
                new = list({key: i for i, key in enumerate(keys) if key not in known}.items())
                for at in range(0, len(new), TOGETHER):
                    some = new[at : at + TOGETHER]
                    known.update(zip((key for key, _ in some), judge([own[i] for _, i in some]), strict=True))
                results = list(map(known.__getitem__, keys))
                near = np.concatenate([r[1] for r in results])
                inner = pa.StructArray.from_arrays([names.take(pa.array(near)), pa.array(np.concatenate([r[2] for r in results])), pa.array(votes[near].astype(np.int64)), pa.array(bad[near].astype(np.int64))], ["id", "cosine", "rows", "toxic"])
                offsets = pa.array(np.cumsum([0, *(len(r[1]) for r in results)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.clip([r[0] for r in results], 0, 1)), pa.ListArray.from_arrays(offsets, inner)], ["id", "score", "evidence"])
        released()

    kind = rows.schema["id"].dataType
    neighbour = T.StructType([T.StructField("id", kind), T.StructField("cosine", T.DoubleType()), T.StructField("rows", T.LongType()), T.StructField("toxic", T.LongType())])
    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(neighbour))])
    return rows.mapInArrow(search, schema).withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels.select("doc_id", "toxic"))
    top = F.get("evidence", F.lit(0))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), top["id"].alias("nearest"), top["cosine"].alias("nearest_cosine"))
