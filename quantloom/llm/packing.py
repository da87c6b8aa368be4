"""Best-fit packing by patterns: non-negative least squares over few-document patterns, then best fit of the rest.

Documents become token pieces of at most `width` tokens. The histogram of piece lengths (at most `width` numbers,
whatever the input) comes to the driver. There, lengths are put into classes of `grain` tokens; all patterns of two
to four classes that fill a sequence are enumerated, their repeat counts are fitted to the class histogram by
non-negative least squares and rounded down (a share of them: the best of three is kept), and the pieces left over are
packed by best fit on exact lengths, into the gaps of the patterns' sequences and into new ones. The plan is a list of runs (lengths, how many sequences) whose
size depends on `width` alone. In Spark each piece gets its rank among the pieces of its length (salted, so that one
length may hold any share of the rows), and the rank picks the place in the plan.

Cases: null and empty texts are one piece, the end token; repeated rows are packed each by itself; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .spark_tools import stage, table, text_batches
from .text_kernels import released

WIDTH, END = 4096, 1
#: Strings whose ids a Python worker keeps from the last texts, and from those before; characters that are looked up together.
CACHE, AT_ONCE = 60_000, 1 << 20
#: Latin words, maybe with ASCII punctuation behind: they are one or two pre-tokens, and no normalization but lower case applies.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\\[-`{-~]*")
_BORDER = re.compile("([a-zß-öø-ÿ])([!-&(-/:-@\\[-`{-~])")
_END = "</w>"


@functools.cache
def word_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary at path as ranked byte strings, and the id of each rank.

    A blank behind a word stands for its end and is joined to its last byte first. Joining by a token's rank is joining
    by the vocabulary's pairs if each token comes out of its own letters: the parts that cover its place in a longer
    word are then those of its pair. Tokens that don't are never made by the pairs, and are left out.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    ranks = {bytes([b]): b for b in range(256)}
    ids = np.zeros(len(ranks) + len(byte) + len(model["merges"]), "<u4")
    for letter, b in byte.items():
        ids[b] = vocabulary[letter]
        if b not in b" \n":
            ids[len(ranks)] = vocabulary[letter + _END]
            ranks[bytes([b]) + b" "] = len(ranks)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = {p: i for i, p in enumerate(pairs)}
    for pair in pairs:
        token = "".join(pair)
        letters = list(token.removesuffix(_END))
        parts = [*letters[:-1], letters[-1] + _END * token.endswith(_END)]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), len(pairs)))
            if (parts[at], parts[at + 1]) not in order:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        data = bytes(byte[c] for c in letters) + b" " * token.endswith(_END)
        if len(parts) == 1 and data not in ranks:
            ids[len(ranks)] = vocabulary[token]
            ranks[data] = len(ranks)
    return ranks, ids


class Ids:
    """The ids, as little-endian 32-bit numbers, of strings without a blank in them."""

    def __init__(self, path: str, ranks: dict[bytes, int], ids: np.ndarray) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.ids = Tokenizer.from_file(path), ids
        self.words = tiktoken.Encoding("words", pat_str="[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})
        self.recent: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def learn(self, strings: set[str]) -> dict[str, bytes]:
        """A dictionary that has all of the strings; those that were not asked for lately are forgotten."""
        if len(self.recent) > CACHE:
            self.older, self.recent = self.recent, {"": b""}
        new = strings - self.recent.keys()
        known = new & self.older.keys()
        self.recent.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new -= known
        plain = list(filter(_PLAIN.fullmatch, new))
        if plain:
            # a line break ends each string, a blank each of its pre-tokens
            text = _BORDER.sub(r"\1 \2", " \n".join(plain).lower() + " \n")
            found = np.array(self.words.encode_ordinary(text), np.int64)
            ends = np.flatnonzero(found == 10)
            data = self.ids[found].tobytes()
            starts, ends = np.r_[0, 4 * ends[:-1] + 4].tolist(), (4 * ends).tolist()
            self.recent.update(zip(plain, map(data.__getitem__, map(slice, starts, ends)), strict=True))
        self.recent.update((s, np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()) for s in new.difference(plain))
        return self.recent


_LOADED: dict[str, Ids] = {}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", width: int = WIDTH, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end token, cut every `width` tokens.

    White space only separates tokens under this vocabulary, so the ids of a text are those of its parts between
    blanks, and equal parts are encoded once. The id column may have any type.
    """
    import public_tokenizers

    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(public_tokenizers.path(vocabulary)))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = Ids(public_tokenizers.path(vocabulary), *ranks.value)
        ids, tail, step = _LOADED[vocabulary], np.array([end], "<u4").tobytes(), 4 * width
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, AT_ONCE + (sizes[lo - 1] if lo else 0), "right")))
                parts = [(x or "").replace("\n", " ").split(" ") for x in texts.slice(lo, hi - lo).to_pylist()]
                known = ids.learn(set().union(*parts))
                rows = []
                for at, words in enumerate(parts, lo):
                    data = b"".join(map(known.__getitem__, words)) + tail
                    for i in range(0, len(data), step):
                        part = data[i : i + step]
                        rows.append((at, i // step, i // 4, len(part) // 4, zlib.crc32(part)))
                at, *columns = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], names)
                lo = hi
        released()

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in names[1:])])
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def patterns(classes: int, most: int = 4, coarse: int = 8) -> list[tuple[int, ...]]:
    """Descending class tuples that sum to `classes`: all of two and three, and of four those in steps of `coarse`."""
    out = [(a, classes - a) for a in range((classes + 1) // 2, classes)]
    out += [(a, b, classes - a - b) for a in range(1, classes) for b in range(1, a + 1) if 0 < classes - a - b <= b]
    if most >= 4:
        steps = classes // coarse
        out += [(a * coarse, b * coarse, c * coarse, (steps - a - b - c) * coarse) for a in range(1, steps) for b in range(1, a + 1) for c in range(1, b + 1) if 0 < steps - a - b - c <= c]
    return out


def fit(table_: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of patterns (rows of class indexes, -1 for none) to a histogram, by accelerated
    projected gradient steps; columns and their transposes are applied by index, so no dense matrix is kept."""
    used = table_ >= 0
    safe = np.where(used, table_, 0)
    n = len(target)
    forward = lambda x: np.bincount(safe[used], weights=np.repeat(x, used.sum(1)), minlength=n)
    back = lambda r: np.where(used, r[safe], 0.0).sum(1)
    v = np.ones(len(table_))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(1.0, float(v @ back(forward(v))) * 1.02)
    x = y = np.zeros(len(table_))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def pack_plan(histogram: dict[int, int], width: int = WIDTH, grain: int = 8, shares: tuple[float, ...] = (1.0, 0.6, 0.3)) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence's pieces, number of such sequences) that hold the histogram exactly.

    Rounding down leaves pieces over that fill the gaps of the patterns. How many it takes is not known before, so
    each share of the fitted counts is tried; the plan with the fewest sequences stays.
    """
    times = fitted(histogram, width, grain)
    plans = [_plan(histogram, times, share, width, grain) for share in shares]
    return min(plans, key=lambda p: sum(n for _, n in p))


def fitted(histogram: dict[int, int], width: int, grain: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns of length classes with their fitted repeat counts, most frequent first."""
    classes = width // grain
    counts = np.zeros(classes + 1)
    for k, v in histogram.items():
        if k != width:
            counts[-(-int(k) // grain)] += v
    candidates = [p for p in patterns(classes) if all(counts[c] for c in p)] if classes >= 2 else []
    if not candidates:
        return []
    times = fit(np.array([[*p, *[-1] * (4 - len(p))] for p in candidates]), counts)
    return [(candidates[i], float(times[i])) for i in np.argsort(-times, kind="stable")]


def _plan(histogram: dict[int, int], times: list[tuple[tuple[int, ...], float]], share: float, width: int, grain: int) -> list[tuple[tuple[int, ...], int]]:
    """The patterns' sequences at a share of their counts, and the rest by best fit."""
    left = defaultdict(int, {int(k): int(v) for k, v in histogram.items() if v})
    runs: list[tuple[tuple[int, ...], int]] = []
    if width in left:
        runs.append(((width,), left.pop(width)))
    open_: dict[int, list[list]] = defaultdict(list)  # free space -> [lengths, sequences]
    classes = width // grain
    if classes >= 2 and left:
        counts = np.zeros(classes + 1)
        members = defaultdict(list)
        for k in sorted(left):
            c = -(-k // grain)
            counts[c] += left[k]
            members[c].append(k)
        for pattern, repeats in times:
            need = defaultdict(int)
            for c in pattern:
                need[c] += 1
            n = min([int(share * repeats + 1e-6), *(int(counts[c]) // m for c, m in need.items())])
            if n < 1:
                continue
            for c, m in need.items():
                counts[c] -= n * m
            # exact lengths: the longest of one class goes with the shortest of the next
            queues = []
            for j, c in enumerate(pattern):
                queue, want = [], n
                for k in members[c] if j % 2 else reversed(members[c]):
                    if want and (take := min(want, left[k])):
                        queue.append([k, take])
                        left[k] -= take
                        want -= take
                queues.append(queue)
            while queues[0]:
                m = min(q[0][1] for q in queues)
                lengths = tuple(q[0][0] for q in queues)
                open_[width - sum(lengths)].append([lengths, m])
                for q in queues:
                    q[0][1] -= m
                    if not q[0][1]:
                        q.pop(0)
    spaces = sorted(open_)
    for k in sorted((k for k, v in left.items() if v), reverse=True):
        want = left[k]
        while want:
            at = bisect_left(spaces, k)
            if at == len(spaces):  # a new sequence for as many of this length as fit
                each = min(width // k, want)
                m = want // each
                lengths, space = (k,) * each, width - k * each
                want -= m * each
            else:
                space = spaces[at]
                lengths, have = open_[space].pop()
                m = min(have, want)
                if have > m:
                    open_[space].append([lengths, have - m])
                elif not open_[space]:
                    del open_[space], spaces[at]
                lengths, space = (*lengths, k), space - k
                want -= m
            if space not in open_ or not open_[space]:
                spaces.insert(bisect_left(spaces, space), space)
            open_[space].append([lengths, m])
    runs += [(lengths, m) for bucket in open_.values() for lengths, m in bucket]
    return runs


def pack(pieces: DataFrame, order: list[str], length_col: str = "length", width: int = WIDTH, grain: int = 8, salt_rows: int = 256) -> DataFrame:
    """Adds sequence_id and offset to pieces (read twice, so a staged table); order: columns that identify a piece."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most `width` rows
    rows = sum(histogram.values())
    salts = max(1, min(65536, rows // salt_rows))
    slots, sequence = defaultdict(list), 0
    for lengths, n in pack_plan(histogram, width, grain):
        offset = 0
        for k in lengths:
            slots[k].append((n, sequence, offset))
            offset += k
        sequence += n
    keys, first, base, place = [], [], [], []
    for k in sorted(slots):
        rank = 0
        for n, s, o in slots[k]:
            keys.append(k)
            first.append(rank)
            base.append(s)
            place.append(o)
            rank += n
    plan = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (keys, first, base, place)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, base, place = plan.value
        lows = np.searchsorted(keys, np.arange(width + 2))
        for batch in batches:
            k, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (length_col, "_rank"))
            at = np.empty(batch.num_rows, np.int64)
            by = np.argsort(k, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(k[by]) != 0, True]) if len(k) else []
            for lo, hi in itertools.pairwise(edges):
                a, b = lows[k[by[lo]]], lows[k[by[lo]] + 1]
                at[by[lo:hi]] = a + np.searchsorted(first[a:b], rank[by[lo:hi]], "right") - 1
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(base[at] + rank - first[at]), pa.array(place[at])], [*[batch.schema.names[i] for i in kept], "sequence_id", "offset"])

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit("salt")), F.lit(salts)))
    sums = salted.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(length_col, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length_col, "_salt").orderBy(*order)
    ranked = salted.withColumn("_row", F.row_number().over(inside)).join(starts, [length_col, "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    schema = T.StructType([*pieces.schema, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset"))])
    return ranked.mapInArrow(places, schema)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = stage(token_pieces(table(spark, sf_dir, "documents")))
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"])
