"""Spelling variants: words that differ by one letter, found by probing generated edits against Bloom filters.

Words are counted per task before they are shuffled. The vocabulary's Bloom filters are blocked (a word's bits lie in one
block of 512) and sharded by length: an edit of a word has a length, so it asks one shard only. They are built in parts by
grouped tasks and broadcast, in as many passes as the bound on a broadcast asks for. In each pass every word generates its
edits as hashes, by arithmetic on the word's polynomial hash, without strings: all deletions of one letter, and all
replacements of one by a greater one; insertions and the other replacements are the same pairs seen from the other word.
Only edits whose bits are all set become strings. They are shuffled to an exact join with the vocabulary, which leaves
the true neighbours and nothing else. What a filter says never decides a pair, only what is sent to the join.

Cases: null and empty texts have no words; repeated rows count again; rows without an id count too; an empty table gives
an empty result; other columns of the input are ignored. Words may have any length and any letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .spark_tools import stage, table, text_batches
from .text_kernels import LOWER, mix, released

# What a word is, and which ones are compared.
WORD = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words that a task counts before it hands them on; bits for each word; bits of a block and how many a word sets.
HELD, BITS, BLOCK, PROBES = 200_000, 16, 512, 6
#: Blocks of a part of a filter, which is built in one group; bytes of filters that are broadcast at once; edits at once.
PART_BLOCKS, FILTER_BYTES, AT_ONCE = 1 << 8, 64 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_LOWER = LOWER.tobytes()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, respell: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n) of the words with A-Z in lower case that have least_length letters and stand least_count times.

    respell(id, word) may change a word of a document before it is counted; it is asked once for each word of a text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(pattern).findall, {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for word, n in Counter(find(text.encode().translate(_LOWER).decode())).items() if text else ():
                    if respell is not None:
                        word = respell(doc_id, word)
                    if len(word) >= least_length:
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield counted()
                    total = {}
        yield counted()
        released()

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letters(codes: np.ndarray) -> np.ndarray:
    """A number for each code point, by which hashes weigh it."""
    return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of its words, their code points as a matrix) of each length."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), length)
        yield length, at, codes


def word_hash(codes: np.ndarray) -> np.ndarray:
    """The polynomial hashes of words of one length, from their code points."""
    return (_letters(codes) * _powers(codes.shape[1])).sum(1, dtype=np.uint64)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((mix(h) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _places(h: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of a hash in its block, one after the other."""
    more = mix(h + np.uint64(0xD6E8FEB86659FD93))
    for k in range(PROBES):
        yield ((more >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)).astype(np.int64)


class Filters:
    """The blocks lo to hi of the filters of some lengths: {length: (blocks of the whole filter, lo, hi, bits)}."""

    def __init__(self, shards: dict[int, tuple[int, int, int, np.ndarray]]) -> None:
        self.shards = shards

    def has(self, length: int, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be words of the length; those of blocks outside are not."""
        if length not in self.shards:
            return np.zeros(len(h), bool)
        blocks, lo, hi, bits = self.shards[length]
        at = _block(h, blocks)
        left = np.flatnonzero((at >= lo) & (at < hi))
        # each bit is asked for those only that had the ones before
        for place in _places(h):
            p = place[left]
            word = bits[(at[left] - lo) * (BLOCK // 64) + (p >> 6)]
            left = left[(word >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out


def edits(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of words, edits) of the edits that the filters may have: deletions of a letter, replacements by a greater
    one. Each edit of a word is generated once; all work is in pieces of about AT_ONCE edits."""
    greater = _letters(alphabet)
    for length, at, codes in by_length(words):
        power = _powers(length)
        across = max(1, AT_ONCE // length)
        for w0 in range(0, len(at), across):
            some = codes[w0 : w0 + across]
            letters = _letters(some)
            terms = letters * power
            upto = np.cumsum(terms, axis=1, dtype=np.uint64)
            whole = upto[:, -1:]
            # without the letter at i: what is before it, and what is behind it, one place lower
            if length > 1:
                gone = upto - terms + (whole - upto) * _INVERSE
                fresh = np.ones(some.shape, bool)  # of equal letters in a row only the first
                fresh[:, 1:] = some[:, 1:] != some[:, :-1]
                row, i = np.nonzero(fresh)
                hit = filters.has(length - 1, gone[row, i])
                yield _strings(words, at[w0 + row[hit]], i[hit], None)
            if length not in filters.shards:
                continue
            step = max(1, AT_ONCE // max(1, len(alphabet)))
            flat_letters, flat_codes = letters.ravel(), some.ravel()
            for p0 in range(0, flat_codes.size, step):
                place = np.arange(p0, min(p0 + step, flat_codes.size))
                which, letter = np.nonzero(alphabet[None, :] > flat_codes[place][:, None])
                place = place[which]
                row, i = np.divmod(place, length)
                hit = filters.has(length, whole[row, 0] + (greater[letter] - flat_letters[place]) * power[i])
                yield _strings(words, at[w0 + row[hit]], i[hit], alphabet[letter[hit]])


def _strings(words: list[str], number: np.ndarray, at: np.ndarray, letter: np.ndarray | None) -> tuple[list[int], list[str]]:
    put = [""] * len(at) if letter is None else map(chr, letter.tolist())
    numbers = number.tolist()
    return numbers, [words[k][:i] + x + words[k][i + 1 :] for k, i, x in zip(numbers, at.tolist(), put, strict=True)]


def _passes(blocks: dict[int, int], limit: int) -> list[list[tuple[int, int, int]]]:
    """Ranges (length, first part, part behind the last) of filters, so that the parts of a pass have `limit` bytes at most
    (or are one part)."""
    out: list[list[tuple[int, int, int]]] = [[]]
    room = limit
    for length, n in sorted(blocks.items()):
        for part in range(-(-n // PART_BLOCKS)):
            size = min(PART_BLOCKS, n - part * PART_BLOCKS) * BLOCK // 8
            if size > room and out[-1]:
                out.append([])
                room = limit
            room -= size
            if out[-1] and out[-1][-1][0] == length:
                out[-1][-1] = (length, out[-1][-1][1], part + 1)
            else:
                out[-1].append((length, part, part + 1))
    return [p for p in out if p]


def _filter_parts(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, part, bits): the filters of the words, each part built in a group of its own."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            for length, _, codes in by_length(found) if found else ():
                h = word_hash(codes)
                part = _block(h, blocks[length]) // PART_BLOCKS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length, np.int32)), pa.array(part.astype(np.int32)), pa.array(h.view(np.int64))], ["length", "part", "h"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        length, part = (k.as_py() for k in key)
        h = rows.column("h").to_numpy().view(np.uint64)
        size = min(PART_BLOCKS, blocks[length] - part * PART_BLOCKS)
        at = (_block(h, blocks[length]) - part * PART_BLOCKS) * BLOCK
        on = np.zeros(size * BLOCK, bool)
        for place in _places(h):
            on[at + place] = True
        return pa.table({"length": pa.array([length], pa.int32()), "part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    return words.select("word").mapInArrow(hashed, "length int, part int, h long").groupBy("length", "part").applyInArrow(build, "length int, part int, bits binary")


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, other, n): each two words of the vocabulary (word, n; distinct, staged) that differ by one inserted, deleted
    or replaced letter, in both directions; n is the other's."""
    spark = vocabulary.sparkSession
    sizes = dict(vocabulary.groupBy(F.length("word").alias("length")).count().collect())  # a row for each length
    blocks = {length: -(-n * BITS // BLOCK) for length, n in sizes.items()}
    # letters of a script, so they are few
    letters = vocabulary.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))).alias("letter")).distinct().collect()
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters), np.int64)
    parts = stage(_filter_parts(vocabulary, blocks)) if blocks else None
    tasks = max(spark.sparkContext.defaultParallelism, sum(sizes.values()) // 20_000)
    dealt = vocabulary.select("word", "n").repartition(tasks)
    found: list[DataFrame] = []
    for ranges in _passes(blocks, filter_bytes):
        chosen = spark.createDataFrame(ranges, "length int, first int, behind int")
        here = parts.join(F.broadcast(chosen), "length").where("part >= first and part < behind")
        bits = {(r["length"], r["part"]): r["bits"] for r in here.select("length", "part", "bits").collect()}  # filter_bytes at most
        shards = {}
        for length, first, behind in ranges:
            data = np.frombuffer(b"".join(bits[length, p] for p in range(first, behind)), "<u8")
            shards[length] = (blocks[length], first * PART_BLOCKS, min(behind * PART_BLOCKS, blocks[length]), data)
        sent = spark.sparkContext.broadcast(Filters(shards))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1)
                for numbers, strings in edits(words, alphabet, sent.value) if words else ():
                    if numbers:
                        which = pa.array(numbers)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), n.take(which), pa.array(strings, pa.string())], ["word", "word_n", "other"])

        found.append(stage(dealt.mapInArrow(probe, "word string, word_n long, other string")))
        sent.unpersist()
    if not found:
        return vocabulary.select("word", F.col("word").alias("other"), "n").limit(0)
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    true = positives.join(vocabulary.select(F.col("word").alias("other"), "n"), "other")
    sides = F.array(F.struct("word", "other", "n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("word_n").alias("n")))
    return true.select(F.inline(sides))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of forms (word, form), whose forms are followed to the last. Each round doubles the
    steps taken, and counts at least RATIO times as large end the chains, so rounds are few."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary (word, n; staged).

    form: the most frequent near word (of equal ones the first by code points) if it stands at least `ratio` times as
    often as the word; root: the last of the forms of forms, the word itself if it has none; n_near: number of near words.
    """
    best = near_words(vocabulary, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("other").alias("other"))).alias("best"))
    far = -F.col("best.m") >= ratio * F.col("n")
    table_ = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    table_ = stage(table_)
    ends = roots(table_.where("form is not null"))
    return table_.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(doc_id, word: str) -> str:
    """The word without one of its letters, for one in 31 words of a document."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(stage(count_words(table(spark, sf_dir, "documents"), respell=misspelt)))
