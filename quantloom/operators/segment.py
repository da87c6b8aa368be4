"""Word segmentation by a dictionary: the most probable way to cut a text that has no blanks between its words.

The dictionary is a table of counts, from a Spark aggregate. It goes to the tasks as a prefix trie in sorted arrays. Each
place of a run of letters has an arc for each word that begins there, found by walking the trie for all places of a batch
at once; the cheapest path through the arcs is found from the end of the runs to their start, for all runs at once.
A word's cost is -ln of its share of all counts, in whole millionths, so sums are exact and equal on any machine; of two
paths that cost the same, the one with the longer first word is taken. A letter that begins no word is a word of count 1.

Cases: null text has null words; empty text and text without letters have none; an empty dictionary cuts into letters.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SCALE = 1_000_000
RUN = r"[^\W]+"
#: Words of a dictionary that goes to the tasks, at most; characters that are cut at once.
MOST_WORDS, AT_ONCE = 200_000, 1 << 18


def word_counts(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n): the `most` most frequent words of a table of words (word; one row for each occurrence); of equally
    frequent ones those that come first."""
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


class Trie:
    """A prefix trie in arrays: the child of node s by letter x has the key s * letters + x, in ascending order."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.total = sum(counts.values())
        self.unknown = self.cost_of(1)
        words = sorted(counts)
        self.longest = max(map(len, words), default=1)
        self.letters = np.array(sorted({ord(c) for w in words for c in w}), np.int64)
        # nodes are made level by level: all prefixes of one length, in order
        parent, keys, self.cost = np.zeros(len(words), np.int64), [], [-1]
        codes = [np.searchsorted(self.letters, [ord(c) for c in w]) for w in words]
        at = 0
        alive = np.arange(len(words))
        while len(alive):
            key = parent[alive] * len(self.letters) + np.array([codes[i][at] for i in alive])
            fresh, first, node = np.unique(key, return_index=True, return_inverse=True)
            base = len(self.cost)
            keys.append(fresh)
            self.cost += [-1] * len(fresh)
            parent[alive] = base + node
            at += 1
            for i in alive[[len(words[i]) == at for i in alive]].tolist():
                self.cost[parent[i]] = self.cost_of(counts[words[i]])
            alive = alive[[len(words[i]) > at for i in alive]]
        # nodes of a level follow each other in the order of their keys, and keys grow with the level
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.cost = np.array(self.cost, np.int64)

    def cost_of(self, n: int) -> int:
        return round(math.log(max(1, self.total) / n) * SCALE)

    def arcs(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, cost) of all words in a row of code points; ends: the end of each place's run. Each place has
        an arc of length 1."""
        letter = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        known = self.letters[letter] == codes if len(self.letters) else np.zeros(len(codes), bool)
        place, node, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for k in range(self.longest):
            inside = place + k < ends[place]
            place, node = place[inside], node[inside]
            inside = known[place + k]
            if k == 0:
                out.append((place[~inside], np.full((~inside).sum(), 1), np.full((~inside).sum(), self.unknown)))
            place, node = place[inside], node[inside]
            key = node * len(self.letters) + letter[place + k]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            cost = np.where(found, self.cost[np.where(found, at + 1, 0)], -1)
            if k == 0:
                cost = np.where(cost < 0, self.unknown, cost)
                out.append((place, np.full(len(place), 1), cost))
            else:
                word = cost >= 0
                out.append((place[word], np.full(word.sum(), k + 1), cost[word]))
            place, node = place[found], at[found] + 1
            if not len(place):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def best_lengths(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place the length of the first word on the cheapest path from it to the end of its run."""
        place, length, cost = self.arcs(codes, ends)
        left = ends[place] - place
        by = np.lexsort((length, place, left))
        place, length, cost, left = place[by], length[by], cost[by], left[by]
        best = np.zeros(len(codes) + 1, np.int64)  # of the rest of the run; none is left at its end
        # cost first, then the longer word, in one number
        taken = np.zeros(len(codes), np.int64)
        groups = np.flatnonzero(np.r_[True, (place[1:] != place[:-1])]) if len(place) else np.zeros(0, np.int64)
        steps = np.searchsorted(left, np.arange(1, (left[-1] if len(left) else 0) + 2))
        at = np.searchsorted(groups, steps)
        span = self.longest + 1
        for a, b, g, h in zip(steps[:-1].tolist(), steps[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if a == b:
                continue
            ahead = place[a:b] + length[a:b]
            rest = np.where(ahead < ends[place[a:b]], best[np.minimum(ahead, len(codes))], 0)
            least = np.minimum.reduceat((cost[a:b] + rest) * span + (span - length[a:b]), groups[g:h] - a)
            mine = place[groups[g:h]]
            best[mine], taken[mine] = least // span, span - least % span
        return taken

    def cut(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        sizes = np.array([len(r) for r in runs], np.int64)
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), "<u4").astype(np.int64)
        stop = np.cumsum(sizes)
        taken = self.best_lengths(codes, np.repeat(stop, sizes)).tolist()
        out = []
        for run, begin in zip(runs, (stop - sizes).tolist(), strict=True):
            words, i = [], 0
            while i < len(run):
                k = taken[begin + i]
                words.append(run[i : i + k])
                i += k
            out.append(words)
        return out


def segmenter(spark: SparkSession, counts: DataFrame, most: int = MOST_WORDS, run: str = RUN, join: str | None = None):
    """A function of a text column that gives its words, for all that takes tokens (tfidf_index, retrieve).

    counts: (word, n), of which at most `most` words make the dictionary. run: what is cut, a regular expression; what is
    between runs is left out. join: words of one letter that match it are joined with those next to them.
    """
    rows = counts.where("word <> '' and n > 0").orderBy(F.desc("n"), "word").limit(most).collect()  # a bounded dictionary
    sent = spark.sparkContext.broadcast(Trie({r["word"]: r["n"] for r in rows}))

    def joined(words: list[str]) -> list[str]:
        out, single = [], False
        for w in words:
            now = len(w) == 1 and re.fullmatch(join, w) is not None
            if now and single:
                out[-1] += w
            else:
                out.append(w)
            single = now
        return out

    def words(texts: pd.Series) -> pd.Series:
        trie, find = sent.value, re.compile(run).findall
        parts = [None if t is None else find(t) for t in texts]
        known: dict[str, list[str]] = {}  # each run of the batch is cut once, some at a time
        fresh = list(dict.fromkeys(r for p in parts if p for r in p))
        lo = 0
        while lo < len(fresh):
            hi, size = lo, 0
            while hi < len(fresh) and (hi == lo or size < AT_ONCE):
                size += len(fresh[hi])
                hi += 1
            found = trie.cut(fresh[lo:hi])
            known.update(zip(fresh[lo:hi], found if join is None else map(joined, found), strict=True))
            lo = hi
        return pd.Series([None if p is None else [w for r in p for w in known[r]] for p in parts], dtype=object)

    cut = F.pandas_udf(words, "array<string>")
    return lambda text: cut(text)


def segment(df: DataFrame, words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words) of each row, by a segmenter."""
    return df.select(id_col, words(F.col(text_col)).alias("words"))

