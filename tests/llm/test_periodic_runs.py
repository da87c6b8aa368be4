"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quantloom.llm import periodic_runs

DOCS = "doc_id long, text string, id string, runs string, collapsed string, n_words string, best string, start string"
EDGE = [(None, "no id here " * 9), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "é é é é é é é é é   é"), (5, "é é é é é é é é é   é"), (6, "x" * 70_000), (7, "word " * 30_000), (8, "a b c d"), (10, "a b c d e"), (11, "a a a a a"), (12, "a A a A a A a A"), (13, "a\x1cb " * 8)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute(words, least=6, exponent=4):
    """All runs (start, length, period) by start, then period."""
    x = np.unique(np.array(words or [""], object), return_inverse=True)[1][: len(words)]
    best = {}
    for q in range(1, len(x) // exponent + 1):
        same = np.r_[False, x[:-q] == x[q:], False].astype(int)
        begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, n in zip(begin.tolist(), (end - begin + q).tolist(), strict=True):
            if n >= max(least, exponent * q):
                best.setdefault((s, n), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def random_text(rng):
    out = []
    for _ in range(rng.randrange(1, 8)):
        block = [rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 9))]
        out += block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
    return out


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3), (8, 2)])
def test_arrays_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(60):
        texts = [random_text(rng) if rng.random() < 0.9 else [] for _ in range(rng.randrange(1, 12))]
        texts += [[rng.choice("ab") for _ in range(120)], ["a", "a b"][rng.randrange(2)].split() * 40]
        flat = [w for t in texts for w in t]
        code = {w: i for i, w in enumerate(sorted(set(flat)))}
        number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        begins = np.cumsum([0, *map(len, texts)])
        of, start, length, period = periodic_runs.runs_of(np.array([code[w] for w in flat]), number, least, exponent)
        got = [(int(t), int(s - begins[t]), int(n), int(q)) for t, s, n, q in zip(of, start, length, period, strict=True)]
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t, least, exponent)]


def test_suffix_arrays_equal_sorting():
    rng = random.Random(2)
    x = np.array([rng.randrange(3) for _ in range(300)])
    part = np.repeat([0, 1, 2], 100)
    order, levels = periodic_runs.suffix_order(x, part)
    ends = 100 * (part + 1)
    suffix = lambda i: (part[i], *x[i : ends[i]])
    assert order.tolist() == sorted(range(300), key=suffix)
    pairs = [(i, j) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    want = [next((k for k, (a, b) in enumerate(zip(suffix(i)[1:], suffix(j)[1:], strict=False)) if a != b), min(ends[i] - i, ends[j] - j)) if part[i] == part[j] else 0 for i, j in pairs]
    assert periodic_runs.common_prefix(levels, *map(np.array, zip(*pairs, strict=True))).tolist() == want


def test_operator_and_query_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = EDGE + [(100 + i, " ".join(random_text(rng) if i % 2 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(200))])) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], DOCS).repartition(3)
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect())
    want = sorted((str(i), len(w), r, collapsed(w, r)) for i, t in rows for w in [words_of(t)] for r in [brute(w) if len(w) < 20_000 else [(0, len(w), 1)]])
    assert got == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        w = planted(i, words_of(t))
        runs = brute(w) if len(w) < 20_000 else [(0, len(w), 1)]
        s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(w, runs) if runs else " ".join(w))]
        want.append((i, len(runs), s, n, q, n and 1000 * n // q, *digests))
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(1 for i, t in rows if i and planted(i, words_of(t)) != words_of(t)) > 5


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
