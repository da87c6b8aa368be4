"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import spelling
from quantloom.llm.spark_tools import stage

DOCS = "doc_id long, text string, id string, word string, n string, other string, length string, root string"
WORDS = ["Schreibung", "spelling", "spéllings", "variante", "BANANAS", "aaaaaaaa", "ÿÿÿÿÿÿÿ", "ÀÖØ×÷ñé"]


def near(a, b):
    """Differ by exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    others = {a: sorted((b for b in counts if near(a, b)), key=lambda b: (-counts[b], b)) for a in counts}
    form = {a: b[0] if b and counts[b[0]] >= ratio * counts[a] else None for a, b in others.items()}

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {(a, form[a], root(a), counts[a], len(others[a]), counts.get(form[a])) for a in counts}


def variants(rng, word):
    i, x = rng.randrange(len(word)), rng.choice("abcñÿ")
    return rng.choice([word[:i] + x + word[i + 1 :], word[:i] + x + word[i:], word[:i] + word[i + 1 :]])


def vocabulary(rng, size):
    found = set(WORDS)
    while len(found) < size:
        found.add(variants(rng, rng.choice(sorted(found))))
    return {w: rng.choice([2, 3, 20, 200, 200, 3000]) for w in found if w}


@pytest.mark.parametrize("filter_bytes", [64 << 20, 64])
def test_variants_equal_all_pairs(spark, filter_bytes):
    counts = vocabulary(random.Random(4), 400)
    table = stage(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert len(spelling._passes(dict.fromkeys({len(w) for w in counts}, 1), filter_bytes)) == (1 if filter_bytes > 64 else len({len(w) for w in counts}))
    got = {tuple(r) for r in spelling.spelling_variants(table, filter_bytes=filter_bytes).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(counts)
    assert sum(r[1] is not None for r in got) > 50 and any(r[1] not in (None, r[2]) for r in got)


def test_filters_have_all_words_and_few_others(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(spelling, "PART_BLOCKS", 16)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(20_000)]
    codes = next(spelling.by_length(words))[2]
    h, blocks = spelling.word_hash(codes), -(-len(words) * spelling.BITS // spelling.BLOCK)
    on = np.zeros(blocks * spelling.BLOCK, bool)
    for place in spelling._places(h):
        on[spelling._block(h, blocks) * spelling.BLOCK + place] = True
    filters = spelling.Filters({9: (blocks, 0, blocks, np.packbits(on, bitorder="little").view("<u8"))})
    assert filters.has(9, h).all() and not filters.has(8, h).any()
    assert filters.has(9, rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.005
    # hashes of edits are the hashes of the edited words
    some, alphabet = words[:50], np.arange(97, 123)
    every = spelling.Filters({n: (1, 0, 1, np.full(8, ~np.uint64(0))) for n in (8, 9)})
    made = {(some[k], e) for ks, es in spelling.edits(some, alphabet, every) for k, e in zip(ks, es, strict=True)}
    want = {(w, w[:i] + w[i + 1 :]) for w in some for i in range(9)} | {(w, w[:i] + chr(x) + w[i + 1 :]) for w in some for i in range(9) for x in range(ord(w[i]) + 1, 123)}
    assert made == want
    exact = spelling.Filters({9: (64, 0, 64, _bits({w[:3] + "~" + w[4:] for w in some}, 64))})
    hit = {(some[k], e) for ks, es in spelling.edits(some, np.array([126]), exact) for k, e in zip(ks, es, strict=True)}
    assert {(w, w[:3] + "~" + w[4:]) for w in some} <= hit


def _bits(words, blocks):
    h = spelling.word_hash(next(spelling.by_length(sorted(words)))[2])
    on = np.zeros(blocks * spelling.BLOCK, bool)
    for place in spelling._places(h):
        on[spelling._block(h, blocks) * spelling.BLOCK + place] = True
    return np.packbits(on, bitorder="little").view("<u8")


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    base = [w for w in vocabulary(rng, 120) if re.fullmatch(spelling.WORD, w)]
    rows = [(i, " ".join(rng.choices(base, [1 / (k + 1) for k in range(len(base))], k=120)) + rng.choice([".", "!", " 12ab"])) for i in range(80)]
    rows += [(None, "nobody nobodies nobodies"), (900, None), (901, ""), (902, "UPPERCASE uppercase UPPERCASÉ " * 20), (902, "UPPERCASE uppercase UPPERCASÉ " * 20), (903, "k" * 70_000 + " " + "k" * 70_000)]
    spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in rows:
        for run in re.findall(spelling.WORD, t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = [tuple(r) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None, *"abcdef")], DOCS).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert spelling.op12_spelling_variants(spark, str(tmp_path)).count() == 0
