"""Secret scans: assignments, access keys and hex runs by pattern, other random strings by token efficiency.

A random string compresses badly under a byte-pair vocabulary that was fitted to prose and code: it takes a token
for every one to two characters. A candidate run whose characters per token fall below a threshold is a finding,
unless it is a known digest (hex of a digest's length), a UUID or a number. Runs of letters are judged by the humps of
their camel case in lower case, so that names stay and random letters don't. Where a whole run is none, its parts
between / and =, its neighbouring parts between / _ - = that are no words, and those parts by themselves are judged, so
a path or a name before a key doesn't hide it.

Cases: null and empty text have no spans; repeated rows are judged alike, each by itself; an empty table gives an
empty result; other columns of the input are ignored. The job is one pass without a shuffle.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .spark_tools import table, text_batches
from .text_kernels import released

KINDS = ("assign", "access", "hex", "random")
# The base patterns. Letters of ASSIGN match in either case, of ASCII only.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # maximal runs of 32 characters and more
# What a low token efficiency does not count for.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
IDENTIFIER = rf"{UUID}|[0-9_.=/+-]+|(.)\1*"
LETTERS = r"[A-Za-z]+([-_/=]+[A-Za-z]+)*[-_/=]*"
HUMP = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"


SCHEMA = "spans array<struct<kind:string,start:int,end:int,text:string>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])


def _encoding(path: str):
    """The tiktoken vocabulary at path, loaded once in each Python worker."""
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


_LOADED: dict = {}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", min_chars: int = 20, max_ratio: float = 2.0) -> DataFrame:
    """One row for each row of docs: its id and spans (kind, start, end in code points, text), by start, then kind.

    min_chars: least length of a candidate for the token test; max_ratio: most characters per token of a finding.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, access, hexes = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        candidate, plain = re.compile(rf"[A-Za-z0-9+/_=-]{{{min_chars},}}"), re.compile(IDENTIFIER)
        encoding = _encoding(vocabulary)

        letters, hump, part = re.compile(LETTERS), re.compile(HUMP), re.compile("[^-/_=]+")

        def size(s: str) -> int:
            return len(encoding.encode_ordinary(s))

        def known(s: str) -> bool:
            return bool(plain.fullmatch(s) or len(s) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s))

        def random(s: str) -> bool:
            if known(s):
                return False
            if not letters.fullmatch(s):
                return len(s) < max_ratio * size(s)
            # letters in several parts are judged by part, unless their case changes as in no name
            if part.fullmatch(s) or len(re.findall("[a-z][A-Z]", s)) >= 2:
                humps = hump.findall(s)
                return sum(map(len, humps)) < max_ratio * sum(size(h.lower()) for h in humps)
            return False

        def word(s: str) -> bool:
            return len(s) > 2 and known(s) or s.isdigit() or len(s) > 2 and s.isalpha() and not random(s)

        def judged(run: str, at: int) -> list[tuple[int, int]]:
            """The places of what is random: the run, else what is in its parts."""
            if random(run):
                return [(at, at + len(run))]
            found: list[tuple[int, int]] = []  # disjoint, by start
            parts = [m.span() for m in part.finditer(run)]
            groups: list[tuple[int, int]] = []
            joins = False
            uuids = {i for m in re.finditer(rf"(?<![^-/_=]){UUID}(?![^-/_=])", run) for i in range(*m.span())}
            for a, b in parts if len(parts) > 1 else []:
                if a in uuids or word(run[a:b]):
                    joins = False
                    continue
                if joins:
                    groups[-1] = groups[-1][0], b
                else:
                    groups.append((a, b))
                joins = True
            for a, b in [*(m.span() for m in re.finditer("[^/=]+", run)), *groups, *parts]:
                i = bisect.bisect_left(found, (b, 0))
                if min_chars <= b - a < len(run) and not (i and found[i - 1][1] > a) and random(run[a:b]):
                    found.insert(i, (a, b))
            return [(at + a, at + b) for a, b in found]

        def spans(text: str) -> list[tuple]:
            found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= 8]
            found += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= 16]
            found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
            found.sort()
            # a place is inside a base span if one that starts at or before it reaches its end
            starts, reach = [a for a, _, _ in found], list(itertools.accumulate((b for _, _, b in found), max))

            def based(a: int, b: int) -> bool:
                i = bisect.bisect_right(starts, a)
                return i > 0 and reach[i - 1] >= b

            more = [(a, 3, b) for m in candidate.finditer(text) if not based(*m.span()) for a, b in judged(m[0], m.start()) if not based(a, b)]
            return [(KINDS[k], a, b, text[a:b]) for a, k, b in sorted(found + more)]

        for batch in batches:
            # a part of the batch at a time, so that its texts are few
            for lo in range(0, batch.num_rows, 256):
                rows = [spans(x) if x else [] for x in batch.column(1).slice(lo, 256).to_pylist()]
                flat = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [[]] * 4
                inner = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, SPAN, strict=True)], fields=list(SPAN))
                offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.ListArray.from_arrays(offsets, inner)], ["id", "spans"])
        released()

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(SCHEMA)])
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every finding in the text replaced by [SECRET]; overlapping findings are replaced together.

    All columns and rows stay, in one pass without a shuffle. Null texts stay null.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find_secrets(packed, "row", "text", **options)
    text = F.col("row").getField(text_col)
    # pieces of text between the findings, walking them by start
    walk = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]")).alias("done"), s["end"].alias("at"))
        ),
    )
    clean = F.when(F.size("spans") == 0, text).otherwise(F.concat(walk["done"], F.substring(text, walk["at"] + 1, F.length(text))))
    return found.select(*[F.col("row").getField(c).alias(c) if c != text_col else clean.alias(c) for c in docs.columns])


def digest(kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(digest(KINDS[:3]), 256).alias("base_sha256"), digest().alias("spans"), count("random"))
