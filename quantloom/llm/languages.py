"""Language ID by Bayesian evidence fusion: text, declared language, address suffix and smoothed host priors.

Text: naive Bayes over hashed byte 4-grams, trained on a bounded sample of rows that declare a language; the mean
log-likelihood counts for at most `evidence` grams, since neighbouring grams are not independent. One more hypothesis is
an unknown language, all of whose grams are equally likely: it is better than a trained language for random letters,
code and untrained languages, whose grams that language hardly has. Languages are codes of two letters; all that are
declared are trained, each on an equal share of the sample. Declared language (a column, or the lang attribute of the markup) and address suffix (a path's first folder, a host's last label) are
observations that are right with a given reliability. Host priors come from grouped aggregation: each row adds its
posterior from the other evidence to its host and to its host's domain; a row's prior is its host's counts without
its own, smoothed by the domain's, smoothed by the whole table's.

Cases: a null or empty text, and one without letters, has flat text evidence and is rejected, as is a row whose best
hypothesis is the unknown language (its language is null), or whose best language is less probable than `least` or not among the accepted ones; null declared values, URLs and hosts are no
evidence (rows without a host share the table's prior); identical rows get identical results; an empty table gives
an empty result, and one without any declared language rejects all; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .spark_tools import join_checked, stage, table, text_batches
from .text_kernels import LOWER, lists, released, slices
from .url_filters import host_of, path_of

#: Bound of the training sample; each language has one row at least, and two letters allow no more than 676.
FIT_ROWS = 4_000
GRAMS = 1 << 15
#: Share of all languages' grams in each language's, so that unseen grams weigh alike whatever its training mass.
BACKGROUND = 0.02
LANG_ATTRIBUTE = r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b"""
# Three-letter codes (both sets) of languages with a code of two letters; other ones are no evidence.
THREE_LETTERS = """ara:ar ben:bn bul:bg cat:ca ces:cs cze:cs cym:cy wel:cy dan:da deu:de ger:de ell:el gre:el eng:en est:et eus:eu baq:eu fas:fa per:fa
fin:fi fra:fr fre:fr gle:ga glg:gl heb:he hin:hi hrv:hr hun:hu hye:hy arm:hy ind:id isl:is ice:is ita:it jpn:ja kat:ka geo:ka kor:ko lat:la lav:lv lit:lt
mkd:mk mac:mk msa:ms may:ms nld:nl dut:nl nno:nn nob:nb nor:no pol:pl por:pt ron:ro rum:ro rus:ru slk:sk slo:sk slv:sl spa:es sqi:sq alb:sq srp:sr swa:sw
swe:sv tam:ta tgl:tl tha:th tur:tr ukr:uk urd:ur vie:vi zho:zh chi:zh""".split()


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 4-grams of lower-cased bytes, the text index of each, and the number of letters of each text."""
    low = LOWER[raw].astype(np.uint32)
    n = max(0, len(low) - 3)
    code = low[:n] | (low[1 : n + 1] << np.uint32(8)) | (low[2 : n + 2] << np.uint32(16)) | (low[3 : n + 3] << np.uint32(24))
    code = (code * np.uint32(2654435761)) >> np.uint32(17)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = text[:n] == text[3 : n + 3]
    letters = np.concatenate([[0], np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128))])
    return code[whole], text[:n][whole], letters[off[1:]] - letters[off[:-1]]


def _train(rows: DataFrame, fit_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of the grams, from at most fit_rows different texts of rows (declared, text); the
    last row of the probabilities is the unknown language's."""
    labelled = rows.where("declared is not null and text is not null and text <> ''")
    keyed = labelled.select("declared", "text", F.xxhash64("text").alias("h"))
    # copies count once; each language has an equal share of the rows, chosen by hash, and only the chosen texts move
    texts = stage(keyed.groupBy("declared", "h").agg(F.lit(1).alias("one")).drop("one"))
    top = [r["declared"] for r in texts.select("declared").distinct().collect()]  # at most 676 rows
    at = F.row_number().over(Window.partitionBy("declared").orderBy("h"))
    chosen = stage(texts.withColumn("at", at).where(F.col("at") <= max(1, fit_rows // max(1, len(top)))).drop("at"))
    sample = stage(keyed.join(F.broadcast(chosen), ["declared", "h"], "left_semi").dropDuplicates(["declared", "h"]).select("declared", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                code, text, _ = _grams(raw, off)
                of = batch.column(0).slice(lo, hi - lo).dictionary_encode()
                lang = of.indices.to_numpy(zero_copy_only=False)
                key, n = np.unique(lang[text].astype(np.int64) * GRAMS + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(key // GRAMS)), pa.array(key % GRAMS), pa.array(n)], ["lang", "gram", "n"])

    # at most 676 x GRAMS rows
    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(top)
    table_ = np.zeros((len(names), GRAMS))
    for i, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table_[i, own["gram"].to_numpy(int)] = own["n"].to_numpy(float)
    table_ /= np.maximum(1, table_.sum(1, keepdims=True))
    pooled = 0.5 * table_.mean(0) + 0.5 / GRAMS if names else np.zeros(GRAMS)
    known = (1 - BACKGROUND) * table_ + BACKGROUND * pooled
    return names, np.log(np.r_[known, np.full((1, GRAMS), 1 / GRAMS)]).astype(np.float32)


def language_code(declared: Column) -> Column:
    """The two-letter code of a declared language, which may have a region behind - or _; null if it has none."""
    code = F.lower(F.regexp_extract(F.trim(declared), "^([A-Za-z]{2,3})(?:[-_.@].*)?$", 1))
    known = F.create_map(*[F.lit(x) for pair in THREE_LETTERS for x in pair.split(":")])
    return F.when(F.length(code) == 2, code).when(F.length(code) == 3, F.try_element_at(known, code))


def _domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def identify(docs: DataFrame, text: str = "text", declared: Column | None = None, url: Column | None = None, host: Column | None = None, accepted: list[str] | None = None, least: float = 0.5, reliability: float = 0.95, evidence: int = 60, smoothing: float = 20.0, fit_rows: int = FIT_ROWS, keep_text: bool = True) -> DataFrame:
    """docs (a stored table; without keep_text its other columns) with text_language, language, confidence and accepted.

    declared, url, host: the other evidence; the host defaults to that of the URL. accepted: languages that are not
    rejected, by default all that were trained. smoothing: rows' worth of the coarser prior in the finer one.
    """
    spark = docs.sparkSession
    null = F.lit(None).cast("string")
    url, declared = null if url is None else url, null if declared is None else declared
    host = F.when(host_of(url) != "", host_of(url)) if host is None else host
    rows = text_batches(docs).select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"), language_code(declared).alias("declared"), url.alias("url"), host.alias("host"), F.col(text).alias("text"))
    names, table_ = _train(rows.select("declared", "text"), fit_rows)
    size = len(names) + 1  # the last one is the unknown language
    model = spark.sparkContext.broadcast(table_)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept = [i for i in range(batch.num_columns) if keep_text or i != at]
            for lo, hi, raw, off in slices(batch.column(at)):
                code, of, letters = _grams(raw, off)
                n = np.bincount(of, minlength=hi - lo)
                ends = np.r_[0, np.cumsum(n)]
                out = np.zeros((hi - lo, size))
                for i in range(len(t)):
                    sums = np.r_[0.0, np.cumsum(t[i][code], dtype=np.float64)]
                    out[:, i] = sums[ends[1:]] - sums[ends[:-1]]
                out *= (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]
                out -= out.max(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in kept], lists(out.ravel(), np.full(hi - lo, size), pa.float64()), pa.array(letters)], [*[batch.schema.field(i).name for i in kept], "likelihood", "letters"])
        released()

    # the address's language: the path's first folder, else the host's last label
    folder, label = F.lower(F.regexp_extract(path_of(F.col("url")), r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)), F.substring_index(host_of(F.col("url")), ".", -1)
    known = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    index = lambda c: F.when(F.array_contains(known, c), F.array_position(known, c).cast("int"))
    rows = rows.select("_row", "text", "host", index(F.col("declared")).alias("said"), F.coalesce(index(folder), index(label)).alias("suffix"))
    schema = T.StructType([*(f for f in rows.schema if keep_text or f.name != "text"), T.StructField("likelihood", T.ArrayType(T.DoubleType())), T.StructField("letters", T.LongType())])
    scored = rows.mapInArrow(likelihood, schema)

    right, wrong = float(np.log(reliability)), float(np.log((1 - reliability) / max(1, size - 1) + 1e-12))
    places = F.sequence(F.lit(1), F.lit(size))
    said = lambda c: F.when(F.col(c).isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(F.transform(places, lambda i: F.when(i == F.col(c), right).otherwise(wrong)))

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def normal(a: Column) -> Column:
        """Probabilities from logarithms."""
        e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))

    known_rows = scored.withColumn("log", add(add(F.col("likelihood"), said("said")), said("suffix"))).withColumn("p", normal(F.col("log")))
    known_rows = stage(known_rows.withColumn("domain", _domain(F.col("host"))))
    # grouped aggregation: the posteriors' sums by host, domain and in all
    sums = lambda by: known_rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(size)]).alias(f"{by}_sum"))
    total = known_rows.agg(F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(size)])).first()[0]
    whole = [(x + 1.0) / (sum(total) + size) for x in total]
    joined = join_checked(join_checked(known_rows, stage(sums("domain")), ["domain"]), stage(sums("host")), ["host"])

    def smooth(counts: Column, prior: Column) -> Column:
        """Counts without the row's own posterior, and `smoothing` rows of the prior, as shares."""
        rest = F.zip_with(counts, F.col("p"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
        n = F.aggregate(rest, F.lit(0.0), lambda s, y: s + y)
        shares = F.zip_with(rest, prior, lambda c, q: (c + smoothing * q) / (n + smoothing))
        return F.when(counts.isNull(), prior).otherwise(shares)

    base = F.array(*[F.lit(x) for x in whole])
    joined = joined.withColumn("q1", smooth(F.col("domain_sum"), base)).withColumn("q2", smooth(F.col("host_sum"), F.col("q1")))
    joined = joined.withColumn("final", normal(add(F.col("log"), F.transform("q2", lambda x: F.log(x)))))
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    name = lambda c: F.get(known, c - 1)
    confidence = F.array_max("final")
    language = name(best(F.col("final")))
    allowed = F.lit(True) if accepted is None else language.isin(accepted)
    ok = (F.col("letters") > 0) & (confidence >= least) & allowed & language.isNotNull()
    return joined.select(*[F.col("text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if keep_text or c != text], F.when(F.col("letters") > 0, name(best(F.col("likelihood")))).alias("text_language"), language.alias("language"), confidence.alias("confidence"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents: the column lang is the declared language, the source stands for the host and, if it is one, the URL.

    The markup's lang attribute is used where the column is null.
    """
    attribute = F.nullif(F.regexp_extract("text", LANG_ATTRIBUTE, 1), F.lit(""))
    source = F.col("source")
    url = F.when(source.contains("://"), source).when(source.contains("."), F.concat(F.lit("http://"), source))
    return identify(docs, declared=F.coalesce("lang", attribute), url=url, host=source, **options)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Language ID of all documents."""
    found = identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return found.select("doc_id", "lang", "text_language", "language", "confidence", F.col("accepted").alias("kept"))


def pages_language(spark, sf_dir: str) -> DataFrame:
    """Language ID of all web pages, by text, lang attribute, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    attribute = F.nullif(F.regexp_extract("html", LANG_ATTRIBUTE, 1), F.lit(""))
    rows = stage(pages.select("page_id", "url", body.alias("text"), attribute.alias("declared")))
    found = identify(rows, declared=F.col("declared"), url=F.col("url"), keep_text=False)
    return found.select("page_id", "declared", "text_language", "language", "confidence", F.col("accepted").alias("kept"))
