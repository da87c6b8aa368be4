"""Token files: exact round trip, random access, damage, and the query against the tokenizer."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import spark_tools, token_files

DOCS = "doc_id long, text string, id string, hash long, row string, file string, start string"
EDGE = [(None, "no id here " * 9), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Straße ÉTÉ ñandú ÄÖ"), (5, "Straße ÉTÉ ñandú ÄÖ"), (5, "other"), (6, "x" * 70_000), (7, "word " * 90_000), (8, "a<|endoftext|>b 東京 🙂")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c", "d") for i, t in rows], DOCS).repartition(3)


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def path(spark):
    import uuid

    return f"{spark_tools.shared_dir(spark)}/{uuid.uuid4().hex}"


def rows_of(spark, rows, **options):
    table = docs(spark, rows)
    files = token_files.write_token_files(table, path(spark), **options)
    return files, token_files.token_documents(files, table.schema["doc_id"].dataType)


@pytest.mark.parametrize("options", [{}, {"file_tokens": 50, "frame_tokens": 16}])
def test_files_equal_the_tokenizer(spark, options):
    rng = random.Random(3)
    rows = EDGE + [(100 + i, " ".join(rng.choice(["Wort", "word.", "señal", "x1", "(é)"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rng.shuffle(rows)
    files, found = rows_of(spark, rows, **options)
    got = sorted(token_files.read_ids(found).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    want = sorted((str(i), encoded(t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert files.agg(F.sum("documents"), F.sum("tokens")).first() == (len(rows), start)
    if options:
        assert files.count() > 10  # bounded files, and long documents of many frames
        assert found.agg(F.max("frames")).first()[0] > 1000


def test_empty_table_and_text_ids(spark):
    files, found = rows_of(spark, [])
    assert files.count() == 0 and token_files.read_ids(found).count() == 0
    table = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none")], "doc_id string, text string")
    files = token_files.write_token_files(table, path(spark))
    got = token_files.read_ids(token_files.token_documents(files, table.schema["doc_id"].dataType)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "b"]


def test_readers_decompress_only_what_is_asked_for(spark):
    files, found = rows_of(spark, [(i, f"text number {i}") for i in range(500)])
    wanted = found.where("doc_id in (7, 250, 499)")
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_ids(wanted).collect()} == {i: encoded(f"text number {i}") for i in (7, 250, 499)}
    one = found.where("doc_id = 250").first()
    reader = token_files.FileReader(one["file"])
    assert reader.frames_read == 0 and len(reader.ends) == files.where(F.col("file") == one["file"]).first()["documents"] + 1
    assert np.frombuffer(reader.ids(one["frame"], one["frames"]), "<u4").tolist() == encoded("text number 250")
    assert reader.frames_read == 1


def written(tmp_path, texts, **options):
    uri = str(tmp_path / "x.ids.zst")
    writer = token_files.FileWriter(uri, pa.int64(), **options)
    for i, x in enumerate(texts):
        writer.add(i, np.array(x, "<u4").tobytes())
    assert writer.close()[0] == len(texts)
    return uri


def test_any_decoder_reads_the_file(tmp_path):
    import zstandard

    texts = [list(range(i, i + 40)) for i in range(20)]
    uri = written(tmp_path, texts, frame_tokens=16)
    with open(uri, "rb") as f:
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert np.frombuffer(data, "<u4").tolist() == sum(texts, [])


def test_damage_is_noticed(tmp_path):
    texts = [np.random.default_rng(i).integers(0, 49_000, 300).tolist() for i in range(8)]
    uri = written(tmp_path, texts)
    with open(uri, "rb") as f:
        good = f.read()
    reader = token_files.FileReader(uri)
    inside = int(reader.ends[2]) + 40  # in the fourth frame
    for at in (inside, len(good) - 1, len(good) - 20):
        bad = bytearray(good)
        bad[at] ^= 0x55
        with open(uri, "wb") as f:
            f.write(bad)
        if at == inside:
            reader = token_files.FileReader(uri)
            assert np.frombuffer(reader.ids(4, 1), "<u4").tolist() == texts[4]  # the others are as before
            with pytest.raises(ValueError, match="frame 3"):
                reader.ids(3, 1)
        else:
            with pytest.raises(ValueError):
                reader = token_files.FileReader(uri)
                [reader.ids(i, 1) for i in range(len(texts))]
                reader.documents()
    for cut in (0, 5, len(good) // 2, len(good) - 1):
        with open(uri, "wb") as f:
            f.write(good[:cut])
        with pytest.raises(ValueError):
            token_files.FileReader(uri)


def test_query_equals_the_tokenizer(spark, tmp_path):
    rows = [r for r in EDGE if r[0] != 7]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op11_token_files(spark, str(tmp_path)).collect()}
    assert got == {(i, len(x := encoded(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows}
