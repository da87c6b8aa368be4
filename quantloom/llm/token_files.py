"""Token files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds the 32-bit little-endian ids of whole documents. Each document has frames of its own (several if it is
long), so a reader decompresses what it asks for and nothing else. The layout is the published seekable one, so any
zstandard decoder still reads a file from front to end:

    frame ... frame | documents frame | seek table

The documents frame is skippable and holds an Arrow table of the documents: id, number of the first frame, frames,
tokens. The seek table is skippable, too: compressed size, decompressed size and checksum (the low half of XXH64) of each
frame, then their number, a descriptor and the magic number. Frames are checked on reading against both.

Writing deals the documents into ranges of ascending id, encodes each range in a task and streams it to files of a
bounded size. A task names its files anew on each attempt and its result names them, so of a task that is done again only
the files of the attempt that counts are known; a lost executor costs its ranges. Reading deals documents by file and
place. Files are opened with pyarrow's file systems, so a path may be of any store that they reach.

Cases: null and empty texts are the end id alone; rows without an id come first; repeated ids stay rows of their own, in
the order of their texts' hashes; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .packing import AT_ONCE, Ids, word_ranks
from .spark_tools import shared_dir, stage, table, text_batches
from .text_kernels import released

END = 2
# Fixed values of the seekable layout: magic numbers of skippable frames and of the table, the flag for checksums.
DOCUMENTS_MAGIC, TABLE_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Most tokens of a frame; a file ends at the document that reaches one of these.
FRAME_TOKENS, FILE_TOKENS, FILE_DOCUMENTS = 1 << 16, 1 << 24, 1 << 18
FILES = "part int, roll int, file string, documents long, tokens long, bytes long"
_LOADED: dict[str, Ids] = {}


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


class FileWriter:
    """Writes one token file, a document at a time."""

    def __init__(self, uri: str, id_type: pa.DataType, level: int = 3, frame_tokens: int = FRAME_TOKENS) -> None:
        import zstandard

        self.uri, self.id_type, self.step = uri, id_type, 4 * frame_tokens
        store, path = _store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)  # the frames are compressed, not the file
        # a frame's own checksum is its last four bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.seek: list[tuple[int, int, int]] = []
        self.ids: list = []
        self.rows: list[tuple[int, int, int]] = []
        self.tokens = self.size = 0

    def _frame(self, data: bytes, size: int, checksum: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.seek.append((len(data), size, *struct.unpack("<I", checksum)))

    def add(self, doc_id, data: bytes) -> None:
        """A document: its id and the bytes of its token ids."""
        first = len(self.seek)
        for at in range(0, len(data), self.step):
            part = data[at : at + self.step]
            frame = self.compress(part)
            self._frame(frame, len(part), frame[-4:])
        self.ids.append(doc_id)
        self.rows.append((first, len(self.seek) - first, len(data) // 4))
        self.tokens += len(data) // 4

    def close(self) -> tuple[int, int, int]:
        """Documents, tokens and bytes of the file."""
        columns = [pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        sink = pa.BufferOutputStream()
        documents = pa.table([pa.array(self.ids, self.id_type), *columns], ["id", "frame", "frames", "n_tokens"])
        with pa.ipc.new_stream(sink, documents.schema) as out:
            out.write_table(documents)
        packed = self.compress(sink.getvalue().to_pybytes())
        self._frame(struct.pack("<II", DOCUMENTS_MAGIC, len(packed)) + packed, 0, packed[-4:])
        entries = np.array(self.seek, "<u4").tobytes() + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries)) + entries)
        self.out.close()
        return len(self.rows), self.tokens, self.size + 8 + len(entries)


class FileReader:
    """Reads one token file: its seek table when it is opened, frames when they are asked for."""

    def __init__(self, uri: str) -> None:
        import xxhash
        import zstandard

        self.uri = uri
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9)) if size >= 17 else (0, 0, 0)
        length = 12 * count + 9
        if magic != SEEK_MAGIC or flags != CHECKSUMS or size < length + 8 or struct.unpack("<II", self._at(size - length - 8, 8)) != (TABLE_MAGIC, length):
            raise ValueError(f"{uri}: no seek table")
        table_ = np.frombuffer(self._at(size - length, 12 * count), "<u4").reshape(count, 3)
        self.ends = np.cumsum(table_[:, 0], dtype=np.int64)
        self.sizes, self.checksums = table_[:, 1], table_[:, 2]
        if not count or self.ends[-1] != size - length - 8:
            raise ValueError(f"{uri}: the seek table fits no file of {size} bytes")
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.checksum = lambda data: xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
        self.frames_read = 0

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def _begin(self, frame: int) -> int:
        return int(self.ends[frame - 1]) if frame else 0

    def _checked(self, data: bytes, frame: int) -> bytes:
        import zstandard

        try:
            out = self.decompress(data)
        except zstandard.ZstdError as e:
            raise ValueError(f"{self.uri}: frame {frame} is damaged: {e}") from e
        if self.checksum(out) != self.checksums[frame] or self.sizes[frame] not in (0, len(out)):
            raise ValueError(f"{self.uri}: frame {frame} differs from the seek table")
        self.frames_read += 1
        return out

    def documents(self) -> pa.Table:
        """id, frame, frames and n_tokens of each document."""
        last = len(self.ends) - 1
        data = self._at(self._begin(last), int(self.ends[last]) - self._begin(last))
        return pa.ipc.open_stream(self._checked(data[8:], last)).read_all()

    def ids(self, frame: int, frames: int) -> bytes:
        """The token ids of a document, by its frames: one read, and only these frames are decompressed."""
        begin = self._begin(frame)
        data = self._at(begin, int(self.ends[frame + frames - 1]) - begin)
        return b"".join(self._checked(data[self._begin(i) - begin : int(self.ends[i]) - begin], i) for i in range(frame, frame + frames))


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end: int = END, file_tokens: int = FILE_TOKENS, **options) -> DataFrame:
    """Encodes the texts, writes token files to path in ascending order of ids, and returns the table of files:
    part, roll (the files' order), file, documents, tokens, bytes. It is kept at path/files.

    Texts are shuffled once, by range of id; what Spark samples for the ranges are ids and hashes. options: level and
    frame_tokens of FileWriter.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(word_ranks(public_tokenizers.path(vocabulary)))
    folder = f"{path}/{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = Ids(public_tokenizers.path(vocabulary), *ranks.value)
        part, attempt, tail = TaskContext.get().partitionId(), uuid.uuid4().hex, np.array([end], "<u4").tobytes()
        writer, done = None, []

        def close() -> None:
            done.append((part, len(done), writer.uri, *writer.close()))

        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, AT_ONCE + (sizes[lo - 1] if lo else 0), "right")))
                words = [(x or "").replace("\n", " ").split(" ") for x in texts.slice(lo, hi - lo).to_pylist()]
                known = _LOADED[vocabulary].learn(set().union(*words))
                for doc_id, parts in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), words, strict=True):
                    if writer is None:
                        writer = FileWriter(f"{folder}/{part:06d}-{len(done):04d}-{attempt}.ids.zst", batch.column(0).type, **options)
                    writer.add(doc_id, b"".join(map(known.__getitem__, parts)) + tail)
                    if writer.tokens >= file_tokens or len(writer.rows) >= FILE_DOCUMENTS:
                        close()
                        writer = None
                lo = hi
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [f.split()[0] for f in FILES.split(", ")])
        released()

    # equal rows differ by their place, so that a group of them may be dealt to several ranges
    order = [F.col("id").asc_nulls_first(), "hash", "row"]
    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    ranged.mapInArrow(write, FILES).write.parquet(f"{path}/files")
    return token_files(spark, path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """The table of files at path."""
    return spark.read.schema(FILES).parquet(f"{path}/files")


def token_documents(files: DataFrame, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, file, frame, frames) of each document, from the ends of the files: no token is read.

    start: the tokens of all documents before it. The window over files has a row for each file, not for each document.
    """
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")).select("file", "start")
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("start long, n_tokens long, file string, frame int, frames int")])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = FileReader(uri).documents().combine_chunks()
                tokens = found["n_tokens"].to_numpy()
                starts = start + np.cumsum(tokens) - tokens
                n = len(tokens)
                yield from pa.table([found["id"], pa.array(starts), found["n_tokens"], pa.array([uri] * n, pa.string()), found["frame"], found["frames"]], schema.names).to_batches(max_chunksize=10_000)

    spread = starts.repartition(max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism)))
    return spread.mapInArrow(tails, schema).withColumnRenamed("id", id_col)


def read_ids(documents: DataFrame, id_col: str = "doc_id", task_tokens: int = FILE_TOKENS) -> DataFrame:
    """(id, start, n_tokens, ids) of the documents, a table or a part of one that token_documents() gives; ids: their
    bytes, 32 bits each, little-endian. Only their frames are decompressed, each checked."""
    rows = documents.select(F.col(id_col).alias("id"), "start", "n_tokens", "file", "frame", "frames")
    tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-tokens // task_tokens))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            lo, data, size = 0, [], 0
            for i, (uri, frame, frames) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "frames")), strict=True)):
                if reader is None or reader.uri != uri:
                    reader = FileReader(uri)
                data.append(reader.ids(frame, frames))
                size += len(data[-1])
                if size > AT_ONCE or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(data)) for c in range(3)), pa.array(data, pa.binary())], schema.names)
                    lo, data, size = i + 1, [], 0

    # dealt by place to a fixed number of tasks: the rows are short, their frames are not
    dealt = rows.repartitionByRange(tasks, "file", "frame").sortWithinPartitions("file", "frame")
    return dealt.mapInArrow(read, schema).withColumnRenamed("id", id_col)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = write_token_files(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    documents = stage(token_documents(files, docs.schema["doc_id"].dataType))
    return read_ids(documents).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
