"""Token ids in length-delimited binary records, with an offset index.

A file is a row of records. A record is

    length of the payload        unsigned 64 bits, little endian
    masked CRC-32 of the length  unsigned 32 bits, little endian
    payload
    masked CRC-32 of the payload unsigned 32 bits, little endian
    line feed                    one byte

and a payload is the width of an id in bytes (2 or 4, one byte), 1 if there is
a document id (one byte), the document id (signed 64 bits), and the token ids,
all little endian. A checksum is masked, rotated right by 15 bits plus a
constant, so that the checksum of data that hold checksums stays sound. The
index is a Parquet table beside the files, with the place of every record.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Recent, Tokenizer
from .common import slices

_MASK = 0xA282EAD8
#: Entries of a worker's tables: smaller than where no files are held beside.
TABLE = 180_000
_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")
_INDEX = "file long, record long, offset long, length long, doc_id long, start_in_file long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without the final line feed."""
    payload = _HEAD.pack(width, doc_id is not None, doc_id or 0) + ids
    length = _LENGTH.pack(len(payload))
    return b"".join([length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))])


def records(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length of the whole record, document id, ids) of each record;
    raises ValueError where a checksum or a length is wrong."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < 17:
            raise ValueError(f"cut record at {at}")
        length = bytes(view[at : at + 8])
        if _CHECK.unpack_from(view, at + 8)[0] != masked(length):
            raise ValueError(f"wrong checksum of a length at {at}")
        size = _LENGTH.unpack(length)[0]
        if at + size + 17 > len(data):
            raise ValueError(f"cut record at {at}")
        payload = view[at + 12 : at + 12 + size]
        if _CHECK.unpack_from(view, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"wrong checksum of a record at {at}")
        width, has_id, doc_id = _HEAD.unpack_from(payload)
        yield at, size + 17, doc_id if has_id else None, np.frombuffer(payload[_HEAD.size :], f"<u{width}")
        at += size + 17


class LibraryEncoder(Tokenizer):
    """Ids by the tokenizers library's model, which sees each word once as
    long as it stays in a table of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import tokenizers

        super().__init__(path)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known, self.words = Recent(TABLE), Recent(TABLE)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def code_spelt(self, spelt: set[str]) -> dict[str, bytes]:
        coded, tokenize = self.trie.coded, self.library.model.tokenize
        return {s: b"".join([coded[t.id] for t in tokenize(s)]) for s in spelt}

    def pack(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes()


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Free a worker's encoders: where files are read they have been written,
    and their tables would lie beside whole files."""
    if _ENCODERS:
        _ENCODERS.clear()
        pa.default_memory_pool().release_unused()


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = 1, file_bytes: int = 16 << 20) -> None:
    """Encode the whole texts of docs (doc_id, text) and write them to
    ``folder``/data in ascending doc_id order, null ids first, rows of equal id
    by the hash of their text; then write the index to ``folder``/index.

    path: a tokenizer file that every executor has. Every document ends with
    end_id; a null or empty text is just that. file_bytes: text for each file;
    a file is one record at least and is read whole. Repeated rows give
    repeated records. An empty table gives an empty folder. Columns other than
    doc_id and text are not written. The rows are dealt out once, by ranges of
    id and text hash, so an id with very many rows spreads over files; a task
    that is lost writes its file again, and Spark commits each file once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = own.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = end_id.to_bytes(4, "little")
        for b in slices(batches, 1):
            ids = encoder.encode_batch(b.column(1))
            frames = pa.array([framed(i, encoder.pack(t + end), encoder.width) for i, t in zip(b.column(0).to_pylist(), ids, strict=True)], pa.binary())
            # The writer copies a string's bytes as they are.
            yield pa.RecordBatch.from_arrays([frames.view(pa.utf8())], ["value"])

    dealt.mapInArrow(frame, "value string").write.option("compression", "none").option("maxRecordsPerFile", 0).text(f"{folder}/data")
    write_index(docs.sparkSession, folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content): the number of a file in the order of ids, its bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content")


def write_index(spark: SparkSession, folder: str) -> None:
    """Walk over all files once and write the place of every record."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, start = [], 0
                for n, (offset, length, doc_id, ids) in enumerate(records(data.as_buffer())):
                    rows.append((file, n, offset, length, doc_id, start, len(ids)))
                    start += len(ids)
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _INDEX.split(", ")])

    _files(spark, folder).mapInArrow(walk, _INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: the number of ids in all records before. The
    only sum over everything has one row for each file."""
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("__ids"))
    before = F.sum("__ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    return index.join(files.select("file", F.coalesce(before, F.lit(0)).alias("__base")), "file").withColumn("start", F.col("__base") + F.col("start_in_file")).drop("__base")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, record, doc_id, ids) of every record, checked; ids as
    little-endian unsigned 32-bit numbers in a binary value."""
    schema = "file long, record long, doc_id long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for n, (_, _, doc_id, ids) in enumerate(records(data.as_buffer())):
                    rows.append((file, n, doc_id, ids.astype("<u4").tobytes()))
                    held += len(rows[-1][3])
                    if held > 8 << 20:
                        yield _rows(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, schema)

    return _files(spark, folder).mapInArrow(read, schema)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(file, record, doc_id, ids) of the records that ``wanted`` (rows of the
    index, in any order) names: each file is opened once and only its wanted
    places are read. The offsets of one file meet in one task, no more."""
    places = wanted.groupBy("file").agg(F.collect_list(F.struct("record", "offset", "length")).alias("places"))
    schema = "file long, record long, doc_id long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for b in batches:
            for file, data, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                buffer = data.as_buffer()
                rows = []
                for p in own:
                    for _, _, doc_id, ids in records(buffer[p["offset"] : p["offset"] + p["length"]]):
                        rows.append((file, p["record"], doc_id, ids.astype("<u4").tobytes()))
                yield _rows(rows, schema)

    return _files(spark, folder).join(places, "file").select("file", "content", "places").mapInArrow(read, schema)
