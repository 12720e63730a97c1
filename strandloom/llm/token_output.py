"""Token ids as binary shards: one zstandard frame for each document, with a shared dictionary.

``write_tokens`` deals documents out in ascending order of doc_id, encodes them where they land and
writes one shard per partition; ``read_tokens`` reads whole shards back and ``read_document`` one document.

A shard, all numbers little-endian: the magic ``SLT1``; the frames, one for each document, each the
compressed ids (16 bits an id if the vocabulary allows, else 32); the index, an Arrow stream of
(doc_id long, offset long, size int, n_tokens int) in order; a footer of 4 + 8 + 8 + 8 + 8 bytes: bits
of an id, XXH64 of the dictionary, places of the index's begin and end, magic again padded to 8. The
dictionary is the file ``dictionary`` beside the shards; it is trained on the serialized id arrays of
a bounded sample (``dictionary_docs`` documents, of at most ``LONGEST_SAMPLE`` bytes each), and every
document, sampled or not, is written with it.

Writers write under a name of their own and rename at the end, so a task that runs twice leaves one
shard. Cases: a null text is empty and has the end id alone; rows without doc_id come first; equal
doc_ids follow each other in the order of a hash of their texts; no rows, no shards.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.tokens import encoder, load_tokenizer

MAGIC = b"SLT1"
_FOOTER = "<IQqq8s"
LONGEST_SAMPLE = 32_768
DICTIONARY_BYTES = 65_536
LEVEL = 3


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _read(uri: str) -> bytes:
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        return f.read()


def _commit(uri: str, parts: Iterator[bytes]) -> None:
    store, path = _open(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for p in parts:
            f.write(p)
    store.move(own, path)


def _pack_ids(ids: bytes, bits: int) -> bytes:
    return ids if bits == 32 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _unpack_ids(raw: bytes, bits: int) -> bytes:
    return raw if bits == 32 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, bits: int, sample_docs: int = 1024) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` documents, chosen by a hash; empty if they are too few or too short to train on."""
    n = docs.count()
    end = np.array([end_id], "<u4").tobytes()
    share = min(1 << 20, -(-(sample_docs << 20) // max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            raw = [_pack_ids(ids + end, bits) for ids in enc.encode_all(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r for r in raw if len(r) <= LONGEST_SAMPLE], pa.binary())], ["raw"])

    chosen = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).limit(sample_docs)
    samples = sorted(bytes(r["raw"]) for r in chosen.mapInArrow(run, "raw binary").toLocalIterator())
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(sum(map(len, samples)) // 10, 1024)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, dictionary_docs: int = 1024) -> list[tuple]:
    """Write shards to ``folder``; (uri, start of its first document, documents, tokens) of each, in order. One row per partition reaches the driver."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    bits = 16 if max(load_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 32
    dictionary = train_dictionary(docs, tokenizer, end_id, bits, dictionary_docs)
    _commit(f"{folder}/dictionary", iter([dictionary]))
    end, mark = np.array([end_id], "<u4").tobytes(), xxhash.xxh64_intdigest(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        ids_of, offsets, sizes, counts = [], [], [], []

        def parts() -> Iterator[bytes]:
            yield MAGIC
            at = len(MAGIC)
            for b in batches:
                for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode_all(b.column("text").to_pylist())):
                    ids += end
                    frame = press.compress(_pack_ids(ids, bits))
                    ids_of.append(doc), offsets.append(at), sizes.append(len(frame)), counts.append(len(ids) // 4)
                    at += len(frame)
                    yield frame
            table = pa.table({"doc_id": pa.array(ids_of, pa.int64()), "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int32()), "n_tokens": pa.array(counts, pa.int32())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            index = sink.getvalue().to_pybytes()
            yield index
            yield struct.pack(_FOOTER, bits, mark, at, at + len(index), MAGIC)

        uri = f"{folder}/shard-{shard:06d}"
        _commit(uri, parts())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(counts)], pa.int64()), pa.array([sum(counts)], pa.int64())], ["shard", "uri", "docs", "tokens"])

    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "shard int, uri string, docs long, tokens long").collect()
    out, start = [], 0
    for r in sorted(rows):
        if r["docs"]:
            out.append((r["uri"], start, r["docs"], r["tokens"]))
            start += r["tokens"]
    return out


class Shard:
    """An open shard; ``document(i)`` reads the i-th document without the others."""

    def __init__(self, uri: str):
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.bits, mark, begin, end, magic = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        dictionary = _read(f"{uri.rpartition('/')[0]}/dictionary")
        if magic.rstrip(b"\0") != MAGIC or xxhash.xxh64_intdigest(dictionary) != mark:
            raise ValueError(f"{uri} is no shard of the dictionary beside it")
        self.index = pa.ipc.open_stream(self.file.read_at(end - begin, begin)).read_all()
        self.offsets, self.sizes = self.index.column("offset").to_pylist(), self.index.column("size").to_pylist()
        self.unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def document(self, i: int) -> bytes:
        return _unpack_ids(self.unpress.decompress(self.file.read_at(self.sizes[i], self.offsets[i])), self.bits)


def read_document(uri: str, doc_id: int) -> np.ndarray | None:
    """The ids of the first document of that id in a shard, by its index alone."""
    shard = Shard(uri)
    found = [i for i, d in enumerate(shard.index.column("doc_id").to_pylist()) if d == doc_id]
    return np.frombuffer(shard.document(found[0]), "<u4") if found else None


def read_tokens(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
                shard = Shard(uri)
                docs = shard.index.column("doc_id").to_pylist()
                for i in range(0, len(docs), 256):
                    ids = [shard.document(j) for j in range(i, min(i + 256, len(docs)))]
                    n = [len(x) // 4 for x in ids]
                    starts = start + np.cumsum([0, *n[:-1]])
                    start += sum(n)
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 256], pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.createDataFrame([s[:2] for s in shards], "uri string, start long").repartition(max(1, len(shards)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
