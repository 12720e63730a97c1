"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which the tokenizer drops and no pre-token crosses, so a text's
ids are its words' ids in order. One pass over the texts makes blocks of documents. A block's distinct words
are dealt to buckets by a hash of the word and written as a table, one row for each block and bucket;
the documents, as positions among the block's words, go to a file of the shared folder. All rows of a bucket
meet in one task, where every distinct word is encoded once by the tokenizers library, and the ids go back
to their blocks. There they are joined to the documents by position, and to the table of pieces
(``vocabulary``, one row per vocabulary entry, so of a fixed size and broadcast) by id, which decodes them.
What is shuffled grows with the distinct words of the blocks, not with the words of the texts; a common word
is one entry of each block, and buckets grow in number with the table, so that one fits in memory.

A block's file is named by the attempt that wrote it, and the name stands in the rows of that attempt. As
the table of rows is written, and so fixed, before anything is shuffled, only rows and files of
one attempt are ever read together, whichever tasks run again later. The files are opened by ``pyarrow.fs``,
so ``spark.checkpoint.dir`` must be a folder that it can open (local, HDFS, S3, GCS).

Cases: a null or empty text has no ids, and its decoded text is empty; very long texts make a block of
their own; repeated rows stay; rows without doc_id keep their null; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import scratch_path, write_table
from strandloom.llm.token_output import _commit, _read
from strandloom.llm.tokens import _BYTES, _gather, load_tokenizer

#: Bytes of text in a block, and blocks whose words fill a bucket.
BLOCK_BYTES = 16 << 20
BLOCKS_PER_BUCKET = 4
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


#: Latin letters, then ASCII punctuation but the apostrophe: two pre-tokens, of which normalization changes but the case.
_SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z")


class WordEncoder:
    """Ids of words as the tokenizers library gives them; of words of letters its model alone is asked."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        normal, cutter = self.tok.normalizer, self.tok.pre_tokenizer
        # what is known of letters and punctuation holds for this chain of normalizers and this regular expression only
        self.by_part = all(x in str(normal) for x in ("NFC", "Lowercase")) and all(x in str(cutter) for x in (r"|[\p{L}]+|", r"|[^\s\p{L}\p{N}]+", "ByteLevel"))

    def _library(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths, rest = array("I"), array("q"), iter(words)
        while some := list(islice(rest, 1 << 14)):
            for e in self.tok.encode_batch_fast(some, add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                lengths.append(len(ids))
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def _model(self, cores: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths, tokenize = array("I"), array("q"), self.tok.model.tokenize
        for c in cores:
            ids = [t.id for t in tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(_BYTES))]
            flat.extend(ids)
            lengths.append(len(ids))
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has. Cores and ends of words are encoded once each; nothing is kept for each word but numbers."""
        if not self.by_part:
            return self._library(words)
        cores: dict[str, int] = {}
        tails: dict[str, int] = {}
        hard, own = [], array("q")
        for w in words:
            m = _SIMPLE.match(w)
            if m:
                own.append(cores.setdefault(m[1].lower(), len(cores)))
                own.append(tails.setdefault(m[2], len(tails)))
            else:
                hard.append(w)
                own.append(-len(hard))
                own.append(-1)
        found = [self._model(cores), self._library(tails), self._library(hard)]
        flat, lengths = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        lengths = np.append(lengths, 0)  # a run of nothing
        runs = np.array(own, np.int64).reshape(-1, 2)
        alone = runs[:, 0] < 0
        runs[:, 1] = np.where(alone, len(lengths) - 1, runs[:, 1] + len(cores))
        runs[alone, 0] = len(cores) + len(tails) - 1 - runs[alone, 0]
        starts = np.cumsum(lengths) - lengths
        return _gather(flat, starts[runs.ravel()], lengths[runs.ravel()]), lengths[runs].sum(axis=1)


def vocabulary(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): the table that decodes."""
    entries = load_tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in entries.items()), "id int, piece string")


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, all lowest bytes first: high bytes press well apart from low ones."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def pack_block(docs: list[int | None], texts: list[bytes], buckets: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The documents as positions among the block's distinct words; and those words, in order, as (bucket, words).

    Positions count in falling order of frequency; a permutation leads from there to the place in the rows of words.
    """
    found = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    counts = pc.list_value_length(found).to_numpy().astype("<i8")
    coded = found.flatten().dictionary_encode()
    del found
    # white space at a text's ends parts off empty words, which have no ids
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    homes = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = by_word[np.argsort(homes[by_word], kind="stable")]
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    indices = coded.indices.to_numpy()
    by_use = np.argsort(-np.bincount(indices, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[by_use] = np.arange(len(words))
    known = np.array([d is not None for d in docs], np.uint8)
    ids = np.array([d or 0 for d in docs], "<i8")
    payload = b"".join([struct.pack("<qq", len(docs), len(words)), known.tobytes(), ids.tobytes(), counts.tobytes(), _planes(place[by_use]), _planes(rank[indices])])
    press = zstandard.ZstdCompressor(level=3)
    cuts = np.flatnonzero(np.diff(homes[order], prepend=-1, append=-1)).tolist()
    rows = [(int(homes[order[i]]), press.compress(b"\n".join([words[k] for k in order[i:j].tolist()]))) for i, j in zip(cuts, cuts[1:])]
    rows = rows or [(0, press.compress(b""))]  # a block without a word has one row all the same
    return zstandard.ZstdCompressor(level=1).compress(payload), rows


def unpack_block(payload: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, places of its words) of each document."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, n_words = struct.unpack_from("<qq", raw)
    known, ids, counts = (np.frombuffer(raw, kind, n, at) for kind, at in ((np.uint8, 16), ("<i8", 16 + n), ("<i8", 16 + 9 * n)))
    at = 16 + 17 * n
    places = _unplanes(raw, n_words, at)[_unplanes(raw, int(counts.sum()), at + 4 * n_words)] if n_words else np.empty(0, np.uint32)
    ends = np.cumsum(counts)
    for k in range(n):
        yield (int(ids[k]) if known[k] else None), places[ends[k] - counts[k] : ends[k]]


def split_words(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(block, bucket, words): the distinct words of each block, whose documents are in the file ``block`` of ``folder``."""
    size = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            payload, rows = pack_block(ids, texts, buckets)
            pa.default_memory_pool().release_unused()
            name = uuid.uuid4().hex
            _commit(f"{folder}/{name}", iter([payload]))
            homes, words = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(homes, pa.int32()), pa.array(words, pa.binary())], ["block", "bucket", "words"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                ids.append(doc)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= size:
                    yield close()
                    ids, texts, held = [], [], 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block string, bucket int, words binary")


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """(block, bucket, ids) of (block, bucket, words): all rows of a bucket meet, and each of its distinct words is encoded once.

    ids: how many each of the row's words has, and all of them.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        rows = [raw.split(b"\n") if (raw := unpress.decompress(w)) else [b""] for w in t.column("words").to_pylist()]
        distinct = list(dict.fromkeys(w for r in rows for w in r))
        number = {w: k for k, w in enumerate(distinct)}
        flat, lengths = WordEncoder(tokenizer).encode([w.decode() for w in distinct])
        starts = np.cumsum(lengths) - lengths
        out = []
        for r in rows:
            own = np.fromiter(map(number.__getitem__, r), np.int64, len(r))
            out.append(press.compress(struct.pack("<q", len(r)) + _planes(lengths[own]) + _planes(_gather(flat, starts[own], lengths[own]))))
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "ids": pa.array(out, pa.binary())})

    return words.groupBy("bucket").applyInArrow(run, "block string, bucket int, ids binary")


def _word_ids(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word of a block has, and all of them."""
    unpress, lengths, ids = zstandard.ZstdDecompressor(), [], []
    for row in rows:
        raw = unpress.decompress(row)
        (n,) = struct.unpack_from("<q", raw)
        lengths.append(_unplanes(raw, n, 8))
        ids.append(_unplanes(raw, (len(raw) - 8) // 4 - n, 8 + 4 * n))
    return np.concatenate(lengths).astype(np.int64), np.concatenate(ids)


def join_blocks(ids: DataFrame, folder: str, pieces: DataFrame) -> DataFrame:
    """RESULT from (block, bucket, ids): a block's ids joined to its documents by position, and to their pieces by id."""
    shared = ids.sparkSession.sparkContext.broadcast(pieces.toArrow())  # one row per vocabulary entry

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lengths, flat = _word_ids([r for _, r in sorted(zip(t.column("bucket").to_pylist(), t.column("ids").to_pylist()))])
        table = shared.value
        entry = pc.index_in(pa.array(flat.astype(np.int32)), value_set=table.column("id"))  # the join of ids and pieces
        of_piece = table.column("piece").combine_chunks().cast(pa.binary()).to_pylist()
        of_id = [b"%d" % i for i in table.column("id").to_pylist()]
        entry = entry.to_numpy()
        as_ids, as_pieces, begin = [], [], 0
        for end in np.cumsum(lengths).tolist():
            part = entry[begin:end].tolist()
            as_ids.append(b" ".join([of_id[i] for i in part]))
            as_pieces.append(b" ".join([of_piece[i] for i in part]))
            begin = end
        empty = bool((lengths == 0).any())
        rows = []
        for doc, places in unpack_block(_read(f"{folder}/{key[0].as_py()}")):
            n = lengths[places]
            own = (places[n > 0] if empty else places).tolist()
            rows.append((doc, int(n.sum()), hashlib.sha256(b" ".join([as_ids[p] for p in own])).hexdigest(), hashlib.sha256(b" ".join([as_pieces[p] for p in own])).hexdigest()))
        doc, n, a, b = zip(*rows)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)})

    # blocks are small in bytes but not in work: they are dealt out to all partitions
    return ids.repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").groupBy("block").applyInArrow(run, RESULT)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """RESULT for every row of ``docs``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES // BLOCKS_PER_BUCKET)
    folder = scratch_path(spark, "blocks")
    words, _ = write_table(split_words(docs, folder, buckets), "words")
    return join_blocks(encode_words(words, tokenizer), folder, vocabulary(spark, tokenizer))
