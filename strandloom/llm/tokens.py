"""Whole-text encoding with the tokenizers library, one call for each distinct piece of text.

``TextEncoder`` cuts a text before every space that stands between two other characters, and, in texts
whose white space is single spaces and line ends, before every line end. A byte-level pre-tokenizer starts a
new pre-token exactly there, so the ids of the pieces, in order, are the ids of the text. Punctuation
after letters at the end of a piece is a pre-token as well, so it is encoded apart from the word. The texts of a call are cut and their pieces numbered by Arrow, so that only distinct pieces
are looked up, and ids are put together by array operations. Ids of short pieces are kept in a table of
bounded size for as long as the Python worker lives; when it is full, the half that was used in the
fewest calls goes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandloom.llm.worker import claim

#: White space but the space and the line end.
_OTHER_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A line end, letters of the Latin blocks, and ASCII punctuation but the apostrophe: three pre-tokens, of which the second takes the space before it.
_SIMPLE = re.compile(r"(\n?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]{0,8})\Z")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others, in order, from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE, _LINE_END = _BYTES[0x20], _BYTES[0x0A]
#: Pieces kept in a worker's table, and the longest kept piece in characters.
TABLE_SIZE = 800_000
LONGEST_KEPT = 64
#: Runs of punctuation kept beside the table.
TAILS = 10_000
#: Characters of text whose new pieces are encoded in one call.
TOGETHER = 1 << 21
#: Words of one text that is made of new words.
_WORDS_TOGETHER = 1024


def load_tokenizer(path: str):
    """The tokenizer of a JSON file, without truncation or padding. Each Spark core has its own worker, so one thread is enough."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _plain(text: str) -> bool:
    """White space is single spaces and line ends, and not at the text's ends."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace():
        return False
    return not any(c in text for c in _OTHER_SPACE)


def cut(text: str) -> list[str]:
    """Pieces of a text; every one but the first is without its leading space, unless it has a line end there."""
    return text.replace("\n", " \n").split(" ") if _plain(text) else _CUT.split(text)


def _cut_all(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in a row, and how many each has."""
    plain = np.fromiter(map(_plain, texts), bool, len(texts))
    if plain.all():
        found = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
    else:
        found = pa.array(map(cut, texts), pa.list_(pa.large_string()))
    return found.flatten(), pc.list_value_length(found).to_numpy().astype(np.int64)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


class _Table:
    """Pieces as runs of ids in one array."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths, self.uses = (np.zeros(1 << 16, t) for t in (np.int64, np.int32, np.int32))
        self.n = self.n_ids = 0

    def find(self, pieces: Sequence[str]) -> np.ndarray:
        """The number of each piece, or -1: a piece is looked up once, as that is most of what known pieces cost."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: Sequence[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.n + len(pieces), self.n_ids + len(ids)
        if m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * m)
        if n > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate((a, np.zeros(2 * n - len(a), a.dtype))) for a in (self.starts, self.lengths, self.uses))
        self.ids[self.n_ids : m] = ids
        self.lengths[self.n : n] = lengths
        self.starts[self.n : n] = self.n_ids + np.cumsum(lengths) - lengths
        self.number.update(zip(pieces, range(self.n, n)))
        self.n, self.n_ids = n, m

    def shrink(self, room: int) -> None:
        """Keep the ``room`` pieces of most uses; uses count half from now on."""
        keep = np.zeros(self.n, bool)
        if room > 0 and self.n:
            keep[np.argpartition(-self.uses[: self.n], min(room, self.n) - 1)[:room]] = True
        old = np.flatnonzero(keep)
        ids, lengths = _gather(self.ids, self.starts[old], self.lengths[old].astype(np.int64)), self.lengths[old]
        uses = self.uses[old] >> 1
        kept = [p for p, k in zip(self.number, keep[np.fromiter(self.number.values(), np.int64, self.n)].tolist()) if k]
        self.__init__()
        self.add(kept, ids, lengths)
        self.uses[: self.n] = uses


class TextEncoder:
    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        worded = all(any(map(str.isalpha, t.content)) for t in self.tok.get_added_tokens_decoder().values())  # punctuation alone is none of the added tokens
        self.by_piece = self.tok.normalizer is None and type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and worded
        self.table = _Table()
        self.begins = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.begins[i] = piece.startswith(_SPACE)
        self.tails: dict[str, tuple[int, ...]] = {}

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_cores(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_one_by_one`` for letters, alone or after a line end: the model is asked without the pre-tokenizer."""
        tokenize, flat, lengths = self.tok.model.tokenize, array("I"), array("q")
        line_end = [t.id for t in tokenize(_LINE_END)]
        for w in cores:
            if w.isascii() and w[0] != "\n":
                ids = [t.id for t in tokenize(_SPACE + w)]
            elif w[0] != "\n":
                ids = [t.id for t in tokenize((" " + w).encode().decode("latin-1").translate(_BYTES))]
            else:
                ids = line_end + [t.id for t in tokenize(w[1:].encode().decode("latin-1").translate(_BYTES))]
            flat.extend(ids)
            lengths.append(len(ids))
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, each with a space before it, and how many each has.

        Words without white space are encoded as one text: it is parted again where an id begins with the space.
        """
        joined = [" " + " ".join(words[i : i + _WORDS_TOGETHER]) for i in range(0, len(words), _WORDS_TOGETHER)]
        ids = np.concatenate([np.array(i, np.uint32) for i in self._encode(joined)]) if joined else np.empty(0, np.uint32)
        at = np.flatnonzero(self.begins[ids])
        if len(at) == len(words) and (not words or at[0] == 0):
            return ids, np.diff(at, append=len(ids))
        return self._one_by_one([" " + w for w in words])

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._encode(pieces)
        flat = array("I")
        for i in found:
            flat.extend(i)
        return np.array(flat, np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, new: list[str]) -> None:
        """Put pieces that are not in the table there."""
        table = self.table
        simple, other = [], []
        for p in new:
            m = _SIMPLE.match(p)
            simple.append((p, m[1], m[2])) if m else other.append(p)
        cores = list({core for _, core, _ in simple if core not in table.number})
        table.add(cores, *self._encode_cores(cores))
        # an added token may stand inside a piece, and so may white space: those are encoded alone
        joined = [p for p in other if "<" not in p and p[:1] != "\n" and p.split() == [p]]
        table.add(joined, *self._encode_words(joined))
        if len(joined) < len(other):
            told = set(joined)
            alone = [p for p in other if p not in told]
            table.add(alone, *self._one_by_one([p if p[:1] == "\n" else " " + p for p in alone]))
        tailed = [x for x in simple if x[2]]
        if tailed:
            pieces, cores, tails = zip(*tailed)
            if len(self.tails) > TAILS:
                self.tails = {}
            unknown = list(set(tails) - self.tails.keys())
            self.tails.update(zip(unknown, map(tuple, self._encode(unknown))))
            at = np.fromiter(map(table.number.__getitem__, cores), np.int64, len(cores))
            after = list(map(self.tails.__getitem__, tails))
            n_core, n_tail = table.lengths[at].astype(np.int64), np.fromiter(map(len, after), np.int64, len(after))
            lengths = n_core + n_tail
            of_tail = _gather(np.arange(lengths.sum()), np.cumsum(lengths) - n_tail, n_tail)
            ids = np.empty(int(lengths.sum()), np.uint32)
            of_core = np.ones(len(ids), bool)
            of_core[of_tail] = False
            ids[of_core], ids[of_tail] = _gather(table.ids, table.starts[at], n_core), np.fromiter(chain.from_iterable(after), np.uint32, len(of_tail))
            table.add(pieces, ids, lengths)

    def _encode_some(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_piece:
            yield from (array("I", i).tobytes() for i in self._encode(texts))
            return
        pieces, counts = _cut_all(texts)
        first = np.cumsum(counts) - counts
        later = np.ones(len(pieces), bool)
        later[first] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        distinct, table = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.table  # to_pylist makes a scalar of each
        is_long = pc.greater(pc.utf8_length(coded.dictionary), LONGEST_KEPT).to_numpy(zero_copy_only=False)
        long = [distinct[k] for k in np.flatnonzero(is_long)]
        short = [p for p in distinct if len(p) <= LONGEST_KEPT] if long else distinct
        known = table.find(short)
        if table.n + 2 * int((known < 0).sum()) > TABLE_SIZE:
            table.shrink(max(min(TABLE_SIZE // 2, TABLE_SIZE - 2 * len(short)), 0))
            known = table.find(short)
        missing = np.flatnonzero(known < 0)
        new = [short[k] for k in missing.tolist()]
        self._learn(new)
        known[missing] = table.find(new)
        table.uses[known] += 1
        # pieces of the table, then the first pieces of the texts and long pieces, which are not kept
        extra, of_extra = self._one_by_one([*pieces.take(pa.array(first)).to_pylist(), *(p if p[:1] == "\n" else " " + p for p in long)])
        begin_extra = table.n_ids + np.cumsum(of_extra) - of_extra
        starts, lengths = np.empty(len(distinct) + len(texts), np.int64), np.empty(len(distinct) + len(texts), np.int64)
        own = np.concatenate((is_long, np.ones(len(texts), bool)))
        starts[:-len(texts)][~is_long], lengths[:-len(texts)][~is_long] = table.starts[known], table.lengths[known]
        starts[own], lengths[own] = np.roll(begin_extra, len(long)), np.roll(of_extra, len(long))
        number = np.empty(len(pieces), np.int64)
        number[later] = coded.indices.to_numpy()
        number[first] = len(distinct) + np.arange(len(texts))
        starts, lengths = starts[number], lengths[number]
        ids = _gather(np.concatenate((table.ids[: table.n_ids], extra)), starts, lengths).tobytes()
        at = 0
        for end in (4 * np.cumsum(lengths)[np.cumsum(counts) - 1]).tolist():
            yield ids[at:end]
            at = end

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        some, size = [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= TOGETHER:
                yield from self._encode_some(some)
                some, size = [], 0
        if some:
            yield from self._encode_some(some)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This Python worker's encoder for a file."""
    claim("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
