"""GIF columns: payloads in frames, decoding to timed frames, colour histograms.

``encode_gifs`` stores bytes as the colour indices of square 8-bit frames, each an LZW code stream with a string
table of its own; ``decode_gif`` reads any GIF (87a or 89a): it walks the blocks, decodes the code streams,
applies global or local palettes, interlacing, transparency and the disposal rules, and gives every
frame's canvas with its place in time. ``frame_table`` stores those as rows; ``media_features`` gives one row for
each GIF, with its frames' times and the colour histogram of every canvas. Both draw canvases by the same
rules: frames that cover the whole canvas with nothing clear do not depend on those before and are drawn
together, others one after the other.

The LZW decoder works on many code streams with array operations. After a clear code the width of
the n-th code is known beforehand, so codes between clears are cut at fixed bit offsets. The string of
a code beyond the alphabet is the string of an earlier code of the segment and one more byte, which
all stand in the output before it; every output byte therefore points to an earlier one, and
following the pointers by doubling resolves all of them at once.

Cases: a null payload is empty; an empty text still has one frame of filler; a truncated or damaged
stream raises ValueError in ``decode_gif``, gives no row in ``frame_table`` and a null row of features in ``media_features``;
rows with equal media have equal features; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 24
FRAME_BYTES = SIDE * SIDE
FILL = 255
DELAY = 4  # hundredths of a second
_GREYS = bytes(v for i in range(256) for v in (i, i, i))


def pad_payload(data: bytes) -> bytes:
    """Filled up to a positive multiple of a frame."""
    frames = max(1, -(-len(data) // FRAME_BYTES))
    return data + bytes([FILL]) * (frames * FRAME_BYTES - len(data))


#: Frames coded side by side, and the slots of a frame's string table: 2 to this power.
_SIDE_BY_SIDE, _SLOT_BITS = 512, 12


def _lzw_codes(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of 8-bit frames (frames x FRAME_BYTES) between their clear and end codes, and how many each has. One pixel of all frames is coded in a step.

    A frame's table is small enough for a processor's cache: a string (a code and one more byte) has one slot by its hash, with the
    string's own code beside it, and takes the slot from another. The few strings lost that way are coded by shorter ones.
    """
    columns, n = np.ascontiguousarray(pixels.T).astype(np.uint32), len(pixels)
    table = np.zeros(n << _SLOT_BITS, np.uint32)
    base = np.arange(n, dtype=np.uint32) << np.uint32(_SLOT_BITS)
    cur, free = columns[0], np.full(n, 258, np.uint32)
    codes, emitted = np.empty(columns.shape, np.uint16), np.ones(columns.shape, bool)
    for k in range(1, len(columns)):
        p = columns[k]
        key = (cur << np.uint32(8)) + p + np.uint32(1)  # 0 is an empty slot
        slot = (key * np.uint32(2654435761) >> np.uint32(32 - _SLOT_BITS)) + base
        found = table[slot]
        new = found >> np.uint32(10) != key
        codes[k - 1], emitted[k - 1] = cur, new
        at = new.nonzero()[0]
        table[slot[at]] = (key[at] << np.uint32(10)) + free[at]
        free[at] += np.uint32(1)
        cur = found & np.uint32(1023)
        cur[at] = p[at]
    codes[-1] = cur
    return codes.T[emitted.T], emitted.sum(axis=0)


def _streams(codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Runs of codes as bytes: a clear, the codes at the widths of a growing table, the end code."""
    _, widths = _offsets(8)
    n = counts + 2
    ends = np.cumsum(n)
    first = ends - n
    inner = np.ones(ends[-1], bool)
    inner[first] = inner[ends - 1] = False
    all_codes = np.empty(ends[-1], np.uint32)
    all_codes[first], all_codes[ends - 1], all_codes[inner] = 256, 257, codes
    width = widths[np.maximum(np.arange(ends[-1]) - np.repeat(first, n) - 1, 0)]
    bit = np.cumsum(width) - width
    size = -(-np.add.reduceat(width, first) // 8)
    start = np.cumsum(size) - size
    bit += np.repeat(8 * start - bit[first], n)
    shifted, at = all_codes << (bit & 7).astype(np.uint32), bit >> 3
    total = int(size.sum()) + 2
    # a code is in at most three bytes, of which it has bits of its own
    raw = (np.bincount(at, shifted & 255, total) + np.bincount(at + 1, shifted >> 8 & 255, total) + np.bincount(at + 2, shifted >> 16, total)).astype(np.uint8).tobytes()
    return [raw[a : a + k] for a, k in zip(start.tolist(), size.tolist())]


def encode_gifs(payloads: list[bytes]) -> list[bytes]:
    """Looping grey GIFs of 24 x 24 frames; each payload is a positive multiple of a frame. Frames of all payloads are coded side by side."""
    if not all(p and len(p) % FRAME_BYTES == 0 for p in payloads):
        raise ValueError("a payload is no positive multiple of a frame")
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _GREYS + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    before = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\x00\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME_BYTES)
    images = []
    for i in range(0, len(pixels), _SIDE_BY_SIDE):
        for stream in _streams(*_lzw_codes(pixels[i : i + _SIDE_BY_SIDE])):
            blocks = [stream[j : j + 255] for j in range(0, len(stream), 255)]
            images.append(before + b"".join([bytes([len(b)]) + b for b in blocks]) + b"\0")
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME_BYTES
        out.append(b"".join([head, *images[at : at + n], b"\x3b"]))
        at += n
    return out


def encode_gif(payload: bytes) -> bytes:
    """``encode_gifs`` of one payload."""
    return encode_gifs([payload])[0]


_layouts: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _offsets(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the codes after a clear: the table has one more entry from the second code on."""
    if size not in _layouts:
        widths, width, free = [], size + 1, (1 << size) + 2
        for n in range(1 << 16):
            widths.append(width)
            if n >= 1:
                free += 1
            if free == 1 << width and width < 12:
                width += 1
        w = np.array(widths, np.int64)
        _layouts[size] = np.concatenate(([0], np.cumsum(w)[:-1])), w
    return _layouts[size]


def _strings(codes: np.ndarray, counts: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs of codes, each of which follows a clear, and how many bytes each run has."""
    kind = np.int32 if len(codes) < 1 << 19 else np.int64  # a string has at most as many bytes as there are codes in the table
    codes, n = codes.astype(kind), np.arange(len(codes), dtype=kind)
    first = np.repeat((np.cumsum(counts) - counts).astype(kind), counts)
    long = codes >= alphabet + 2
    if ((codes == alphabet) | (codes == alphabet + 1)).any():
        raise ValueError("a code stream has a code out of place")
    parent = np.where(long, first + codes - alphabet - 2, n)
    if (parent[long] >= n[long]).any():
        raise ValueError("a code stream has a code before its entry")
    up, steps = parent.copy(), long.astype(kind)
    while (more := steps[up]).any():  # lengths are depths below a code of the alphabet
        steps = steps + more
        up = up[up]
    length = steps + 1
    ends = np.cumsum(length, dtype=kind)
    starts = ends - length
    source = np.arange(int(ends[-1]) if len(ends) else 0, dtype=kind)
    inner = np.repeat(long, length)
    source[inner] += np.repeat((starts[parent] - starts)[long], length[long])
    while True:
        again = source[source]
        if np.array_equal(again, source):
            break
        source = again
    value = np.zeros(len(source), np.uint8)
    value[starts[~long]] = codes[~long]
    per_run = np.add.reduceat(length, np.cumsum(counts) - counts) if len(codes) else np.zeros(len(counts), np.int64)
    return value[source], per_run


#: Codes looked at together, over all streams.
CODES_AT_ONCE = 1 << 20


def lzw_decode(data: bytes, size: int, n_pixels: int) -> np.ndarray:
    """The pixels of a GIF code stream with a minimum code size."""
    return lzw_decode_all([data], size, n_pixels)[0]


def lzw_decode_all(streams: list[bytes], size: int, n_pixels: int) -> np.ndarray:
    """(streams x pixels): streams that hold as many pixels each are decoded side by side, from one clear to the next."""
    offsets, widths = _offsets(size)
    clear = 1 << size
    joined = b"".join([*streams, b"\0" * 8])
    kind = np.int32 if len(joined) < 1 << 27 else np.int64
    raw = np.frombuffer(joined, np.uint8).astype(np.uint32)
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    lengths = np.array([len(s) for s in streams], np.int64)
    ends = 8 * np.cumsum(lengths)
    bit, have = ends - 8 * lengths, np.zeros(len(streams), np.int64)
    out = np.zeros((len(streams), n_pixels), np.uint8)
    active, look = np.arange(len(streams)), 1024

    def codes(at: np.ndarray, w: np.ndarray) -> np.ndarray:
        return three[np.minimum(at >> 3, len(three) - 1)] >> (at & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)

    while len(active):
        rows = active[: max(1, CODES_AT_ONCE // look)]
        lead = codes(bit[rows], widths[:1]) == clear
        while lead.any():  # clears in a row
            bit[rows[lead]] += size + 1
            lead = (codes(bit[rows], widths[:1]) == clear) & (bit[rows] < ends[rows])
        n = min(look, len(offsets), int(n_pixels - have[rows].min()) + 1)
        got = codes(bit[rows].astype(kind)[:, None] + offsets[:n].astype(kind), widths[:n])
        room = np.searchsorted(offsets[:n] + widths[:n], ends[rows] - bit[rows], side="right")  # codes that the stream still holds
        ends_run = (got == clear) | (got == clear + 1)
        stop = np.minimum(np.where(ends_run.any(axis=1), ends_run.argmax(axis=1), n), room)
        if ((stop == n) & (n < n_pixels - have[rows] + 1)).any():
            if n == len(offsets):
                raise ValueError("a code stream has no clear for too long")
            look *= 4
            continue
        some = stop > 0
        value, filled = _strings(got[np.arange(n) < stop[:, None]], stop[some], clear)
        keep = np.zeros(len(rows), np.int64)
        keep[some] = np.minimum(filled, n_pixels - have[rows[some]])
        at = 0
        for k, size_k in zip(np.flatnonzero(some).tolist(), filled.tolist()):
            r = rows[k]
            out[r, have[r] : have[r] + keep[k]] = value[at : at + keep[k]]
            at += size_k
        have[rows] += keep
        seen = np.minimum(stop, n - 1)
        over = (stop >= room) | (got[np.arange(len(rows)), seen] == clear + 1) | (have[rows] >= n_pixels)
        if (have[rows[over]] < n_pixels).any():
            raise ValueError("a code stream ends before its frame")
        bit[rows] += offsets[seen] + widths[seen]
        active = np.concatenate((rows[~over], active[len(rows) :]))
    return out


@dataclass
class Frame:
    start: int  # hundredths of a second since the first frame
    delay: int
    indices: np.ndarray  # of the image itself
    canvas: np.ndarray  # height x width x 4, after the image is drawn


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


#: Images whose streams are decoded together.
IMAGES_AT_ONCE = 1024


@dataclass
class _Image:
    place: tuple[int, int, int, int]
    interlaced: bool
    colours: np.ndarray | None
    size: int
    stream: bytes
    delay: int
    dispose: int
    clear_index: int | None
    indices: np.ndarray | None = None


def _images(data: bytes, at: int, palette: np.ndarray | None) -> Iterator[_Image]:
    delay, dispose, clear_index = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9:
                control, delay, index = struct.unpack_from("<BHB", block)
                dispose, clear_index = control >> 2 & 7, index if control & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("the GIF has an unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if local & 0x80:
            colours = np.frombuffer(data, np.uint8, 3 << (local & 7) + 1, at).reshape(-1, 3)
            at += colours.size
        size = data[at]
        if not 1 <= size <= 8:
            raise ValueError("the GIF has a code size out of range")
        stream, at = _blocks(data, at + 1)
        yield _Image((left, top, w, h), bool(local & 0x40), colours, size, stream, delay, dispose, clear_index)
        delay, dispose, clear_index = 0, 0, None


def _decode_images(images: list[_Image]) -> None:
    alike: dict[tuple, list[_Image]] = {}
    for image in images:
        alike.setdefault((image.size, *image.place[2:]), []).append(image)
    for (size, w, h), group in alike.items():
        for image, pixels in zip(group, lzw_decode_all([i.stream for i in group], size, w * h)):
            image.indices = pixels.reshape(h, w)
            if image.interlaced:
                order = np.concatenate([np.arange(a, h, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                image.indices = np.empty_like(image.indices)
                image.indices[order] = pixels.reshape(h, w)


def _header(data: bytes) -> tuple[int, int, int, np.ndarray | None]:
    """Width, height, where the blocks begin, and the global palette."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if not flags & 0x80:
        return width, height, 13, None
    palette = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, 13).reshape(-1, 3)
    return width, height, 13 + palette.size, palette


def _alone(image: _Image, width: int, height: int) -> bool:
    """Whether the image covers the canvas with nothing clear, so that its canvas depends on no other."""
    return image.place[:2] == (0, 0) and image.place[2] >= width and image.place[3] >= height and image.clear_index is None and image.dispose != 3


class Canvas:
    """The canvas of a GIF, drawn image by image in order."""

    def __init__(self, width: int, height: int):
        self.now = np.zeros((height, width, 4), np.uint8)

    def draw(self, images: list[_Image]) -> np.ndarray:
        """images x height x width x 4: the canvas after each image is drawn. Then the image's disposal takes place."""
        height, width = self.now.shape[:2]
        if any(i.colours is None for i in images):
            raise ValueError("the GIF has no palette")
        if all(_alone(i, width, height) and i.colours is images[0].colours for i in images):
            opaque = np.full((256, 4), 255, np.uint8)
            opaque[:, :3] = images[0].colours[np.minimum(np.arange(256), len(images[0].colours) - 1)]
            indices = np.stack([i.indices[:height, :width] for i in images])
            out = opaque.view(np.uint32).ravel()[indices].view(np.uint8).reshape(*indices.shape, 4)
            self.now = np.zeros_like(self.now) if images[-1].dispose == 2 else out[-1].copy()
            return out
        out = np.empty((len(images), height, width, 4), np.uint8)
        for k, image in enumerate(images):
            left, top, w, h = image.place
            area = (slice(top, top + h), slice(left, left + w))
            before = self.now.copy()
            fit_h, fit_w = self.now[area].shape[:2]
            part = image.indices[:fit_h, :fit_w]
            seen = np.ones(part.shape, bool) if image.clear_index is None else part != image.clear_index
            drawn = np.concatenate((image.colours[np.minimum(part, len(image.colours) - 1)], np.full((*part.shape, 1), 255, np.uint8)), axis=2)
            self.now[area][seen] = drawn[seen]
            out[k] = self.now
            if image.dispose == 2:
                self.now[area] = 0
            elif image.dispose == 3:
                self.now = before
        return out


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order."""
    try:
        width, height, at, palette = _header(data)
        clock, canvas, images = 0, Canvas(width, height), _images(data, at, palette)
        while some := list(islice(images, IMAGES_AT_ONCE)):
            _decode_images(some)
            for image, shown in zip(some, canvas.draw(some)):
                yield Frame(clock, image.delay, image.indices, shown)
                clock += image.delay
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e


def colour_histograms(canvases: np.ndarray) -> np.ndarray:
    """Canvases x 64: pixels of each canvas in each of 4 x 4 x 4 colours; what is transparent counts nowhere."""
    high = canvases >> 6
    colour = (high[..., 0] << 4 | high[..., 1] << 2 | high[..., 2]).reshape(len(canvases), -1).astype(np.int64)
    colour += 64 * np.arange(len(canvases))[:, None]
    return np.bincount(colour[canvases[..., 3].reshape(colour.shape) > 0], minlength=64 * len(canvases)).reshape(-1, 64)


def colour_histogram(frame: Frame) -> np.ndarray:
    """``colour_histograms`` of one frame."""
    return colour_histograms(frame.canvas[None])[0]


@dataclass
class Timed:
    """The frames of a GIF: all stored samples, and start, delay (hundredths of a second) and colour histogram of each frame."""

    samples: bytes
    start: np.ndarray
    delay: np.ndarray
    histograms: np.ndarray


def read_timed(blobs: list[bytes]) -> list[Timed | None]:
    """The frames of each GIF, or None where it is damaged or empty; code streams of all GIFs are decoded together."""
    found: list[list[_Image] | None] = []
    for blob in blobs:
        try:
            _, _, at, palette = _header(blob)
            found.append(list(_images(blob, at, palette)))
        except (ValueError, IndexError, struct.error):
            found.append(None)
    try:
        _decode_images([i for images in found for i in images or ()])
    except ValueError:  # one by one, to tell which
        for k, images in enumerate(found):
            try:
                _decode_images(images or [])
            except ValueError:
                found[k] = None
    return [_timed(blob, images) for blob, images in zip(blobs, found)]


def _timed(blob: bytes, images: list[_Image] | None) -> Timed | None:
    if not images:
        return None
    canvas = Canvas(*_header(blob)[:2])
    try:
        histograms = np.concatenate([colour_histograms(canvas.draw(images[i : i + IMAGES_AT_ONCE])) for i in range(0, len(images), IMAGES_AT_ONCE)])
    except ValueError:
        return None
    delay = np.array([i.delay for i in images], np.int64)
    return Timed(b"".join([i.indices.tobytes() for i in images]), np.cumsum(delay) - delay, delay, histograms)


def frame_table(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per frame: the other columns, frame, start_cs, delay_cs, width, height, rgba (binary), histogram (64 longs). Damaged media give no row."""
    keys = [c for c in media.columns if c not in (column, "frame", "start_cs", "delay_cs", "width", "height", "rgba", "histogram")]
    schema = T.StructType(list(media.select(*keys).schema.fields))
    for name, kind in (("frame", T.IntegerType()), ("start_cs", T.LongType()), ("delay_cs", T.LongType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("rgba", T.BinaryType()), ("histogram", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(b.schema.get_field_index(column)).to_pylist()
            for i, blob in enumerate(blobs):
                rows = []
                try:
                    for k, f in enumerate(decode_gif(blob or b"")):
                        rows.append((k, f.start, f.delay, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), colour_histogram(f).tolist()))
                except ValueError:
                    continue
                if rows:
                    own = b.select(keys).take(pa.array([i] * len(rows)))
                    made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *made], [f.name for f in schema.fields])

    return media.mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for raw in _together([(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(raw)), pa.array(map(len, raw), pa.int64()), pa.array(encode_gifs([pad_payload(r) for r in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(raw)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = {
    "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "frames": T.IntegerType(), "duration_cs": T.LongType(),
    "timed": T.ArrayType(T.StructType().add("start_cs", "long").add("delay_cs", "integer").add("colours", T.ArrayType(T.StructType().add("colour", "byte").add("pixels", "integer")))),
    "histogram": T.ArrayType(T.LongType()), "feature": T.StringType(),
}


def _timed_column(found: list[Timed | None]) -> pa.Array:
    """Each GIF's frames: their start, delay, and the colours that their canvas has with the number of pixels."""
    known = [t for t in found if t]
    none = np.zeros((0, 64), np.int64)
    histograms = np.concatenate([none, *(t.histograms for t in known)])
    of, colour = np.nonzero(histograms)
    pairs = pa.StructArray.from_arrays([pa.array(colour, pa.int8()), pa.array(histograms[of, colour], pa.int32())], ["colour", "pixels"])
    colours = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(histograms) + 1)), pa.int32()), pairs)
    start, delay = (np.concatenate([none[0:0, 0], *(getattr(t, name) for t in known)]) for name in ("start", "delay"))
    frames = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(delay, pa.int32()), colours], ["start_cs", "delay_cs", "colours"])
    ends = np.cumsum([0, *(len(t.start) if t else 0 for t in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), frames, mask=pa.array([t is None for t in found]))


def _digest(t: Timed) -> str:
    """Times and canvases' colours of all frames."""
    return hashlib.md5(np.column_stack((t.start, t.delay, t.histograms)).astype("<i8").tobytes()).hexdigest()


#: Bytes of texts, or of media, looked at together.
BYTES_AT_ONCE = 1 << 21


def _together(blobs: list[bytes]) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    held = 0
    for blob in blobs:
        if some and held + len(blob) > BYTES_AT_ONCE:
            yield some
            some, held = [], 0
        some.append(blob)
        held += len(blob)
    if some:
        yield some


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the columns but media itself, and FEATURES: payload from the stored samples, digests, timed frames with the colours of their canvases, the sum of those, and a digest of times and colours."""
    schema = T.StructType([f for f in media.select("doc_id", "n_bytes").schema.fields] + [T.StructField(n, t) for n, t in FEATURES.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in _together([m or b"" for m in b.column("media").to_pylist()]):
                found = read_timed(some)
                rows = [
                    (len(t.samples), hashlib.sha256(t.samples).hexdigest(), zlib.crc32(t.samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), len(t.start), int(t.delay.sum())) if t else (None,) * 7
                    for m, t in zip(some, found)
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64())
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                made += [_timed_column(found), pa.array([t and t.histograms.sum(axis=0).tolist() for t in found], pa.list_(pa.int64())), pa.array([t and _digest(t) for t in found], pa.string())]
                own = b.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *made], schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
