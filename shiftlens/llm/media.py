"""Media columns: GIF images as binary columns.

`decode` reads a whole GIF stream: LZW code streams, global and local palettes, interlace, transparency
and the disposal rules, giving timed frames on the logical screen. `encode` writes 8-bit grey samples
without loss: LZW with its string table, a palette of each frame's own colours (so that codes are as narrow as these allow),
transparent pixels where a frame mostly shows what was there before, and the disposal that this asks for. `gif_frames`
explodes a binary column into a row per frame with its time and a colour histogram; `store_texts` is the payload round trip over
documents.

Defined cases: null text or null media counts as empty; an empty text is one row of spaces; a stream that
is not a whole GIF, has no colour table or a screen of more than MOST_PIXELS gives no frames (its error is in the row); rows
without doc_id are left out; repeated rows are handled each; equal texts give equal values. Samples over the last colour
(with code sizes over 8 also over a byte) show the last colour.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, ragged, texts, with_id

WIDTH, HEIGHT, DELAY = 192, 128, 4
#: Pixels of a screen or frame that decode accepts, and the limit of a table of codes (fixed by the format).
MOST_PIXELS, CODES = 1 << 26, 4096
#: Samples whose places the decoder looks up at a time, and codes that are packed at a time.
STEP = 1 << 18


def _blocks(stream: bytes) -> bytes:
    """Split into sub-blocks of 255 bytes with a terminator."""
    out = bytearray()
    whole = len(stream) // 255 * 255
    if whole:
        body = np.frombuffer(stream, np.uint8, whole).reshape(-1, 255)
        out += np.hstack([np.full((len(body), 1), 255, np.uint8), body]).tobytes()
    if rest := stream[whole:]:
        out += bytes([len(rest)]) + rest
    return bytes(out) + b"\0"


def lzw_encode(samples: bytes, code_size: int) -> bytes:
    """The LZW stream of samples under 1 << code_size. The table is cleared when it is full."""
    # The loop runs once a sample. Codes in it are shifted by code_size, so that code + sample is the key of an entry, and the key of
    # the entry that a code makes holds that code: one list has both.
    size = 1 << code_size
    first, full = size + 2 << code_size, CODES << code_size
    keys, cuts, table, free = [], [0], {}, first
    keep = keys.append
    rest = iter(samples)
    last = next(rest, -1) << code_size
    for value in rest:
        key = last + value
        if key in table:
            last = table[key]
            continue
        keep(key)
        if free < full:
            table[key] = free
            free += size
        else:
            cuts.append(len(keys))
            table, free = {}, first
        last = value * size
    if last >= 0:
        keep(last)
    codes = np.array(keys, np.uint32) >> np.uint32(code_size)
    lives = [codes[at:to] for at, to in zip(cuts, [*cuts[1:], len(codes)])]
    # A code is as wide as the table asks for that the decoder has by then; that follows from its place in the table's life.
    width = _plan(code_size)[0]
    widths = [width[:1], *(width[: len(life) + 1] for life in lives)]
    clear, end = np.array([size], np.uint32), np.array([size + 1], np.uint32)
    ends = [clear] * (len(lives) - 1) + [end]
    return _packed(np.concatenate([clear, *(part for pair in zip(lives, ends) for part in pair)]), np.concatenate(widths))


def _widths(n: int, code_size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: the first adds no entry, each later one adds one."""
    entries = (1 << code_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(code_size + 1, np.ceil(np.log2(entries + 1)).astype(np.int64)), 12)


@cache
def _plan(code_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code until the table is full, and where each begins, the end included."""
    widths = _widths(CODES, code_size)
    return widths, np.append(0, np.cumsum(widths))


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of the given widths, least bit first."""
    end = np.cumsum(widths)
    out = np.zeros((int(end[-1]) >> 3) + 4, np.uint8)
    for at in range(0, len(values), STEP):
        place = end[at : at + STEP] - widths[at : at + STEP]
        low = int(place[0]) >> 3
        byte, shifted = (place >> 3) - low, values[at : at + STEP].astype(np.int64) << (place & 7)
        for k in range(3):  # values of 12 bits touch at most three bytes; bits of different values never meet, so sums are unions
            part = np.bincount(byte + k, shifted >> 8 * k & 255).astype(np.uint8)
            out[low : low + len(part)] += part
    return out[: (int(end[-1]) + 7) >> 3].tobytes()


def _strings(codes: np.ndarray, code_size: int, most: int) -> np.ndarray:
    """Samples that the codes of a table's life stand for, `most` of them at most. An entry is the string of an earlier code and the
    first sample behind it: the last sample of a string is known by its code, all others are where that earlier code wrote them.
    Links are followed by doubling, so that a string of n samples takes as many steps as n has binary digits."""
    place = np.arange(len(codes))
    entry = codes - ((1 << code_size) + 2)
    if (entry >= place).any():
        raise ValueError("code beyond the table")
    plain = entry < 0
    parent, links = np.where(plain, place, entry), np.where(plain, 0, 1)
    link = parent
    while (more := links[link]).any():
        links, link = links + more, link[link]
    length = links + 1
    end = np.cumsum(length)
    start = end - length
    n = min(len(codes), int(np.searchsorted(end, most)) + 1)
    first = codes[link]
    last = np.where(plain, codes, first[np.where(plain, 0, entry + 1)])
    origin = start[parent]
    out = np.zeros(int(end[n - 1]), np.uint8 if code_size <= 8 else np.uint16)
    out[end[:n] - 1] = last[:n]
    at = 0
    while at < n:  # by places of about STEP samples
        to = min(n, max(at + 1, int(np.searchsorted(end, start[at] + STEP, "right"))))
        low, ends, lengths = int(start[at]), end[at:to] - 1, length[at:to]
        source = ragged(origin[at:to], lengths)
        source[ends - low] = ends
        for _ in range(int(lengths.max() - 1).bit_length()):
            source = np.where(source < low, source, source.take(source - low, mode="clip")) if low else source[source]
        out[low : end[to - 1]] = out[source]
        at = to
    return out[:most]


def lzw_decode(stream: bytes, code_size: int, expected: int) -> np.ndarray:
    """Samples of an LZW code stream. Code widths follow from the number of codes since the last clear code, so codes are read
    in bulk up to the next clear or end code, and so are the strings that they stand for."""
    if not 1 <= code_size <= 11:
        raise ValueError("code size")
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int32)
    data = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    clear, end, bits = 1 << code_size, (1 << code_size) + 1, 8 * len(stream)
    parts, filled, at, done = [np.zeros(0, np.uint8)], 0, 0, False
    while not done and filled < expected and at + code_size + 1 <= bits:
        blocks, cut, (widths, steps) = [], None, _plan(code_size)
        while cut is None:
            n = min(int(np.searchsorted(steps, bits - at, "right")) - 1, len(steps) - 1)
            place = at + steps[:n]
            codes = data[place >> 3] >> (place & 7) & (1 << widths[:n]) - 1
            stop = np.flatnonzero(codes >> 1 == clear >> 1)
            cut = int(stop[0]) if len(stop) else None
            blocks.append(codes[:cut])
            if cut is not None:
                done = codes[cut] == end
                at += int(steps[cut + 1])
            elif n < len(steps) - 1:
                cut, done = n, True
            else:  # the table is full, and stays so until a clear code
                at += int(steps[-1])
                widths, steps = np.full(1 << 16, 12), np.arange(0, 12 * (1 << 16) + 1, 12)
        codes = np.concatenate(blocks)
        if not len(codes):
            continue
        parts.append(_strings(codes, code_size, expected - filled))
        filled += len(parts[-1])
    if filled < expected:
        raise ValueError("stream ends early")
    return np.concatenate(parts)


def _colours(pixels: np.ndarray) -> np.ndarray:
    seen = np.zeros(256, bool)
    seen[pixels] = True
    return np.flatnonzero(seen)


def _palette(frame: np.ndarray, before: np.ndarray | None):
    """The frame's colours in order, whether it leaves out what stays (more than half of it), and the bits of its index."""
    stays = before is not None and 2 * int((frame == before).sum()) > frame.size
    colours = _colours(frame[frame != before] if stays else frame)
    if len(colours) + stays > 256:
        stays, colours = False, _colours(frame)
    return colours, stays, max(1, int(len(colours) + stays - 1).bit_length())


def encode(samples: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """A GIF of grey 8-bit samples: frames of width x height (the last may be lower), each shown for delay/100 s."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, width)
    frames = [pixels[at : at + height] for at in range(0, len(pixels), height)]
    plans = [_palette(f, frames[k - 1][: len(f)] if k else None) for k, f in enumerate(frames)]
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(len(pixels), height), 0x70, 0, 0)]
    for k, (frame, (colours, stays, bits)) in enumerate(zip(frames, plans)):
        # A frame stays (1) under one that leaves pixels out; else the screen is cleared (2).
        disposal = 1 if k + 1 < len(frames) and plans[k + 1][1] else 2
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | stays, delay, len(colours) if stays else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame), 0x80 | (bits - 1)))
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(colours)] = colours[:, None]
        index = np.zeros(256, np.uint8)
        index[colours] = np.arange(len(colours))
        shown = index[frame]
        if stays:
            shown = np.where(frame == frames[k - 1][: len(frame)], np.uint8(len(colours)), shown)
        code_size = max(2, bits)
        out += [table.tobytes(), bytes([code_size]), _blocks(lzw_encode(shown.tobytes(), code_size))]
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def decode(data: bytes) -> list[dict]:
    """Frames of a GIF: start_ms, duration_ms, the box that changed, its samples, and the whole screen (RGB) after drawing."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    at, table = 13, None
    if width * height > MOST_PIXELS:
        raise ValueError("screen too large")
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        table = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
        at += size
    blank = np.zeros((height, width, 3), np.uint8)
    if table is not None and background < len(table):
        blank[:] = table[background]
    screen, frames, clock = blank.copy(), [], 0
    disposal, delay, clear_index = 0, 0, None
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9:
                disposal, delay = (body[0] >> 2) & 7, struct.unpack("<H", body[1:3])[0]
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, flags = struct.unpack("<HHHHB", data[at : at + 9])
        at += 9
        palette = table
        if flags & 0x80:
            size = 3 << ((flags & 7) + 1)
            palette = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
            at += size
        if palette is None:
            raise ValueError("no colour table")
        if w * h > MOST_PIXELS:
            raise ValueError("frame too large")
        code_size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_decode(stream, code_size, w * h).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        box = (slice(y, min(y + h, height)), slice(x, min(x + w, width)))
        inside = samples[: box[0].stop - y, : box[1].stop - x]
        before = screen[box].copy()
        colours = palette.take(inside, axis=0, mode="clip")
        screen[box] = colours if clear_index is None else np.where((inside == clear_index)[..., None], before, colours)
        frames.append({"start_ms": clock, "duration_ms": delay * 10, "box": (x, y, w, h), "samples": samples, "screen": screen.copy(), "transparent": clear_index is not None})
        clock += delay * 10
        if disposal == 2:
            screen[box] = blank[box]
        elif disposal == 3:
            screen[box] = before
        disposal, delay, clear_index = 0, 0, None
    return frames


def histogram(pixels: np.ndarray, bins: int = 8, channels: int = 3) -> np.ndarray:
    """Counts of each channel in `bins` equal ranges."""
    return np.concatenate([np.bincount(pixels[..., c].ravel() // (256 // bins), minlength=bins) for c in range(channels)])


FRAME_SCHEMA = "frame int, start_ms long, duration_ms long, width int, height int, histogram array<long>, error string"


def gif_frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each frame of each GIF: time, size and the colour histogram of the screen; one row with an error for a broken stream."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                try:
                    out = [(name, i, f["start_ms"], f["duration_ms"], f["screen"].shape[1], f["screen"].shape[0], histogram(f["screen"]).tolist(), None) for i, f in enumerate(decode(data or b""))]
                except (ValueError, IndexError, TypeError, MemoryError, struct.error) as error:
                    out = [(name, None, None, None, None, None, None, str(error))]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    fields = [pa.field("frame", pa.int32()), pa.field("start_ms", pa.int64()), pa.field("duration_ms", pa.int64()), pa.field("width", pa.int32()), pa.field("height", pa.int32()), pa.field("histogram", pa.list_(pa.int64())), pa.field("error", pa.string())]
    kind = media.schema[key].dataType.simpleString()
    schema = pa.schema([pa.field(key, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), *fields])
    return media.select(key, column).mapInArrow(rows, f"`{key}` {kind}, {FRAME_SCHEMA}")


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    size = max(1, -(-len(raw) // WIDTH)) * WIDTH
    return raw.ljust(size, b" "), len(raw)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored GIF of each text."""

    def stored(batches):
        for batch in chunks(batches, "text", 2 << 20):
            made = [payload(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return with_id(docs, "doc_id", "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, shown_ms long, kept_frames int, histogram array<long>"


def media_features(stored: DataFrame) -> DataFrame:
    """Read the stored GIFs back from what their screens show: digests of payload and stored form, number and time of the frames, how
    many of them lie on the one before, and a colour histogram over all frames."""

    def read(batches):
        for batch in chunks(batches, "media", 4 << 20):
            rows = []
            for data in batch.column("media").to_pylist():
                frames = decode(data)
                shown = [f["screen"][: f["box"][3], :, 0] for f in frames]
                back = b"".join(s.tobytes() for s in shown)
                colours = sum(histogram(s[..., None], channels=1) for s in shown)
                time = frames[-1]["start_ms"] + frames[-1]["duration_ms"]
                kept = sum(f["transparent"] for f in frames)
                feature = f"{len(frames)}x{time}ms:" + ",".join(map(str, colours))
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), time, kept, colours.tolist()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            names = [part.split()[0] for part in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return stored.mapInArrow(read, FEATURES)


def store_texts(docs: DataFrame) -> DataFrame:
    return media_features(encode_texts(docs))
