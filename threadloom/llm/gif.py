"""Media columns: GIF images in binary columns, decoded to timed frames with colour histograms.

The decoder reads the LZW code streams, global and local palettes, interlacing, the graphic control's delay, disposal
and transparency, and composes each frame on the canvas as a viewer shows it. The encoder writes frames of palette
indices losslessly. Both work row by row within Spark tasks, so there is no shuffle and memory is bounded by one image.

Defined results: a null image has no frames; a damaged one raises ValueError that says what is wrong; a null text is
empty, and its payload is 192 blanks; texts of any length become as many frames as they need.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payloads are stored in rows of so many samples, and at most so many rows a frame, each frame shown so long.
ROW, ROWS, DELAY_CS = 192, 255, 10
MAX_BITS = 12
GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    """A frame as stored: palette indices (height x width) and how to show them. disposal: 0 or 1 keep, 2 clear, 3 restore."""

    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay_cs: int = DELAY_CS
    disposal: int = 1
    transparent: int | None = None
    palette: bytes | None = None
    interlaced: bool = False


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of each of the n codes that follow a clear code: one more when the table that a decoder has then fills the width."""
    # a decoder ends an entry only when it has read the next code, so it has one less than codes
    size = np.minimum((1 << bits) + 1 + np.arange(n), (1 << MAX_BITS) - 1)
    return np.maximum(np.ceil(np.log2(size + 1)).astype(np.int64), bits + 1)


_schedules: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For codes after a clear code, until the table is full: their widths, and the bits before each."""
    if bits not in _schedules:
        widths = _widths((1 << MAX_BITS) - (1 << bits), bits)
        _schedules[bits] = widths, np.concatenate([[0], np.cumsum(widths)])
    return _schedules[bits]


def lzw_encode(data: bytes, bits: int) -> bytes:
    """The code stream of data, whose bytes are under 2**bits: clear, codes, end; cleared again each time the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    # codes are held shifted by a byte, so that a code and the next byte make a key
    full, step = 1 << MAX_BITS + 8, 1 << 8
    size, cur = end + 1 << 8, data[0] << 8 if data else 0
    find, emit = table.get, codes.append
    for b in data[1:]:
        key = cur | b
        code = find(key)
        if code is not None:
            cur = code
            continue
        emit(cur)
        cur = b << 8
        if size < full:
            table[key] = size
            size += step
        else:
            emit(clear << 8)
            runs.append(codes)
            codes, table, size = [], {}, end + 1 << 8
            find, emit = table.get, codes.append
    if data:
        emit(cur)
    emit(end << 8)
    runs.append(codes)
    widths = _schedule(bits)[0]
    flat = np.concatenate([np.array([clear]), *(np.array(r) >> 8 for r in runs)]).astype(np.uint16)
    wide = np.concatenate([np.array([bits + 1]), *(widths[: len(r)] if len(r) <= len(widths) else np.append(widths, np.full(len(r) - len(widths), MAX_BITS)) for r in runs)])
    places = np.arange(MAX_BITS, dtype=np.uint16)
    return np.packbits(((flat[:, None] >> places) & 1).astype(bool)[places < wide[:, None]], bitorder="little").tobytes()


def _codes(stream: np.ndarray, at: int, bits: int, most: int) -> np.ndarray:
    """The codes from bit at on, as wide as they are until the next clear code; at most so many after the table is full."""
    widths, before = _schedule(bits)
    left = len(stream) * 8 - at - 24
    n = int(np.searchsorted(before[1:], left, side="right"))
    more = max(0, (left - int(before[-1])) // MAX_BITS) if n == len(widths) else 0
    where = at + np.concatenate([before[:n], before[-1] + MAX_BITS * np.arange(min(more, most))])
    wide = np.concatenate([widths[:n], np.full(len(where) - n, MAX_BITS)])
    byte = where >> 3
    word = stream[byte].astype(np.int64) | stream[byte + 1].astype(np.int64) << 8 | stream[byte + 2].astype(np.int64) << 16
    return word >> (where & 7) & ((1 << wide) - 1)


def lzw_decode(stream: bytes, bits: int, count: int) -> bytes:
    """The first count bytes of a code stream. Streams may go on with a full table, clear it at any time, or lack the end code."""
    clear, end = 1 << bits, (1 << bits) + 1
    widths, before = _schedule(bits)
    room = np.frombuffer(stream + b"\0" * 6, dtype=np.uint8)
    out: list[bytes] = []
    got, at, total = 0, 0, len(stream) * 8
    while got < count and at < total:
        most = 65_536
        while True:
            codes = _codes(room, at, bits, most)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or len(codes) < len(widths) + most:
                break
            # a table kept for longer than was read
            most *= 4
        n = int(stop[0]) if len(stop) else len(codes)
        if n:
            out.append(_expand(codes[:n], clear))
            got += len(out[-1])
        if not len(stop) or codes[n] == end:
            break
        at += int(before[n + 1]) if n < len(widths) else int(before[-1]) + MAX_BITS * (n + 1 - len(widths))
    data = b"".join(out)
    if len(data) < count:
        raise ValueError(f"the image data end after {len(data)} of {count} samples")
    return data[:count]


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """The bytes of the codes between two clear codes.

    The table's entry k is what the k-th code stands for and one byte more, so it lies in the output where that code's bytes
    begin. Codes thus point to earlier codes: chains of pointers, halved again and again, give first the lengths and then,
    for each byte, the byte that a colour code put there.
    """
    n, first = len(codes), clear + 2
    back = codes - first
    literal = back < 0
    if codes[0] >= clear or (back >= np.arange(n)).any() or (back >= (1 << MAX_BITS) - first).any() or (literal & (codes >= clear)).any():
        raise ValueError("a code isn't in the table yet")
    parent = np.where(literal, np.arange(n), back)
    length, jump = np.where(literal, 0, 1), parent
    while length[jump].any():
        length, jump = length + length[jump], jump[jump]
    length = length + 1
    ends = np.cumsum(length)
    begins = ends - length
    source = np.arange(int(ends[-1])) - np.repeat(begins - begins[parent], length)
    while (source != (further := source[source])).any():
        source = further
    colour = np.zeros(int(ends[-1]), np.uint8)
    colour[begins[literal]] = codes[literal]
    return colour[source].tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[Frame], width: int, height: int, palette: bytes = GREY, background: int = 0) -> bytes:
    """A GIF89a file. palette: 3 bytes a colour, of 2 to 256 colours, a power of two."""
    depth = (len(palette) // 3 - 1).bit_length()
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | depth - 1, background, 0), palette]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", flags, f.delay_cs, f.transparent or 0, 0))
        rows, cols = f.indices.shape
        local = f.palette
        packed = (0x80 | (len(local) // 3 - 1).bit_length() - 1 if local else 0) | 0x40 * f.interlaced
        out.append(b"," + struct.pack("<HHHHB", f.left, f.top, cols, rows, packed) + (local or b""))
        bits = max(2, (len(local or palette) // 3 - 1).bit_length())
        shown = f.indices[_interlace(rows)] if f.interlaced else f.indices
        out.append(bytes([bits]) + _blocks(lzw_encode(shown.astype(np.uint8).tobytes(), bits)))
    return b"".join([*out, b";"])


def _interlace(rows: int) -> np.ndarray:
    """The order in which an interlaced image stores its rows: every 8th, the 8ths between, the 4ths between, the odd ones."""
    return np.concatenate([np.arange(0, rows, 8), np.arange(4, rows, 8), np.arange(2, rows, 4), np.arange(1, rows, 2)])


def stored_frames(data: bytes) -> tuple[int, int, bytes, list[Frame]]:
    """The screen's width and height, its palette, and the frames as they are stored."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, b""
    if flags & 0x80:
        palette, at = data[13 : 13 + (6 << (flags & 7))], 13 + (6 << (flags & 7))
    frames: list[Frame] = []
    control = (0, 0, None)
    try:
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                if data[at + 1] == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                    control = packed >> 2 & 7, delay, index if packed & 1 else None
                at += 2
                while data[at]:
                    at += data[at] + 1
                at += 1
            elif kind == 0x2C:
                left, top, cols, rows, packed = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                local = None
                if packed & 0x80:
                    local, at = data[at : at + (6 << (packed & 7))], at + (6 << (packed & 7))
                bits, at, parts = data[at], at + 1, []
                while data[at]:
                    parts.append(data[at + 1 : at + 1 + data[at]])
                    at += data[at] + 1
                at += 1
                indices = np.frombuffer(lzw_decode(b"".join(parts), bits, rows * cols), dtype=np.uint8).reshape(rows, cols)
                if packed & 0x40:
                    straight = np.empty_like(indices)
                    straight[_interlace(rows)] = indices
                    indices = straight
                frames.append(Frame(indices, left, top, control[1], control[0], control[2], local, bool(packed & 0x40)))
                control = (0, 0, None)
            else:
                raise ValueError(f"unknown block {kind}")
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e
    return width, height, palette, frames


def shown_frames(data: bytes) -> Iterator[tuple[int, int, Frame, np.ndarray]]:
    """For each frame: when it begins and how long it lasts (ms), the frame, and the canvas (height x width x RGBA) while it shows."""
    width, height, palette, frames = stored_frames(data)
    canvas = np.zeros((height, width, 4), np.uint8)
    began = 0
    for f in frames:
        colours = np.frombuffer(f.palette or palette, np.uint8).reshape(-1, 3)
        rows, cols = min(f.indices.shape[0], max(0, height - f.top)), min(f.indices.shape[1], max(0, width - f.left))
        indices = f.indices[:rows, :cols]
        if indices.size and int(indices.max()) >= len(colours):
            raise ValueError("a sample is beyond the palette")
        spot = (slice(f.top, f.top + rows), slice(f.left, f.left + cols))
        before = canvas[spot].copy() if f.disposal == 3 else None
        image = np.full((rows, cols, 4), 255, np.uint8)
        image[:, :, :3] = colours[indices]
        if f.transparent is None:
            canvas[spot] = image
        else:
            opaque = indices != f.transparent
            canvas[spot][opaque] = image[opaque]
        yield began, f.delay_cs * 10, f, canvas.copy()
        began += f.delay_cs * 10
        if f.disposal == 2:
            canvas[spot] = 0
        elif f.disposal == 3:
            canvas[spot] = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour: 4 levels each of red, green and blue, 64 counts; transparent pixels don't count."""
    level = canvas[:, :, 0] >> 6 << 4 | canvas[:, :, 1] >> 6 << 2 | canvas[:, :, 2] >> 6
    seen = canvas[:, :, 3] > 0
    return np.bincount(level.ravel() if seen.all() else level[seen], minlength=64)


FRAME = "struct<frame:int,begins_ms:long,lasts_ms:long,width:int,height:int,rgba:binary,colours:array<long>>"


def frames(images: DataFrame, image: str = "image") -> DataFrame:
    """One row for each frame of each image, beside the image's other columns: frame number, times, size, RGBA pixels and 64 colour counts."""

    @F.pandas_udf(f"array<{FRAME}>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[] if data is None else [
                {"frame": i, "begins_ms": began, "lasts_ms": lasts, "width": canvas.shape[1], "height": canvas.shape[0], "rgba": canvas.tobytes(), "colours": histogram(canvas).tolist()}
                for i, (began, lasts, _, canvas) in enumerate(shown_frames(data))
            ] for data in batch])

    return images.withColumn("frame", F.explode(decode(F.col(image))))


def payload(text: str | None) -> bytes:
    """The text's UTF-8 with blanks up to a positive multiple of the row length."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def store(data: bytes) -> bytes:
    """A grey GIF whose samples, row by row and frame by frame, are the payload's bytes."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    return encode_gif([Frame(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS)], ROW, min(ROWS, len(samples)))


def read_back(media: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """The payload as the shown frames have it, the colour counts over all frames, the number of frames and the time they take."""
    parts, colours, n, ends = [], np.zeros(64, np.int64), 0, 0
    for began, lasts, f, canvas in shown_frames(media):
        part = canvas[f.top : f.top + f.indices.shape[0]]
        parts.append(part[:, :, 0].tobytes())
        colours += histogram(part)
        n, ends = n + 1, began + lasts
    return b"".join(parts), colours, n, ends


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: Column) -> Column:
    """Stores each text as a GIF, reads it back, and says what was read."""

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                media = store(payload(text))
                data, colours, n, ends = read_back(media)
                grey = "-".join(str(colours[i * 21]) for i in range(4))
                rows.append((len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={n};ms={ends};grey={grey}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return run(text)


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id and what reading the stored form of every document gives back."""
    return docs.select("doc_id", digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")
