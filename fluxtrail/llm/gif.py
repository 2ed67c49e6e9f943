"""GIF as a media column: LZW code streams, palettes, disposal, transparency and timed frames, in numpy.

A reader knows the width of the k-th code after a clear code from k alone, so the codes up to the next clear code are cut
from the bit stream at once. Each code but a literal repeats an earlier stretch of the output plus one symbol; lengths
come from pointer doubling over codes, bytes from pointer doubling over output places. Loops run per clear code and per
frame, never per pixel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH, ROWS = 64, 1024
FRAMES = "media_id long, frame int, start_ms long, delay_ms long, width int, height int, hist_red array<long>, hist_green array<long>, hist_blue array<long>, rgb binary, problem string"
#: What reading a malformed GIF raises.
BROKEN = (ValueError, IndexError, struct.error)


def code_widths(count: int, least: int) -> np.ndarray:
    """Bits of the 0th, 1st, ... code after a clear code, for codes of at least ``least`` + 1 bits."""
    free = (1 << least) + 1 + np.arange(count)
    free[:1] += 1
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, least + 1, 12)


def compress(pixels: bytes, least: int = 8) -> bytes:
    """The LZW code stream of pixel values below 2 ** least, a clear code whenever the table is full."""
    clear = 1 << least
    first = clear + 2
    codes, lengths = [clear], [1]
    known: dict[int, int] = {}
    free, held, begun = first, -1, 1
    put, find = codes.append, known.get
    for pixel in pixels:
        if held < 0:
            held = pixel
            continue
        pair = held << 8 | pixel
        code = find(pair)
        if code is None:
            put(held)
            known[pair] = free
            free += 1
            held = pixel
            if free == 4096:
                put(clear)
                known.clear()
                free = first
                lengths.append(len(codes) - begun)
                begun = len(codes)
        else:
            held = code
    if held >= 0:
        put(held)
    put(clear + 1)
    lengths.append(len(codes) - begun)
    template = code_widths(4096, least)
    bits = np.concatenate([template[:n] for n in lengths])
    table = (np.array(codes, np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(table.astype(bool)[np.arange(12) < bits[:, None]], bitorder="little").tobytes()


def expand(codes: np.ndarray, first: int) -> np.ndarray:
    """The pixels of the codes between two clear codes."""
    own = np.arange(len(codes))
    back = np.where(codes >= first, codes.astype(np.int64) - first, own)  # the earlier code whose output a code repeats
    if (back > own).any() or (codes == first - 1).any() or (codes == first - 2).any():
        raise ValueError("a code stands for nothing yet")
    size, at = (back != own).astype(np.int64), back
    while True:
        size, after = size + size[at], at[at]
        if (after == at).all():
            break
        at = after
    size += 1
    starts = np.cumsum(size) - size
    total = int(size.sum())
    shift = starts - starts[back]
    from_place = np.arange(total) - np.repeat(shift, size)
    while True:
        after = from_place[from_place]
        if (after == from_place).all():
            break
        from_place = after
    values = np.zeros(total, np.uint8)
    literal = back == own
    values[starts[literal]] = codes[literal]
    return values[from_place]


def decompress(stream: bytes, least: int, count: int) -> np.ndarray:
    """The first ``count`` pixels of a code stream; a stream that ends early leaves the rest 0."""
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    clear, first, end = 1 << least, (1 << least) + 2, len(stream) * 8
    most = 4096 - first + 1
    template = code_widths(most, least)
    places = np.concatenate([[0], np.cumsum(template)])
    out, done, at = [], 0, 0

    def cut(begin: int, widths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = int(np.searchsorted(begin + offsets[1:], end, "right"))
        where = begin + offsets[:n]
        return (words[where >> 3] >> (where & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)

    while at < end and done < count:
        codes = cut(at, template, places)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        late = not len(stops) and len(codes) == most
        while late:  # the table is full and stays as it is until a clear code
            more = cut(at + int(places[most]) + 12 * (len(codes) - most), np.full(8192, 12), np.arange(8193) * 12)
            codes = np.concatenate([codes, more])
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            late = not len(stops) and len(more) == 8192
        n = int(stops[0]) if len(stops) else len(codes)
        if n:
            part = expand(codes[:n], first)
            out.append(part)
            done += len(part)
        if not len(stops) or codes[n] == clear + 1:
            break
        at += int(places[n + 1]) if n < most else int(places[most]) + 12 * (n + 1 - most)
    pixels = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return np.pad(pixels[:count], (0, max(0, count - len(pixels))))


def blocks(data: bytes) -> bytes:
    parts = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes([len(p)]) + p for p in parts) + b"\0"


def write_gif(images: list[np.ndarray], palette: np.ndarray, delay_cs: int = 4) -> bytes:
    """An animation of 8-bit index images over one palette; the screen is that of the first image."""
    height, width = images[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for image in images:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, image.shape[1], image.shape[0], 0) + b"\x08" + blocks(compress(image.tobytes())))
    return b"".join(out) + b"\x3b"


def read_gif(data: bytes) -> Iterator[dict]:
    """The frames: left, top, delay_cs, indices (of the frame's own rectangle) and rgba (the whole screen as shown)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << (bits & 7)
        colours = np.zeros((256, 3), np.uint8)
        colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    def chain() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        common = palette(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            at += 2
            body = chain()
            if kind == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("neither an extension nor an image")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette(bits) if bits & 0x80 else common
        if colours is None:
            raise ValueError("an image without a palette")
        least = data[at]
        at += 1
        indices = decompress(chain(), least, w * h).reshape(h, w)
        if bits & 0x40:  # interlaced: every 8th row, those between, ...
            order = np.concatenate([np.arange(*p) for p in ((0, h, 8), (4, h, 8), (2, h, 4), (1, h, 2))])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        inside = indices[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + h, left : left + w]
        shown = np.ones(inside.shape, bool) if clear_index is None else inside != clear_index
        area[shown, :3] = colours[inside[shown]]
        area[shown, 3] = 255
        yield {"left": left, "top": top, "delay_cs": delay, "indices": indices, "rgba": canvas.copy()}
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear_index = 0, 0, None


def histogram(rgba: np.ndarray, bins: int = 16) -> list[list[int]]:
    """Counts of the shown pixels by value range, for red, green and blue."""
    shown = rgba[rgba[..., 3] > 0]
    return [np.bincount(shown[:, c] // (256 // bins), minlength=bins).tolist() for c in range(3)]


def frames(media: DataFrame, keep_pixels: bool = True) -> DataFrame:
    """A row per timed frame of media(media_id, media): place in time, size, a histogram column per colour, pixels.

    Null or empty media have no frames; repeated rows give repeated frames. Bytes that are no GIF, or end within a frame,
    give the frames before and then one row that has nothing but ``media_id`` and, as ``problem``, the reason.
    """
    small_batches(media.sparkSession, 64)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch["media_id"], batch["media"], strict=True):
                start, columns = 0, [x.split()[0] for x in FRAMES.split(", ")]
                try:
                    for k, frame in enumerate(read_gif(bytes(data)) if data else ()):
                        shown = frame["rgba"]
                        row = [key, k, start, frame["delay_cs"] * 10, shown.shape[1], shown.shape[0], *histogram(shown), shown[..., :3].tobytes() if keep_pixels else None, None]
                        yield pd.DataFrame([row], columns=columns)
                        start += frame["delay_cs"] * 10
                except BROKEN as error:
                    yield pd.DataFrame([[key, *[None] * (len(columns) - 2), str(error) or type(error).__name__]], columns=columns)

    return media.select("media_id", "media").mapInPandas(decode, FRAMES)


def store(texts: DataFrame) -> DataFrame:
    """media_id, n_bytes, media of texts(media_id, text): the text's UTF-8 bytes, with bytes 0 up to a positive multiple
    of 64, as grey pixels 64 wide, in frames of at most 1024 rows. A null text is empty; equal texts have equal media."""
    small_batches(texts.sparkSession)
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sizes, media, held = [], [], [], 0
            for key, payload in zip(batch["media_id"], batch["payload"], strict=True):
                n = len(payload)
                padded = np.frombuffer(bytes(payload) + bytes(-n % WIDTH if n else WIDTH), np.uint8).reshape(-1, WIDTH)
                keys.append(key)
                sizes.append(n)
                media.append(write_gif([padded[i : i + ROWS] for i in range(0, len(padded), ROWS)], grey))
                held += n
                if held > 16 << 20:
                    yield pd.DataFrame({"media_id": pd.array(keys, "Int64"), "n_bytes": sizes, "media": media})
                    keys, sizes, media, held = [], [], [], 0
            yield pd.DataFrame({"media_id": pd.array(keys, "Int64"), "n_bytes": sizes, "media": media})

    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload")
    return texts.select(F.col("media_id").cast("long"), payload).mapInPandas(encode, "media_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """media_id, n_bytes and, read back from media(media_id, n_bytes, media): digests of the payload and the media, and
    ``feature``: frames, screen size, length in ms and the 16-bin histogram of the shown grey values. Null media and bytes
    that are no whole GIF give a row with nulls and, as ``problem``, the reason."""
    columns = "media_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, problem string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, data in zip(batch["media_id"], batch["n_bytes"], batch["media"], strict=True):
                digest, size, tail, bins, count, length, screen = hashlib.sha256(), 0, b"", np.zeros(16, np.int64), 0, 0, (0, 0)
                try:
                    for frame in read_gif(bytes(data or b"")):
                        top, left, (h, w) = frame["top"], frame["left"], frame["indices"].shape
                        grey = frame["rgba"][top : top + h, left : left + w, 0]
                        payload = grey.tobytes()
                        digest.update(payload)
                        size += len(payload)
                        tail = (tail + payload[-64:])[-64:]
                        bins += np.bincount(grey.reshape(-1) >> 4, minlength=16)
                        count, length, screen = count + 1, length + frame["delay_cs"] * 10, frame["rgba"].shape
                except BROKEN as error:
                    rows.append([key, n, *[None] * 6, str(error) or type(error).__name__])
                    continue
                feature = f"{count} {screen[1]}x{screen[0]} {length}ms " + ",".join(map(str, bins.tolist()))
                rows.append([key, n, size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, None])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in columns.split(", ")]).astype({c: "Int64" for c in ("media_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})

    return media.mapInPandas(read, columns)
