"""Image metadata by decoded content, with readers for PNG pixels and JPEG headers; and the audit's rules on it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO = "path string, format string, width int, height int, channels int, dtype string, min_value int, max_value int, zero_ratio double, max_channel_difference int, error string"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


#: Left, top, and steps of the seven passes of an interlaced PNG (fixed values).
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of lines (a filter type, then its bytes); step is the distance of the byte that a filter calls left."""
    kinds, height = rows[:, 0], len(rows)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    raw = rows[:, 1:].reshape(height, -1, step).astype(np.int16)
    width = raw.shape[1]
    done = np.zeros((height + 1, width + 1, step), np.int16)  # with a line above and a pixel to the left, all zero
    if not np.isin(kinds, (3, 4)).any():
        for y, kind in enumerate(kinds.tolist()):
            line = raw[y]
            line = (line + done[y, 1:]) & 255 if kind == 2 else np.cumsum(line, axis=0, dtype=np.int64) & 255 if kind == 1 else line
            done[y + 1, 1:] = line
        return done[1:, 1:].astype(np.uint8).reshape(height, -1)
    # A byte needs those to its left and above it: all pixels of a diagonal can be had at once.
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, kind = d - y, kinds[y][:, None]
        a, b, c = done[y + 1, x], done[y, x + 1], done[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        done[y + 1, x + 1] = (raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, nearest], 0)) & 255
    return done[1:, 1:].astype(np.uint8).reshape(height, -1)


def decode_png(data: bytes) -> np.ndarray:
    """height x width x channels of a PNG of any depth, interlaced or not; palettes give their colours, small greys are scaled to 8 bits."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, parts, palette, head = 8, [], b"", None
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = part
        elif kind == b"IDAT":
            parts.append(part)
        at += 12 + n
    if head is None or head[3] not in _CHANNELS or head[2] not in (1, 2, 4, 8, 16) or head[6] > 1:
        raise ValueError("unsupported PNG")
    width, height, depth, colour, _, _, interlaced = head
    channels = _CHANNELS[colour]
    body, at = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8), 0
    out = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    for left, top, right, down in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - left) // right), -(-(height - top) // down)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        lines = _unfiltered(body[at : at + h * (line + 1)].reshape(h, line + 1), max(1, channels * depth // 8))
        at += h * (line + 1)
        if depth < 8:
            bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
            lines = (bits @ (1 << np.arange(depth)[::-1]))[:, : w * channels].astype(np.uint8)
        elif depth == 16:
            lines = lines.view(">u2")
        out[top::down, left::right] = lines.reshape(h, w, channels)
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[:, :, 0]]
    return out * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else out


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of a height x width [x channels] array of uint8 or uint16."""
    p = pixels if pixels.ndim == 3 else pixels[:, :, None]
    depth = p.dtype.itemsize
    raw = b"".join(b"\0" + row.astype(p.dtype.newbyteorder(">")).tobytes() for row in p)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[p.shape[2]]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8 * depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """width, height and channels from a JPEG's frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            break
        kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
            return width, height, channels
        at += 2 + n
    raise ValueError("no JPEG frame")


def describe(path: str, data: bytes, infrared: bool) -> tuple:
    try:
        if data[:4] == b"\x89PNG":
            p = decode_png(data)
            difference = int(max(np.abs(p[:, :, 0].astype(int) - p[:, :, i].astype(int)).max() for i in (1, 2))) if infrared and p.shape[2] >= 3 else None
            return path, "PNG", p.shape[1], p.shape[0], p.shape[2], str(p.dtype), int(p.min()), int(p.max()), float((p == 0).mean()), difference, None
        width, height, channels = jpeg_size(data)
        return path, "JPEG", width, height, channels, "uint8", None, None, None, None, None
    except (ValueError, zlib.error, struct.error, IndexError) as e:
        return path, *[None] * 9, str(e)


def opened(location: str) -> bytes:
    """Bytes of a file by its URI, as a listing gives it."""
    if location.startswith("file://"):
        return Path(location.removeprefix("file://")).read_bytes()
    from pyarrow import fs

    disk, path = fs.FileSystem.from_uri(quote(location, safe=":/@?=&%"))
    with disk.open_input_stream(path) as f:
        return f.read()


def inspect(files: DataFrame, modality: str) -> DataFrame:
    """INFO of files(path, content or location). Pixels of JPEGs are not decoded: their values are null.

    Of files with a location each is read where it is inspected, one at a time, so that batches hold names only; contents
    come in batches that Spark bounds by bytes (64 MB or one image, by default).
    """
    source = "location" if "location" in files.columns and "content" not in files.columns else "content"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in INFO.split(", ")]
        for part in parts:
            found = pd.DataFrame([describe(p, opened(c) if source == "location" else c, modality == "infrared") for p, c in zip(part["path"], part[source], strict=True)], columns=names)
            yield found.astype({n: "Int32" for n in ("width", "height", "channels", "min_value", "max_value", "max_channel_difference")})

    return files.select("path", source).mapInPandas(run, INFO)


def anomalous(modality: Column, kind: Column, dtype: Column, channels: Column, top: Column, low: Column) -> Column:
    """Whether an image breaks its modality's format, or is all zero."""
    colour = (dtype == "uint8") & (channels == 3)
    depth = ((kind == "PNG") & (dtype == "uint16") & (channels == 1)) | ((kind == "JPEG") & colour)
    fits = F.when(modality == "depth", depth).otherwise(colour)
    return ~F.coalesce(fits, F.lit(False)) | F.coalesce((top == 0) & (low == 0), F.lit(False))


def groups(records: DataFrame, visible: DataFrame, infrared: DataFrame, depth: DataFrame) -> DataFrame:
    """Distinct image triples of records whose three images were read, and whether their sizes agree."""
    size = lambda df, n: df.where("error is null").select(F.col("path").alias(n), F.struct("width", "height").alias(f"{n}_size")).dropDuplicates([n])
    rows = records.select("visible", "infrared", "depth").distinct()
    for n, df in (("visible", visible), ("infrared", infrared), ("depth", depth)):
        rows = rows.join(size(df, n), n)
    return rows.withColumn("size_mismatch", (F.col("visible_size") != F.col("infrared_size")) | (F.col("visible_size") != F.col("depth_size")))
