"""Decoding images for models and people: pixels, the size alone, and pictures with boxes drawn on them."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetError
from .images import decode_png, encode_png, jpeg_size, opened

RED, GREEN = (255, 0, 0), (0, 200, 0)
#: Line width of a comparison; a preview's is a share of the shorter side.
COMPARISON_WIDTH, PREVIEW_SHARE = 7, 250


def size(data: bytes) -> tuple[int, int]:
    """width and height, from the header; DatasetError if data is neither PNG nor JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    try:
        return jpeg_size(data)[:2]
    except (ValueError, struct.error) as e:
        raise DatasetError(f"unreadable image: {e}") from e


def rgb(data: bytes, upright: bool = True) -> np.ndarray:
    """height x width x 3 of uint8. upright: turned as the image's orientation tag says; a PNG is read as it lies.

    JPEGs need the imaging library; without it they raise DatasetError.
    """
    if data[:4] == b"\x89PNG":
        p = decode_png(data)
        p = (p >> 8).astype(np.uint8) if p.dtype == np.uint16 else p
        return np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]
    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        raise DatasetError("JPEG pixels need the imaging library") from e
    with Image.open(io.BytesIO(data)) as image:
        return np.asarray((ImageOps.exif_transpose(image) if upright else image).convert("RGB"))


def outlined(pixels: np.ndarray, box: list[float], colour: tuple[int, int, int], width: int) -> np.ndarray:
    """A copy of pixels with the outline of a normalised box, width pixels wide and inside it."""
    out, (h, w) = pixels.copy(), pixels.shape[:2]
    x1, x2 = sorted(min(max(int(v * w), 0), w - 1) for v in (box[0], box[2]))
    y1, y2 = sorted(min(max(int(v * h), 0), h - 1) for v in (box[1], box[3]))
    part = out[y1 : y2 + 1, x1 : x2 + 1]
    for edge in (part[:width], part[-width:], part[:, :width], part[:, -width:]):
        edge[:] = colour
    return out


def comparison(data: bytes, truth: list[float], predicted: list[float]) -> bytes:
    """PNG with the true box in green and the predicted one in red."""
    return encode_png(outlined(outlined(rgb(data), truth, GREEN, COMPARISON_WIDTH), predicted, RED, COMPARISON_WIDTH))


def preview(data: bytes, box: list[float], label: str = "") -> bytes:
    """PNG with a manifest record's box in red and its label as the picture's title; manifest images are not turned."""
    p = rgb(data, upright=False)
    picture = encode_png(outlined(p, box, RED, max(2, round(min(p.shape[:2]) / PREVIEW_SHARE))))
    body = b"tEXtTitle\0" + label.encode("ascii", "replace")
    return picture[:33] + struct.pack(">I", len(body) - 4) + body + struct.pack(">I", zlib.crc32(body)) + picture[33:]


def decoded(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """query_id, width, height and pixels (RGB, line by line) of manifest rows(query_id, image_relpath), in the manner of a
    dataset's items: as an image lies, not turned.

    Names are joined to listing(path, location), and a task opens its images one at a time; a record whose file is missing
    fails the job. JPEGs need the imaging library.
    """
    files = listing.select(F.col("path").alias("image_relpath"), "location")
    found = rows.select("query_id", "image_relpath").join(files, "image_relpath", "left")
    found = found.withColumn("location", F.coalesce("location", F.raise_error(F.concat(F.lit("missing image: "), F.col("image_relpath"))).cast("string")))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for query_id, location in zip(part["query_id"], part["location"], strict=True):
                p = rgb(opened(location), upright=False)
                yield pd.DataFrame({"query_id": [query_id], "width": [p.shape[1]], "height": [p.shape[0]], "pixels": [p.tobytes()]})

    return found.select("query_id", "location").mapInPandas(work, "query_id string, width int, height int, pixels binary")
