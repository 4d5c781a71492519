"""Rasters and cubes: tables that Spark writes anywhere, and pictures exported to files of the driver's host."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, IoFault
from .cubes import export_cube  # noqa: F401  the cube's flat form, written by tasks

# Pixels per side of one encoded tile.
TILE = 512


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit PNG of a (rows, cols) or (rows, cols, 3) array."""
    if pixels.ndim not in (2, 3) or pixels.size == 0 or (pixels.ndim == 3 and pixels.shape[2] != 3):
        raise ArgumentError("a PNG needs a non-empty grey or three-channel image")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows, cols = pixels.shape[:2]
    flat = np.ascontiguousarray(pixels, np.uint8).reshape(rows, -1)
    filtered = np.concatenate([np.zeros((rows, 1), np.uint8), flat], axis=1)
    header = struct.pack(">IIBBBBB", cols, rows, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header)
        + chunk(b"IDAT", zlib.compress(filtered.tobytes())) + chunk(b"IEND", b"")
    )


def encode_pgm(pixels: np.ndarray) -> bytes:
    rows, cols = pixels.shape
    return f"P5\n{cols} {rows}\n255\n".encode() + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_tiles(
    levels: DataFrame, n_row: int, n_col: int, row: str = "az", col: str = "rg",
    colour: bool = False, tile: int = TILE, form: str = "png",
) -> DataFrame:
    """One encoded image per tile: ``(tile_row, tile_col, data)``."""
    bands = ["r", "g", "b"] if colour else ["level"]
    placed = levels.select(
        F.floor(F.col(row) / tile).alias("tile_row"), F.floor(F.col(col) / tile).alias("tile_col"),
        (F.col(row) % tile).cast("int").alias("y"), (F.col(col) % tile).cast("int").alias("x"),
        *[F.col(b).cast("int").alias(b) for b in bands],
    )

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [min(tile, n - k * tile) for n, k in zip((n_row, n_col), key)]
        image = np.zeros((*shape, len(bands)), np.uint8)
        image[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[bands].to_numpy()
        image = image if colour else image[:, :, 0]
        data = encode_pgm(image) if form == "pgm" else encode_png(image)
        return pd.DataFrame({"tile_row": [key[0]], "tile_col": [key[1]], "data": [data]})

    return placed.groupBy("tile_row", "tile_col").applyInPandas(
        encode, "tile_row bigint, tile_col bigint, data binary"
    )


def write_image(
    levels: DataFrame, n_row: int, n_col: int, path: str, row: str = "az", col: str = "rg",
    colour: bool = False, tile: int = TILE, form: str = "png",
) -> None:
    """A table of encoded tiles ``(tile_row, tile_col, data)`` at ``path``, in whatever store Spark writes to."""
    if form not in ("png", "pgm"):
        raise ArgumentError(f"unknown image form {form!r}")
    if form == "pgm" and colour:
        raise ArgumentError("colour images are written as PNG only")
    encode_tiles(levels, n_row, n_col, row, col, colour, tile, form).write.mode("overwrite").parquet(path)


def export_image(
    levels: DataFrame, n_row: int, n_col: int, path: str, row: str = "az", col: str = "rg", colour: bool = False,
) -> None:
    """One image file on the driver's host, for a picture that fits its memory.

    The extension decides the format: ``.png``, and grey PGM for anything else.
    """
    form = "png" if path.lower().endswith(".png") else "pgm"
    if form == "pgm" and colour:
        raise ArgumentError("colour images are written as PNG only")
    only = encode_tiles(levels, n_row, n_col, row, col, colour, max(n_row, n_col), form).first()
    if only is None:
        raise ArgumentError("there is nothing to draw")
    _put(path, bytes(only["data"]))


def _put(path: str, data: bytes) -> None:
    try:
        with open(path, "wb") as f:
            f.write(data)
    except OSError as error:
        raise IoFault(f"cannot write {path}: {error}") from error


def write_cube(rows: DataFrame, index: str, values: str, path: str) -> None:
    """Runs of float32 samples ``(at, run)`` as a table, numbered in plane, row, column order."""
    rows.select(
        F.col(index).cast("bigint").alias("at"), F.transform(values, lambda x: x.cast("float")).alias("run")
    ).write.mode("overwrite").parquet(path)


def amplitude_rows(image: DataFrame) -> DataFrame:
    """One run of amplitudes per azimuth line, ready for the cube writers."""
    packed = image.groupBy("az").agg(
        F.array_sort(F.collect_list(F.struct("rg", F.hypot("re", "im").alias("a")))).alias("_s")
    )
    return packed.select("az", F.col("_s.a").alias("amplitude"))
