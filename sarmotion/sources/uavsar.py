"""Airborne single-look complex images: flat float pairs and a text annotation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import FormatFault, MissingMetadata, RangeFault
from ..functions.geometry import image_faults
from ..params import SPEED_OF_LIGHT, ImageMeta
from .binary import BATCH_PIXELS, PIXEL_SCHEMA, Span, pixel_batch, spans
from .stores import Location, Ranged, locate, read_all

# Alternative field names, first found wins.
FIELDS = {
    "rows": ("slc_1_1x1 Rows", "Number of SLC Lines"),
    "cols": ("slc_1_1x1 Columns", "Number of SLC Range Bins"),
    "az_spacing": ("1x1 SLC Azimuth Pixel Spacing", "Azimuth Spacing"),
    "rg_spacing": ("1x1 SLC Range Pixel Spacing", "Range Spacing"),
    "altitude": ("Average Altitude",),
    "velocity": ("Average Along Track Velocity",),
    "frequency": ("Center Frequency",),
}
DEFAULT_SPEED = 220.0
DEFAULT_FREQUENCY = 1.2575e9
MAX_EXTENT = 1e7


def read_annotation(path: str | Location) -> dict[str, str]:
    """``name (unit) = value ; comment`` lines; names are lower-cased, first wins."""
    fields: dict[str, str] = {}
    for line in read_all(path).decode("latin-1").splitlines():
        name, found, value = line.split(";", 1)[0].partition("=")
        if found:
            fields.setdefault(name.split("(", 1)[0].strip().lower(), value.strip())
    return fields


def _number(fields: dict[str, str], what: str) -> float | None:
    for name in FIELDS[what]:
        text = fields.get(name.lower())
        if text is not None:
            try:
                return float(text.split()[0])
            except (ValueError, IndexError):
                raise FormatFault(f"annotation field {name!r} is not numeric: {text!r}") from None
    return None


def _required(fields: dict[str, str], what: str) -> float:
    value = _number(fields, what)
    if value is None:
        raise MissingMetadata(f"the annotation has none of {FIELDS[what]}")
    return value


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.location = Location(options["path"], options.get("opener", ""))
        self.n_az, self.n_rg = int(options["n_az"]), int(options["n_rg"])

    def partitions(self):
        return spans(self.n_az, max(1, (32 << 20) // (self.n_rg * 8)))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_PIXELS // self.n_rg)
        with Ranged(self.location) as file:
            for at in range(partition.start, partition.stop, step):
                lines = np.arange(at, min(at + step, partition.stop))
                pairs = file.array("<f4", 8 * self.n_rg * at, (len(lines) * self.n_rg, 2)).astype(float)
                yield pixel_batch(np.repeat(lines, self.n_rg), np.tile(np.arange(self.n_rg), len(lines)), pairs[:, 0] + 1j * pairs[:, 1])


class UavsarSource(DataSource):
    @classmethod
    def name(cls):
        return "sarmotion_uavsar"

    def schema(self):
        return PIXEL_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_uavsar(spark: SparkSession, slc_path: str, ann_path: str) -> tuple[DataFrame, ImageMeta]:
    """Pixels ``(az, rg, re, im)`` and the geometry their annotation declares.

    The annotation's altitude stands in for a range, as it holds no other.
    """
    fields = read_annotation(locate(spark, ann_path))
    rows, cols = _required(fields, "rows"), _required(fields, "cols")
    if not (1 <= rows <= MAX_EXTENT and 1 <= cols <= MAX_EXTENT):
        raise FormatFault(f"implausible dimensions {rows:g} x {cols:g}")
    n_az, n_rg = int(rows), int(cols)
    where = locate(spark, slc_path)
    with Ranged(where) as file:
        size, need = file.size, n_az * n_rg * 8
    if size < need:
        raise FormatFault(f"{slc_path} has {size} bytes, its samples need {need}")
    az, rg = _required(fields, "az_spacing"), _required(fields, "rg_spacing")
    if not az > 0:
        raise FormatFault(f"azimuth spacing {az:g} m is not positive")
    speed = _number(fields, "velocity") or 0.0
    fc = _number(fields, "frequency") or DEFAULT_FREQUENCY
    fc = fc * 1e6 if fc < 1e6 else fc
    used = speed if speed > 0 else DEFAULT_SPEED
    interval = az / used
    meta = ImageMeta(
        n_az=n_az, n_rg=n_rg, fs_az=1.0 / interval, azimuth_time_interval=interval, fc=fc,
        wavelength=SPEED_OF_LIGHT / fc, az_spacing=az, rg_spacing=rg,
        r0=max(_number(fields, "altitude") or 0.0, 0.0), t_dwell=n_az * interval,
        v_platform=speed, source="UAVSAR" + ("" if speed > 0 else " (assumed platform speed)"),
    )
    check_image(spark, meta)
    spark.dataSource.register(UavsarSource)
    pixels = (
        spark.read.format("sarmotion_uavsar").option("n_az", n_az).option("n_rg", n_rg)
        .option("opener", where.opener).load(slc_path)
    )
    return pixels, meta


def check_image(spark: SparkSession, meta: ImageMeta) -> None:
    """Refuse geometry outside physical bounds."""
    fault = image_faults(
        meta.fs_az, meta.wavelength, meta.az_spacing, meta.rg_spacing, meta.incidence, meta.v_platform
    )
    found = spark.range(1).select(fault.alias("f")).first()["f"]
    if found is not None:
        raise RangeFault(f"image field {found} is implausible")
