"""What the binary product readers share: schemas, partitions and header fields."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import InputPartition

from ..errors import FormatFault

# Pixels of one Arrow batch of a reader.
BATCH_PIXELS = 1 << 18
PIXEL_SCHEMA = "az int, rg int, re float, im float"
PIXEL_ARROW = pa.schema(
    [("az", pa.int32()), ("rg", pa.int32()), ("re", pa.float32()), ("im", pa.float32())]
)

PULSE_SCHEMA = (
    "pulse bigint, t double, px double, py double, pz double, r_ref double, "
    "re array<float>, im array<float>"
)
PULSE_ARROW = pa.schema(
    [("pulse", pa.int64())]
    + [(n, pa.float64()) for n in ("t", "px", "py", "pz", "r_ref")]
    + [(n, pa.list_(pa.float32())) for n in ("re", "im")]
)


def list_column(lines: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(lines, np.float32).ravel())
    offsets = np.arange(0, lines.size + 1, lines.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


@dataclass
class Span(InputPartition):
    """A run of records one task reads."""

    start: int
    stop: int

    def __init__(self, start: int, stop: int):
        self.start = start
        self.stop = stop


def spans(count: int, size: int) -> list[Span]:
    size = max(1, size)
    return [Span(s, min(count, s + size)) for s in range(0, count, size)]


def parse_xml(data: bytes, what: str) -> ET.Element:
    try:
        root = ET.fromstring(data.strip(b"\0 \r\n\t"))
    except ET.ParseError as error:
        raise FormatFault(f"{what}: the XML block cannot be parsed: {error}") from error
    for element in root.iter():
        element.tag = element.tag.rsplit("}", 1)[-1]
    return root


def text_of(root: ET.Element | None, path: str) -> str | None:
    """Stripped text at a path below ``root``; a leading ``//`` searches everywhere."""
    found = None if root is None else root.find("." + path if path.startswith("//") else path)
    return None if found is None or found.text is None else found.text.strip()


def number_of(root: ET.Element | None, path: str) -> float | None:
    text = text_of(root, path)
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def vector_of(root: ET.Element | None, path: str) -> tuple[float, float, float] | None:
    parts = [number_of(root, f"{path}/{axis}") for axis in "XYZ"]
    return None if any(p is None for p in parts) else tuple(parts)


def unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 else v


def pixel_batch(az: np.ndarray, rg: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(az.astype(np.int32)), pa.array(rg.astype(np.int32)),
            pa.array(value.real.astype(np.float32)), pa.array(value.imag.astype(np.float32)),
        ],
        schema=PIXEL_ARROW,
    )
