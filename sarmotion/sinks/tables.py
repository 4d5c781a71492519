"""Tabular results and their sidecars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import excursion_floor
from ..params import MotionMeta, StackMeta
from ..sources.stores import Location


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header line each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def shift_rows(motion: DataFrame, stack: StackMeta) -> DataFrame:
    """Tracked series before any detrending, with each look's centre time."""
    times = F.array(*[F.lit(float(x)) for x in stack.centre_times])
    centre = F.coalesce(F.try_element_at(times, F.col("look").cast("int") + 1), F.lit(0.0))
    return motion.select(
        F.col("win").alias("window"), "look", centre.alias("centre_time_s"),
        F.col("disp_az").alias("disp_az_px"), F.col("disp_rg").alias("disp_rg_px"),
        F.col("vel_los").alias("vel_los_ms"), F.col("disp_los").alias("disp_los_m"),
        F.col("phase").alias("phase_rad"), "quality",
    )


def window_rows(agreed: DataFrame) -> DataFrame:
    """Per-window evidence behind a selection."""
    return agreed.select(
        F.col("win").alias("window"), "iaz", "irg", F.col("dominant_freq").alias("dominant_hz"),
        "prominence", "quality", "excursion_px", F.col("passed").alias("passed_gates"),
        F.col("agrees").alias("agrees_with_consensus"),
    )


def selection_header(consensus: dict | None, meta: MotionMeta) -> dict:
    return {
        **(consensus or {}), "df_hz": meta.df, "quant_px": meta.quant_px,
        "floor_px": excursion_floor(meta), "n_win_az": meta.n_win_az, "n_win_rg": meta.n_win_rg,
    }


def write_json(values: dict, path: str) -> None:
    """A small document at ``path``, in any store."""
    system, inner = Location(path).file_system()
    with system.open_output_stream(inner) as out:
        out.write((json.dumps(values, indent=2, default=str) + "\n").encode())
