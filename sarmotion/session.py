"""Lineage control shared by the iterative operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import ArgumentError


def is_local(master: str) -> bool:
    """Whether tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set, else ``spark.checkpoint.dir``.

    A private folder is made only where driver and tasks are one process; a cluster must name a shared one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", "")
    if not target:
        if not is_local(context.master):
            raise ArgumentError("spark.checkpoint.dir must name a folder that all executors share")
        target = tempfile.mkdtemp(prefix="sarmotion-checkpoint-")
    context.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made.

    Checkpointed blocks live in reliable storage, so a lost executor costs a
    re-read and never a recomputation of every earlier round.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_sarmotion_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sarmotion-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "sarmotion"), "zip", os.path.dirname(root), os.path.basename(root)
    )
    context.addPyFile(archive)
    context._sarmotion_shipped = True
