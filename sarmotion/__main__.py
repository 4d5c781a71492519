"""Command line: ``python -m sarmotion COMMAND ...`` (or through spark-submit)."""

from __future__ import annotations

import argparse
import json
import math
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import SarMotionError
from .operators import raster, selection, tomography, validation
from .operators.focus import focus_azimuth_resolution
from .params import CcdParams, Grid, SubapParams, TomoParams, TrackParams
from .plans import feasibility as feasible
from .plans import commands
from .session import ship_package
from .sinks import images, tables
from .sources.interchange import load_collect
from .sources.sicd import read_sicd, read_sicd_meta
from .sources.uavsar import read_uavsar


def _pair(text: str) -> tuple[float, float]:
    a, b = text.split(",")
    return float(a), float(b)


def _collect_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--cphd")
    p.add_argument("--rbins", type=int, default=0)
    p.add_argument("--pulse-stride", type=int, default=1)
    p.add_argument("--max-pulses", type=int, default=0)


def _grid_options(p: argparse.ArgumentParser, size: int, flag: str = "--cell", cell: float = 1.0) -> None:
    p.add_argument("--size", type=int, default=size)
    p.add_argument(flag, dest="cell_m", type=float, default=cell)
    p.add_argument("--offset", type=_pair, default=(0.0, 0.0), help="X,Y in metres")
    p.add_argument("--at", type=_pair, help="LAT,LON in degrees")


def _chain_options(p: argparse.ArgumentParser, looks: int, coherence: float) -> None:
    p.add_argument("--n", type=int, default=looks)
    p.add_argument("--overlap", type=float, default=0.40)
    p.add_argument("--subap", choices=("pulse", "uniform", "paper"))
    p.add_argument("--b-shift", type=float, default=0.0)
    p.add_argument("--range-taps", type=int, default=0)
    p.add_argument("--estimator", choices=("correlation", "phase", "splitband"), default="correlation")
    p.add_argument("--reference", choices=("first", "adjacent", "lag", "pair"), default="first")
    p.add_argument("--lag", type=int, default=1)
    p.add_argument("--win", type=int, default=32)
    p.add_argument("--upsample", type=int, default=0)
    p.add_argument("--coherence", type=float, default=coherence)
    p.add_argument("--common-mode", action="store_true")
    p.add_argument("--no-optimize", action="store_true", help="search the whole correlation surface")
    p.add_argument("--fmin", type=float, default=0.0)
    p.add_argument("--no-detrend", action="store_true")


def _depth_options(p: argparse.ArgumentParser, depth: float) -> None:
    p.add_argument("--velocity", type=float, default=0.0)
    p.add_argument("--frequency", type=float, default=0.0)
    p.add_argument("--model", type=str.upper, choices=tomography.MODELS, default="A")
    p.add_argument("--depth", type=float, default=depth)
    p.add_argument("--cell", type=float, default=1.0)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="sarmotion")
    subcommands = root.add_subparsers(dest="command", required=True)

    p = subcommands.add_parser("feasibility", help="vibration reach against resolution")
    for name, default in (("dwell", 25.0), ("range", 640000.0), ("velocity", 7410.0), ("wavelength", 0.0305)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--tomo-velocity", type=float, default=0.0)
    p.add_argument("--tomo-frequency", type=float, default=0.0)

    p = subcommands.add_parser("info", help="describe a product")
    _collect_options(p)
    p.add_argument("--sicd")
    p.add_argument("--uavsar")
    p.add_argument("--ann")

    p = subcommands.add_parser("validate", help="can this collect support the measurement?")
    _collect_options(p)
    p.add_argument("--sicd")
    for name in ("frequency", "amplitude", "alpha", "overlap", "upsample", "cell", "size"):
        p.add_argument(f"--{name}", type=float)

    p = subcommands.add_parser("crop", help="draw part of an airborne image")
    p.add_argument("--uavsar", required=True)
    p.add_argument("--ann", required=True)
    for name in ("az0", "rg0", "size"):
        p.add_argument(f"--{name}", type=int, required=True)
    p.add_argument("--out", required=True)

    p = subcommands.add_parser("focus", help="form an image")
    _collect_options(p)
    _grid_options(p, 256)
    p.add_argument("--pulse-start", type=int, default=0)
    p.add_argument("--pulse-count", type=int)
    p.add_argument("--range-taps", type=int, default=0)
    p.add_argument("--dyn-range", type=float, default=40.0)
    p.add_argument("--out", required=True)
    p.add_argument("--raw")

    p = subcommands.add_parser("mmotion", help="measure vibration")
    _collect_options(p)
    _grid_options(p, 128)
    _chain_options(p, 16, 0.4)
    p.add_argument("--shuffle-looks", type=int, default=0)
    p.add_argument("--null-trials", type=int, default=0)
    p.add_argument("--ccd-out")
    p.add_argument("--ccd-win", type=int, default=5)
    p.add_argument("--ccd-loading", type=float, default=1e-3)
    p.add_argument("--shifts")
    p.add_argument("--out")

    p = subcommands.add_parser("tomo", help="invert depth under stated assumptions")
    _collect_options(p)
    _grid_options(p, 128, "--grid-cell")
    _chain_options(p, 64, 0.4)
    _depth_options(p, 60.0)
    p.add_argument("--solver", choices=("dft", "lstsq"))
    p.add_argument("--convention", choices=("paper", "patent"))
    p.add_argument("--y", choices=("shifts", "los"), default="shifts")
    p.add_argument("--regularisation", type=float)
    p.add_argument("--eq22-literal-t", type=float, default=0.0)
    p.add_argument("--no-window", action="store_true")
    p.add_argument("--keep-mean", action="store_true")
    p.add_argument("--patent-exact", action="store_true")
    p.add_argument("--aperture", type=float)
    p.add_argument("--range", type=float)
    p.add_argument("--incidence", type=float, help="degrees")
    p.add_argument("--null-align", type=int, default=0)
    p.add_argument("--null-align-seed", type=int, default=1)
    p.add_argument("--palette", default="energy")
    p.add_argument("--windows")
    p.add_argument("--geocode")
    p.add_argument("--slice", type=float, default=0.0)
    p.add_argument("--slice-out")
    p.add_argument("--section")
    p.add_argument("--section-width", type=int, default=512)
    p.add_argument("--section-out")
    p.add_argument("--out")

    p = subcommands.add_parser("sweep", help="does depth follow the assumptions?")
    _collect_options(p)
    _grid_options(p, 64, "--grid-cell", 0.5)
    _chain_options(p, 192, 0.0)
    _depth_options(p, 10.0)
    p.add_argument("--scales", type=_pair, default=(0.5, 2.0), help="LO,HI scale range")
    p.add_argument("--steps", type=int, default=5)
    p.add_argument("--offsets", default="0,0", help="X,Y:X,Y:...")
    return root


def _open(spark, a):
    if not a.cphd:
        raise SystemExit(f"{a.command}: --cphd is required")
    return load_collect(spark, a.cphd, a.rbins, a.pulse_stride, a.max_pulses)


def _grid(spark, a, collect) -> Grid:
    origin = (*a.offset, 0.0)
    if a.at:
        origin = commands.resolve_at(spark, collect, *a.at)
    return Grid(a.size, a.size, a.cell_m, a.cell_m, origin)


def _chain(a) -> tuple[SubapParams, TrackParams]:
    subap = SubapParams(
        n_looks=a.n, overlap=a.overlap, b_shift_hz=a.b_shift, pair=a.reference == "pair",
        range_taps=a.range_taps,
    )
    track = TrackParams(
        estimator=a.estimator, reference=a.reference, ref_lag=a.lag, win_az=a.win, win_rg=a.win,
        stride_az=a.win // 2, stride_rg=a.win // 2, coherence_min=a.coherence,
        remove_common_mode=a.common_mode, exhaustive=a.no_optimize,
    )
    if a.upsample:
        track = replace(track, upsample_az=a.upsample, upsample_rg=a.upsample)
    return subap, track


def _draw_windows(cells, value: str, meta, path: str, palette: str, lo: float = 0.0, hi: float = 0.0) -> None:
    shown = raster.map_levels(cells, value, lo, hi, palette)
    images.export_image(shown, meta.n_win_az, meta.n_win_rg, path, "iaz", "irg", palette != "gray")


def run_feasibility(spark, a) -> int:
    one = feasible.acquisition(spark, a.dwell, a.range, a.velocity, a.wavelength)
    for r in feasible.feasibility(one).collect():
        print("{n_looks:8d} {dt:10.4f} {f_max:10.2f} {az_resolution:12.2f}".format(**r.asDict()))
    if a.tomo_velocity > 0 and a.tomo_frequency > 0:
        print(json.dumps(feasible.depth_chain(one, a.tomo_velocity, a.tomo_frequency).first().asDict()))
    return 0


def run_info(spark, a) -> int:
    if a.uavsar:
        if not a.ann:
            raise SystemExit("an airborne image is described by its annotation file: give --ann as well")
        found = commands.image_info(*read_uavsar(spark, a.uavsar, a.ann))
    elif a.sicd:
        found = commands.image_info(*read_sicd(spark, a.sicd))
    else:
        found = commands.info(_open(spark, a))
    print(json.dumps(found, indent=2))
    return 0


def run_validate(spark, a) -> int:
    if bool(a.cphd) == bool(a.sicd):
        raise SystemExit("validate: give --cphd or --sicd, one of them")
    given = {
        "target_freq_hz": a.frequency, "alpha": a.alpha, "overlap": a.overlap,
        "upsample": a.upsample, "cell_m": a.cell, "grid_n": a.size,
        "target_amp_m": None if a.amplitude is None else a.amplitude / 1000.0,
    }
    given = {k: v for k, v in given.items() if v is not None}
    if a.sicd:
        requests = validation.image_request(spark, read_sicd_meta(a.sicd), **given)
    else:
        collect = load_collect(spark, a.cphd, 8)
        requests = validation.collect_request(collect, n_rbin=a.rbins or 4096, **given)
    findings, verdict = commands.validate(requests)
    for f in findings:
        print(f"  {f['level']:7s} {f['check']:22s} {f['detail']}")
    print(f"  VERDICT: {verdict}")
    return 2 if verdict == "FAIL" else 0


def run_crop(spark, a) -> int:
    pixels, meta = read_uavsar(spark, a.uavsar, a.ann)
    cut, small = raster.crop(pixels, meta, a.az0, a.rg0, a.size, a.size)
    images.export_image(raster.quicklook(cut), small.n_az, small.n_rg, a.out)
    return 0


def run_focus(spark, a) -> int:
    collect = _open(spark, a)
    grid = _grid(spark, a, collect)
    count = a.pulse_count or collect.meta.n_pulse
    caution = commands.sampling_warning(collect, grid, focus_azimuth_resolution(collect, count))
    if caution:
        print(f"warning: {caution}", file=sys.stderr)
    image, meta = commands.focus(collect, grid, a.pulse_start, a.pulse_count, a.range_taps)
    extent = commands.unambiguous_extent(collect, meta)
    if a.pulse_stride > 1 and 0 < extent < grid.n_x * grid.dx:
        print(f"warning: strided pulses repeat the scene every {extent:.1f} m", file=sys.stderr)
    image = image.persist()
    images.export_image(raster.quicklook(image, a.dyn_range), meta.n_az, meta.n_rg, a.out)
    if a.raw:
        rows = images.amplitude_rows(image)
        images.export_cube(rows, "az", "amplitude", meta.n_az, meta.n_rg, 1, a.raw, "azimuth, range, amplitude")
    return 0


def run_mmotion(spark, a) -> int:
    collect = _open(spark, a)
    grid = _grid(spark, a, collect)
    subap, track = _chain(a)
    found = commands.mmotion(
        collect, grid, subap, track, a.subap, a.fmin, "none" if a.no_detrend else "linear",
        a.null_trials, a.shuffle_looks,
    )
    if a.ccd_out:
        image = found.stack.meta.image
        stat, limits = commands.change(found.stack, CcdParams(win=a.ccd_win, loading=a.ccd_loading))
        print(json.dumps({"change": limits}))
        shown = raster.map_levels(stat, "stat", palette="viridis")
        images.export_image(shown, image.n_az, image.n_rg, f"{a.ccd_out}_ccd.png", colour=True)
        rows = stat.groupBy("az").agg(F.array_sort(F.collect_list(F.struct("rg", "stat"))).alias("_s"))
        rows = rows.select("az", F.col("_s.stat").alias("line"))
        images.export_cube(rows, "az", "line", 1, image.n_az, image.n_rg, f"{a.ccd_out}_ccd.f32", "row, col")
    if a.shifts:
        tables.write_csv(tables.shift_rows(found.motion, found.stack.meta), a.shifts)
    if a.out:
        _draw_windows(found.spectra, "dominant_freq", found.meta, f"{a.out}_freq.png", "viridis")
        _draw_windows(found.spectra, "quality", found.meta, f"{a.out}_quality.png", "viridis", 0.0, 1.0)
        tables.write_csv(tables.window_rows(selection.agreeing(found.spectra, found.meta)), f"{a.out}_windows.csv")
        tables.write_json(tables.selection_header(found.consensus, found.meta), f"{a.out}_windows.json")
    print(json.dumps({
        "frequency_hz": None if found.refused else found.best["dominant_freq"],
        "strongest": found.best, "consensus": found.consensus, "warnings": found.warnings,
        "velocity_p2p_mm_s": 1000.0 * found.velocity_p2p, "nulls": found.nulls,
    }, indent=2))
    return 0


def _tomo_params(a, **extra) -> TomoParams:
    return TomoParams(
        model=a.model, velocity=a.velocity, frequency=a.frequency, depth_max=a.depth,
        depth_cell=a.cell, **extra,
    )


def run_tomo(spark, a) -> int:
    if a.patent_exact:
        conflicts = {
            "--regularisation": bool(a.regularisation), "--solver": a.solver == "dft",
            "--convention": a.convention == "paper", "--estimator": a.estimator != "correlation",
        }
        clash = [k for k, v in conflicts.items() if v]
        if clash:
            raise SystemExit(f"tomo: --patent-exact cannot be combined with {', '.join(clash)}")
    collect = _open(spark, a)
    grid = _grid(spark, a, collect)
    subap, track = _chain(a)
    params = commands.collect_geometry(collect, _tomo_params(
        a, solver=a.solver or "dft", convention=a.convention or "paper", y_source=a.y,
        regularisation=1e-3 if a.regularisation is None else a.regularisation,
        eq22_literal_t=a.eq22_literal_t, window=not a.no_window, remove_y_mean=not a.keep_mean,
        patent_exact=a.patent_exact,
    ))
    if a.aperture:
        params = replace(params, aperture=a.aperture)
    if a.range:
        params = replace(params, slant_range=a.range)
    if a.incidence:
        params = replace(params, incidence=math.radians(a.incidence))
    found = commands.tomo(
        collect, grid, subap, track, params, a.subap, "none" if a.no_detrend else "linear",
        a.null_align, a.null_align_seed,
    )
    meta, params = found.meta, found.params
    palette = raster.palette_from_name(a.palette, "energy")
    if a.windows:
        tables.write_csv(commands.depth_windows(found), a.windows)
    if a.geocode:
        tables.write_csv(commands.geocoded_windows(found, collect), a.geocode)
    if a.section_out:
        ends = [float(x) for x in a.section.split(",")] if a.section else [0, 0, meta.n_win_az - 1, meta.n_win_rg - 1]
        cut = tomography.section(found.profiles, params, meta, ends[:2], ends[2:], a.section_width)
        shown = raster.map_levels(cut, "value", palette=palette)
        images.export_image(
            shown, len(tomography.depth_axis(params)), a.section_width, a.section_out, "j", "sample", palette != "gray"
        )
    if a.slice_out:
        plane = tomography.nearest_slice(found.profiles, params, a.slice)
        _draw_windows(plane, "value", meta, a.slice_out, palette)
    if a.out:
        images.export_cube(
            found.profiles, "win", "profile", meta.n_win_az, meta.n_win_rg,
            len(tomography.depth_axis(params)), a.out, "window row, window column, depth cell",
        )
        tables.write_json(found.metadata, f"{a.out}.meta")
    print(json.dumps({"metadata": found.metadata, "alignment_null": found.null}, indent=2, default=str))
    return 0


def run_sweep(spark, a) -> int:
    if not a.cphd:
        raise SystemExit("sweep: --cphd is required")
    subap, track = _chain(a)
    track = replace(track, win_az=32, win_rg=32, stride_az=16, stride_rg=16)
    collects = [load_collect(spark, path, a.rbins) for path in a.cphd.split(",")]
    offsets = [_pair(part) for part in a.offsets.split(":")]
    grid = Grid(a.size, a.size, a.cell_m, a.cell_m)
    found = commands.sweep(
        collects, _tomo_params(a), subap, track, grid, offsets, *a.scales, a.steps, a.fmin,
        a.subap or "pulse",
    )
    for r in found.merged.orderBy("lambda_ac").collect():
        steady = r["sd"] <= 0.10 * r["peak_depth"]
        print(f"{r['lambda_ac']:12.5f} {r['peak_depth']:12.3f} {r['sd']:10.3f} {'' if steady else 'unstable'}")
    print(json.dumps({
        "summary": found.summary, "realisations": found.per_realisation, "reliable": found.reliable,
        "velocity": found.velocity, "verdict": commands.sweep_verdict(found),
    }, indent=2))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sarmotion").getOrCreate()
    ship_package(spark)
    try:
        return globals()[f"run_{a.command}"](spark, a)
    except SarMotionError as error:
        print(f"{a.command}: {error.code}: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
