import struct

import numpy as np
import pytest

from sarmotion.errors import FormatFault, IoFault, MissingMetadata, UnsupportedFault
from sarmotion.params import Plane
from sarmotion.operators import validation
from sarmotion.params import TomoParams
from sarmotion.plans import commands
from sarmotion.sources import interchange
from sarmotion.sources.cphd import read_cphd, read_header
from sarmotion.sources.sicd import read_sicd, read_sicd_meta
from sarmotion.sources.uavsar import read_annotation, read_uavsar

SRP = np.array([-552223.3276, -4594117.3286, 4632556.6406])
NV, NS, WORDS = 64, 32, 30
AT = {"TxTime": 0, "TxPos": 1, "RcvPos": 8, "SRPPos": 14, "SC0": 27, "SCSS": 28}


def vector_xml(v):
    return "".join(f"<{a}>{x:.10g}</{a}>" for a, x in zip("XYZ", v))


def write_cphd(path, sample="CF8", domain="FX", collector="X", channels=1, n_samples=NS, magic="CPHD/1.1.0",
               form_feed=True, sig_scale=1, sig_offset=None, bad_scss=False, cut=0, drop=None, flags=None):
    words = dict(AT)
    if flags is not None:
        words["SIGNAL"] = 29
    words.pop(drop, None)
    pvp = "".join(f"<{k}><Offset>{v}</Offset></{k}>" for k, v in words.items())
    xml = (
        f'<CPHD xmlns="http://api.nsgreg.nga.mil/schema/cphd/1.1.0"><CollectionID><CollectorName>{collector}'
        "</CollectorName><CollectType>MONOSTATIC</CollectType></CollectionID>"
        f"<Global><DomainType>{domain}</DomainType><SGN>-1</SGN><FxBand><FxMin>9.5e9</FxMin><FxMax>9.7e9</FxMax>"
        f"</FxBand></Global><SceneCoordinates><IARP><ECF>{vector_xml(SRP)}</ECF></IARP><ReferenceSurface><Planar>"
        f"<uIAX>{vector_xml((1, 0, 0))}</uIAX><uIAY>{vector_xml((0, 1, 0))}</uIAY></Planar></ReferenceSurface>"
        f"</SceneCoordinates><Data><SignalArrayFormat>{sample}</SignalArrayFormat><NumBytesPVP>{WORDS * 8}"
        f"</NumBytesPVP><NumCPHDChannels>{channels}</NumCPHDChannels><Channel><NumVectors>{NV}</NumVectors>"
        f"<NumSamples>{n_samples}</NumSamples></Channel></Data><PVP>{pvp}</PVP></CPHD>"
    ).encode()
    vectors = np.zeros((NV, WORDS))
    for p in range(NV):
        pos = SRP + [(p - NV / 2) * 100.0, 0.0, 900000.0]
        vectors[p, 0] = p * 0.001
        vectors[p, 1:4] = vectors[p, 8:11] = pos
        vectors[p, 14:17] = SRP
        vectors[p, 27], vectors[p, 28] = 9.5e9, 21496.0
    if bad_scss:
        vectors[7, 28] *= 2
    block = vectors.astype(">f8")
    if flags is not None:
        block.view(">i8")[:, 29] = flags
    tone = np.exp(-2j * np.pi * np.arange(NS) * 3 / NS)
    scale, kind = (1.0, ">f4") if sample == "CF8" else (1000.0, ">i2")
    pairs = np.stack([tone.real, tone.imag], axis=1) * scale
    signal = np.tile(pairs.ravel(), NV).astype(kind).tobytes()
    pvp_at = 1024 + len(xml)
    sizes = {"XML": (len(xml), 1024), "PVP": (block.nbytes, pvp_at),
             "SIGNAL": (len(signal) * sig_scale, sig_offset or pvp_at + block.nbytes)}
    head = magic + "\n" + "".join(
        f"{k}_BLOCK_SIZE := {n}\n{k}_BLOCK_BYTE_OFFSET := {o}\n" for k, (n, o) in sizes.items()
    ) + ("\f" if form_feed else "") + "\n"
    data = head.encode().ljust(1024, b"\0") + xml + block.tobytes() + signal
    path.write_bytes(data[: len(data) - cut])
    return str(path)


def test_cphd_geometry_and_signal(spark, tmp_path):
    collect = read_cphd(spark, write_cphd(tmp_path / "a.cphd"))
    meta = collect.meta
    assert (meta.n_pulse, meta.n_rbin, meta.phase_ref_srp) == (NV, NS, True)
    assert meta.prf == pytest.approx(1000.0)
    assert meta.dr == pytest.approx(299792458.0 / (2 * NS * 21496.0))
    rows = collect.pulses.orderBy("pulse").collect()
    assert [r["pulse"] for r in rows] == list(range(NV))
    assert rows[0]["px"] == pytest.approx(-3200.0, abs=1e-3) and rows[0]["pz"] == pytest.approx(900000.0, abs=1e-3)
    assert rows[0]["r_ref"] == pytest.approx(np.hypot(3200.0, 900000.0), abs=1e-3)
    line = np.hypot(rows[9]["re"], rows[9]["im"])
    # The reference bin sits at n/2, the target three delay bins beyond it.
    assert line.argmax() == NS // 2 + 3 and line.max() == pytest.approx(1.0, abs=1e-5)


def test_cphd_integers_and_vendor_sign(spark, tmp_path):
    collect = read_cphd(spark, write_cphd(tmp_path / "a.cphd", sample="CI4"))
    line = collect.pulses.where("pulse = 0").first()
    assert np.hypot(line["re"], line["im"]).argmax() == NS // 2 + 3
    mirrored = read_cphd(spark, write_cphd(tmp_path / "b.cphd", collector="Capella-3"))
    line = mirrored.pulses.where("pulse = 0").first()
    assert np.hypot(line["re"], line["im"]).argmax() == NS // 2 - 3


def test_cphd_window_stride_and_cap(spark, tmp_path):
    path = write_cphd(tmp_path / "a.cphd")
    small = read_cphd(spark, path, rbin_window=8, pulse_stride=3, max_pulses=10)
    assert (small.meta.n_pulse, small.meta.n_rbin) == (10, 8)
    rows = small.pulses.orderBy("pulse").collect()
    assert [round(r["t"] * 1000) for r in rows] == list(range(0, 30, 3))
    line = np.hypot(rows[0]["re"], rows[0]["im"])
    assert len(line) == 8 and line.argmax() == 4 + 3


def test_cphd_geometry_never_reads_a_sample(spark, tmp_path):
    flags = np.ones(NV, np.int64)
    flags[[0, 9]] = 0
    path = write_cphd(tmp_path / "a.cphd", flags=flags)
    collect = read_cphd(spark, path, pulse_stride=2, max_pulses=20)
    columns = ["pulse", "t", "px", "py", "pz", "r_ref"]
    want = sorted(map(tuple, collect.pulses.select(columns).collect()))
    header = read_header(path)
    with open(path, "r+b") as f:
        f.truncate(header.signal_offset)
    assert sorted(map(tuple, collect.geometry.select(columns).collect())) == want
    assert validation.pulse_intervals(collect.geometry).count() == 19
    assert commands.collect_geometry(collect, TomoParams()).slant_range > 0
    with pytest.raises(Exception, match="shorter than its header says"):
        collect.pulses.collect()


def test_cphd_skips_flagged_vectors_before_striding(spark, tmp_path):
    flags = np.ones(NV, int)
    flags[[0, 5, 6]] = 0
    collect = read_cphd(spark, write_cphd(tmp_path / "a.cphd", flags=flags), pulse_stride=2)
    kept = [i for i in range(NV) if flags[i]][::2]
    times = [round(r["t"] * 1000) for r in collect.pulses.orderBy("pulse").collect()]
    assert times == kept and collect.meta.n_pulse == len(kept)


@pytest.mark.parametrize("damage, error", [
    ({"magic": "NITF/2.1"}, FormatFault), ({"form_feed": False}, FormatFault),
    ({"sig_scale": 64}, FormatFault), ({"sig_offset": 0xFFFFFFF0}, FormatFault),
    ({"n_samples": 999999}, FormatFault), ({"sample": "CI2"}, UnsupportedFault),
    ({"channels": 2}, UnsupportedFault), ({"cut": 1024}, FormatFault), ({"drop": "SCSS"}, MissingMetadata),
])
def test_cphd_rejections(tmp_path, damage, error):
    with pytest.raises(error):
        read_header(write_cphd(tmp_path / "bad.cphd", **damage))


def test_cphd_varying_spacing_is_refused(spark, tmp_path):
    with pytest.raises(UnsupportedFault):
        read_cphd(spark, write_cphd(tmp_path / "a.cphd", bad_scss=True))
    with pytest.raises(IoFault):
        read_header(str(tmp_path / "absent.cphd"))


ROWS, COLS = 8, 6


def write_uavsar(folder, rows="8", speed=None, short=False):
    ann, slc = folder / "a.ann", folder / "a.slc"
    lines = ["; comment", "Number of SLC Range Bins (pixels) = 6 ; bins", "AZIMUTH SPACING (m) = 1.0", "Range Spacing = 1.0"]
    lines += [] if rows is None else [f"Number of SLC Lines = {rows}"]
    lines += [] if speed is None else [f"Average Along Track Velocity (m/s) = {speed}"]
    ann.write_text("\n".join(lines))
    n = ROWS * COLS // (2 if short else 1)
    slc.write_bytes(np.stack([np.arange(n), -np.arange(n)], axis=1).astype("<f4").tobytes())
    return str(slc), str(ann)


def test_uavsar(spark, tmp_path):
    pixels, meta = read_uavsar(spark, *write_uavsar(tmp_path))
    assert (meta.n_az, meta.n_rg) == (8, 6) and "assumed" in meta.source
    assert meta.fs_az == pytest.approx(220.0) and meta.fc == 1.2575e9
    for r in pixels.collect():
        i = r["az"] * COLS + r["rg"]
        assert (r["re"], r["im"]) == (i, -i)
    _, fast = read_uavsar(spark, *write_uavsar(tmp_path, speed=230.0))
    assert fast.v_platform == 230.0 and "assumed" not in fast.source
    assert read_annotation(str(tmp_path / "a.ann"))["number of slc range bins"] == "6"


@pytest.mark.parametrize("options, error", [
    ({"rows": None}, MissingMetadata), ({"rows": "not-a-number"}, FormatFault), ({"rows": "0"}, FormatFault),
    ({"rows": "1e12"}, FormatFault), ({"short": True}, FormatFault),
])
def test_uavsar_rejections(spark, tmp_path, options, error):
    with pytest.raises(error):
        read_uavsar(spark, *write_uavsar(tmp_path, **options))


def write_flat(path, magic=interchange.MAGIC, version=2, n_pulse=16, n_rbin=8, cut=0):
    head = interchange.HEADER.pack(magic, version, n_pulse, n_rbin, 5e5, 1.0, 9.6e9, 0.031, 1000.0)
    t = np.arange(16) * 1e-3
    body = np.concatenate([t, np.full(16, 5e5), np.arange(48.0)]).astype("<f8").tobytes()
    body += np.tile([1.0, -2.0], 128).astype("<f4").tobytes()
    data = head + body
    path.write_bytes(data[: len(data) - cut])
    return str(path)


def test_flat_import(spark, tmp_path):
    collect = interchange.load_collect(spark, write_flat(tmp_path / "a.bin"))
    row = collect.pulses.where("pulse = 5").first()
    assert row["t"] == pytest.approx(5e-3) and (row["px"], row["py"], row["pz"]) == (15.0, 16.0, 17.0)
    assert row["re"] == [1.0] * 8 and row["im"] == [-2.0] * 8
    assert collect.meta.prf == 1000.0 and not collect.meta.phase_ref_srp


@pytest.mark.parametrize("damage, error", [
    ({"magic": 0xDEADBEEF}, FormatFault), ({"version": 99}, UnsupportedFault), ({"n_pulse": 1 << 40}, FormatFault),
    ({"n_rbin": 0}, FormatFault), ({"cut": 200}, FormatFault), ({"cut": 1770}, FormatFault),
])
def test_flat_rejections(spark, tmp_path, damage, error):
    with pytest.raises(error):
        interchange.read_flat(spark, write_flat(tmp_path / "a.bin", **damage))


def test_saved_collects_keep_phase_reference_and_plane(spark, tmp_path):
    collect = read_cphd(spark, write_cphd(tmp_path / "a.cphd"))
    interchange.save(collect, str(tmp_path / "saved"))
    again = interchange.load_collect(spark, str(tmp_path / "saved"))
    assert again.meta == collect.meta and isinstance(again.meta.plane, Plane)
    assert again.pulses.count() == NV


def write_sicd(path, kind="R", bits=32, bad_length=False, images=1, shape=(5, 7)):
    rows, cols = shape
    dtype = ">f4" if kind == "R" else ">i2"
    value = np.arange(rows * cols)
    pixels = np.stack([value, -value], axis=1).astype(dtype).tobytes()
    vec = lambda v: vector_xml(v)
    xml = (
        "<SICD><CollectionInfo><CollectorName>X</CollectorName></CollectionInfo><ImageData><SCPPixel><Row>2</Row>"
        f"<Col>3</Col></SCPPixel></ImageData><GeoData><SCP><ECF>{vec(SRP)}</ECF></SCP></GeoData><Grid><Row>"
        f"<UVectECF>{vec((0, 1, 0))}</UVectECF><SS>0.5</SS></Row><Col><UVectECF>{vec((1, 0, 0))}</UVectECF><SS>0.25"
        "</SS></Col></Grid><Timeline><CollectDuration>4.5</CollectDuration></Timeline><RadarCollection><TxFrequency>"
        "<Min>9.5e9</Min><Max>9.7e9</Max></TxFrequency></RadarCollection><SCPCOA><ARPPos>"
        f"{vec((7e6, 0, 0))}</ARPPos><ARPVel>{vec((0, 7000, 0))}</ARPVel><SlantRange>600000</SlantRange>"
        "<IncidenceAng>35</IncidenceAng></SCPCOA></SICD>"
    ).encode()
    subheader = bytearray(b" " * 439)
    subheader[333:349] = b"%08d%08d" % (rows, cols)
    subheader[349:350] = kind.encode()
    subheader[368:370] = b"%02d" % bits
    des_header = b" " * 200
    tables = b"%03d" % images + b"%06d%010d" % (len(subheader), len(pixels)) * images + b"000" * 3
    tables += b"001" + b"%04d%09d" % (len(des_header), len(xml)) + b"000" + b"00000" * 2
    header_length = 342 + 18 + len(tables)
    total = header_length + len(subheader) + len(pixels) + len(des_header) + len(xml)
    total += max(0, 1024 - total)
    head = b"NITF02.10".ljust(342, b"0") + b"%012d%06d" % (total + bad_length, header_length) + tables
    data = head + bytes(subheader) + pixels + des_header + xml
    path.write_bytes(data.ljust(total, b" "))
    return str(path)


@pytest.mark.parametrize("kind, bits", [("R", 32), ("S", 16)])
def test_sicd(spark, tmp_path, kind, bits):
    pixels, meta = read_sicd(spark, write_sicd(tmp_path / "a.nitf", kind, bits))
    assert (meta.n_az, meta.n_rg, meta.az_spacing, meta.rg_spacing) == (7, 5, 0.25, 0.5)
    assert meta.fs_az == pytest.approx(28000.0) and meta.t_dwell == 4.5
    # Pixel (0, 0) is three columns and two rows before the scene centre.
    assert np.allclose(meta.plane.origin, SRP - [0.75, 1.0, 0.0])
    for r in pixels.collect():
        assert r["re"] == r["rg"] * 7 + r["az"] and r["im"] == -r["re"]
    assert read_sicd_meta(str(tmp_path / "a.nitf")) == meta


@pytest.mark.parametrize("options, error", [
    ({"bad_length": True}, FormatFault), ({"kind": "C", "bits": 64}, UnsupportedFault),
    ({"images": 2}, UnsupportedFault),
])
def test_sicd_rejections(tmp_path, options, error):
    with pytest.raises(error):
        read_sicd_meta(write_sicd(tmp_path / "a.nitf", **options))


def test_not_a_nitf(tmp_path):
    path = tmp_path / "a.nitf"
    path.write_bytes(b"x" * 100)
    with pytest.raises(FormatFault):
        read_sicd_meta(str(path))
    path.write_bytes(b"x" * 4000)
    with pytest.raises(FormatFault):
        read_sicd_meta(str(path))
    assert struct.calcsize("<IIQQddddd") == interchange.HEADER.size


# ---- any store, and only what is asked for --------------------------------------------------

STORES = "store_handlers:opened"


@pytest.fixture
def far(spark):
    """A store that only the handler of ``store_handlers`` opens, on the driver and in tasks."""
    import os

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "store_handlers.py"))
    spark.conf.set("spark.sarmotion.store.far", STORES)
    yield lambda path: f"far://{path}"
    spark.conf.unset("spark.sarmotion.store.far")


@pytest.mark.parametrize("scheme", ["file", "far"])
def test_readers_in_any_store(spark, tmp_path, far, scheme):
    at = far if scheme == "far" else lambda path: f"file://{path}"
    columns = ["pulse", "t", "px", "re", "im"]
    path = write_cphd(tmp_path / "a.cphd")
    want = [tuple(r) for r in read_cphd(spark, path).pulses.select(columns).orderBy("pulse").collect()]
    collect = interchange.load_collect(spark, at(path))
    assert [tuple(r) for r in collect.pulses.select(columns).orderBy("pulse").collect()] == want
    assert collect.geometry.count() == NV
    flat = interchange.load_collect(spark, at(write_flat(tmp_path / "a.bin")))
    assert flat.pulses.where("pulse = 5").first()["re"] == [1.0] * 8
    pixels, meta = read_sicd(spark, at(write_sicd(tmp_path / "a.nitf")))
    assert all(r["re"] == r["rg"] * 7 + r["az"] for r in pixels.collect()) and meta.n_az == 7
    slc, ann = write_uavsar(tmp_path)
    pixels, meta = read_uavsar(spark, at(slc), at(ann))
    assert sum(r["re"] for r in pixels.collect()) == sum(range(ROWS * COLS))
    with pytest.raises(IoFault):
        read_header(at(str(tmp_path / "absent.cphd")) if scheme == "file" else str(tmp_path / "absent.cphd"))


def partitions_of(df):
    return df.rdd.getNumPartitions()


def test_filters_on_pulse_and_time_reach_the_reader(spark, tmp_path, monkeypatch):
    from sarmotion.sources import cphd

    monkeypatch.setattr(cphd, "LEAST_BLOCK", 8)
    flags = np.ones(NV, int)
    flags[[0, 9, 10]] = 0
    path = write_cphd(tmp_path / "a.cphd", flags=flags)
    collect = read_cphd(spark, path)
    whole = {r["pulse"]: (r["t"], r["re"]) for r in collect.pulses.collect()}
    assert len(whole) == NV - 3 and partitions_of(collect.pulses) == 8
    strided = read_cphd(spark, path, pulse_stride=5)
    # Nothing of the signal is left but the lines of the first twenty vectors.
    header = read_header(path)
    with open(path, "r+b") as f:
        f.truncate(header.signal_offset + 20 * NS * 8)
    with pytest.raises(Exception, match="shorter than its header says"):
        collect.pulses.collect()
    for condition, holds in (
        ("pulse < 16", lambda p, t: p < 16), ("pulse = 9", lambda p, t: p == 9), ("pulse in (3, 12)", lambda p, t: p in (3, 12)),
        ("t <= 0.0155", lambda p, t: t <= 0.0155), ("t > 0.004 and pulse <= 11 and px < 0", lambda p, t: t > 0.004 and p <= 11),
    ):
        cut = collect.pulses.where(condition)
        assert {r["pulse"]: (r["t"], r["re"]) for r in cut.collect()} == {
            p: v for p, v in whole.items() if holds(p, v[0])}, condition
        assert partitions_of(cut) <= 3, condition
    assert collect.pulses.where("pulse = 1000000").count() == 0
    assert [r["pulse"] for r in strided.pulses.where("pulse between 1 and 2").orderBy("pulse").collect()] == [1, 2]


def test_summary_of_a_collect_does_not_grow_with_it():
    from dataclasses import replace

    from sarmotion.sources import cphd

    h = cphd.CphdHeader("a", 0, 0, 64, 32, 240, "CF8", True, -1.0, 1.0, 1e9, (), (), {})
    for n in (64, 335_141, 10**9):
        block = replace(h, n_vectors=n).block
        assert -(-n // block) <= cphd.MOST_BLOCKS


def test_window_of_the_time_domain_fetches_ranges_of_wide_lines(tmp_path):
    from sarmotion.sources.stores import Location, Ranged

    matrix = np.arange(6 * 100_000, dtype=">f4").reshape(6, 100_000)
    (tmp_path / "m").write_bytes(matrix.tobytes())
    rows, columns = np.array([0, 2, 3, 5]), [(99_990, 100_000), (0, 6)]
    with Ranged(Location(str(tmp_path / "m"))) as file:
        got = file.window(">f4", 0, 100_000, rows, columns)
        assert (got == np.concatenate([matrix[rows, 99_990:], matrix[rows, :6]], axis=1)).all()
        assert (file.rows(">f4", 0, 100_000, rows) == matrix[rows]).all()
        assert file.window(">f4", 0, 100_000, rows[:0], columns).shape == (0, 16)
        assert file.rows(">f4", 0, 100_000, rows[:0]).shape == (0, 100_000)
