"""Round trips through the scan-file codec, source and sink."""

import math
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.sources import codec, e2807
from lacuna.sources.codec import Field, FormatError, Paged, Scan


def ints(n, low, high, seed):
    return np.random.default_rng(seed).integers(low, high, n, endpoint=True)


def packed_file(n=977, **how):
    fields = [Field("cartesianX", "ScaledInteger", -262144, 262143, 1e-4), Field("cartesianY", "ScaledInteger", -262144, 262143, 1e-4), Field("intensity", "Integer", 0, 2047)]
    raw = [ints(n, -262144, 262143, 1), ints(n, -262144, 262143, 2), ints(n, 0, 2047, 3)]
    return codec.write([(Scan(fields, n, 0, name="a"), raw)], **{"per_packet": 7} | how), raw


def test_checksum_and_bits():
    assert codec.crc32c(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xE3069283
    assert [codec.bits_needed(*x) for x in ((0, 0), (0, 1), (0, 2047), (-262144, 262143), (codec.LONG_MIN, codec.LONG_MAX), (5, 3))] == [0, 1, 11, 19, 64, 0]
    assert all(codec.to_logical(codec.to_physical(n)) == n for n in (0, 1019, 1020, 1021, 99_999))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 30))
def test_unpack_is_the_reverse_of_pack(bits, values, skip):
    values = np.array(values, np.uint64) & np.uint64((1 << bits) - 1)
    skip = min(skip, len(values) - 1)
    assert (codec.unpack(codec.pack(values, bits), bits, skip * bits, len(values) - skip) == values[skip:]).all()


def test_values_straddle_packets():
    data, raw = packed_file()
    assert 7 * 19 % 8, "the premise: packets end within a value"
    file = Paged(data)
    (scan,) = codec.catalogue(file)
    got = codec.decode(file, scan, ["cartesianX", "intensity"])
    assert np.allclose(got["cartesianX"], raw[0] * 1e-4) and (got["intensity"] == raw[2]).all()
    for low, high in ((0, 1), (3, 11), (500, 977), (976, 2000)):
        part = codec.decode(file, scan, ["cartesianY"], low, high)["cartesianY"]
        assert np.allclose(part, raw[1][low:high] * 1e-4)


def test_mixed_types_constant_and_missing_fields():
    n = 1500
    fields = [Field("cartesianX"), Field("intensity", precision="single"), Field("cartesianInvalidState", "Integer", 0, 2), Field("rowIndex", "Integer", 7, 7)]
    values = [1e6 + np.arange(n) / 1024, np.arange(n) / 8, ints(n, 0, 2, 4), np.full(n, 7)]
    file = Paged(codec.write([(Scan(fields, n, 0), values)], 33))
    (scan,) = codec.catalogue(file)
    got = codec.decode(file, scan, ["rowIndex", "cartesianX", "cartesianInvalidState", "intensity"])
    assert all((got[f.name] == v).all() for f, v in zip(fields, values))
    assert (codec.decode(file, scan, ["rowIndex"])["rowIndex"] == 7).all()
    with pytest.raises(FormatError, match="no field colorRed"):
        codec.decode(file, scan, ["colorRed"])


def test_metadata_and_several_scans():
    one = Field("cartesianX", "ScaledInteger", -100000, 100000, 0.001)
    scans = [(Scan([one], n, 0, f"g{k}", f"s & <{k}>", k > 0, [0.7071, 0, 0, 0.7071], [10.0 * k, -78.9, 2.5], [0, 2047, 0, 4095] if k == 1 else None, [-1.0, 1.0, -2.0, 2.0, -3.0, 3.0] if k == 2 else None, k == 3), [ints(n, -100000, 100000, k)]) for k, n in enumerate((300, 351, 402, 453))]
    file = Paged(codec.write(scans, 17))
    got = codec.catalogue(file)
    for (want, columns), s in zip(scans, got):
        assert (s.name, s.has_pose, s.index_bounds, s.bounds, s.grouping, s.records) == (want.name, want.has_pose, want.index_bounds, want.bounds, want.grouping, want.records)
        assert s.t == (want.t if want.has_pose else [0.0] * 3)
        assert np.allclose(codec.decode(file, s, ["cartesianX"])["cartesianX"], columns[0] * 0.001)


def test_long_integers_and_no_records():
    values = np.array([codec.LONG_MIN, codec.LONG_MAX, 0, -1])
    file = Paged(codec.write([(Scan([Field("a", "Integer")], 4, 0), [values]), (Scan([Field("a")], 0, 0), [np.zeros(0)])], 3))
    full, empty = codec.catalogue(file)
    assert (codec.decode(file, full, ["a"])["a"] == values.astype(float)).all() and len(codec.decode(file, empty, ["a"])["a"]) == 0


def test_restarts_and_packets_without_data():
    skip = struct.pack("<BBH", codec.IGNORED, 0, 7) + b"\0" * 4
    fields, n = [Field("a", "Integer", 0, 2**11 - 1), Field("b")], 400
    values = [ints(n, 0, 2**11 - 1, 9), np.arange(n) / 3]
    file = Paged(codec.write([(Scan(fields, n, 0), values)], 16, restart_every=2, extra=skip))
    (scan,) = codec.catalogue(file)
    kinds = [p.type for p in codec.packets(file, scan)]
    assert codec.IGNORED in kinds and any(p.flags for p in codec.packets(file, scan))
    got = codec.decode(file, scan, ["a", "b"])
    assert (got["a"] == values[0]).all() and (got["b"] == values[1]).all()
    assert (codec.decode(file, scan, ["a", "b"], 30, 70)["a"] == values[0][30:70]).all()


def test_malformed():
    data, _ = packed_file()
    bad = bytearray(data)
    bad[3000] ^= 1
    stored, computed = codec.pages(bytes(bad))
    assert np.flatnonzero(stored != computed).tolist() == [2]
    with pytest.raises(FormatError, match="signature"):
        codec.catalogue(Paged(b"\xab" * 4096))
    with pytest.raises(FormatError, match="whole number of pages"):
        codec.pages(data[:-1])
    with pytest.raises(FormatError, match="shorter"):
        Paged(b"")
    file = Paged(data)
    (scan,) = codec.catalogue(file)
    scan.records = 2000
    with pytest.raises(FormatError, match="decoded 97. of 2000"):
        codec.decode(file, scan, ["cartesianX"])


def test_source_and_sink(spark, tmp_path):
    e2807.register(spark)
    data, raw = packed_file()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.e57").write_bytes(data)
    (tmp_path / "in" / "b.e57").write_bytes(b"\xab" * 4096)
    read = lambda mode, **o: spark.read.format("e2807").options(mode=mode, **o).load(str(tmp_path / "in"))
    assert read("files", on_error="PERMISSIVE").first().scan_count == 1
    scan = read("scans", on_error="PERMISSIVE").first()
    assert (scan.name, scan.record_count, [f.bits for f in scan.proto]) == ("a", 977, [19, 19, 11])
    points = read("points", on_error="PERMISSIVE", fields="cartesianX,colorRed", records_per_task="100")
    got = sorted((r.record_idx, r.cartesianX, r.colorRed) for r in points.collect())
    assert len(got) == 977 and all(math.isclose(x, raw[0][i] * 1e-4) and c is None for i, x, c in got)
    assert read("packets", on_error="PERMISSIVE").count() == 140 and read("pages").where("stored <> computed").count() == 4
    for options in ({"fields": "cartesianX"}, {"fields": "colorRed", "strict": "true", "on_error": "FAILFAST"}):
        with pytest.raises(Exception, match="signature|no field"):
            read("points", **options).collect()
    frame = spark.range(1000).selectExpr("id * 0.5 AS cartesianX", "CAST(id % 3 AS DOUBLE) AS cartesianInvalidState").repartition(3)
    out = str(tmp_path / "out")
    frame.write.format("e2807").option("prototype", e2807.proto_json([Field("cartesianX"), Field("cartesianInvalidState", "Integer", 0, 2)])).mode("append").save(out)
    assert len(os.listdir(out)) == 3
    back = spark.read.format("e2807").option("fields", "cartesianX,cartesianInvalidState").load(out)
    assert sorted((r.cartesianX, r.cartesianInvalidState) for r in back.collect()) == sorted((r.cartesianX, r.cartesianInvalidState) for r in frame.collect())
    by_spark = e2807.read_binary(spark.read.format("binaryFile").load(out), ["cartesianX"])
    assert by_spark.count() == 1000


def test_sessions_of_several_files(spark, tmp_path):
    from lacuna.operators import load

    r, az, el = np.array([2.0, 3.0]), np.array([0.5, -1.0]), np.array([0.25, -0.75])
    cartesian = (Scan([Field("cartesianX"), Field("cartesianY"), Field("cartesianZ"), Field("sphericalRange"), Field("intensity")], 2, 0, name="c"), [r, az, el, r, r])
    spherical = (Scan([Field("sphericalRange"), Field("sphericalAzimuth"), Field("sphericalElevation"), Field("sphericalInvalidState", "Integer", 0, 2)], 2, 0, name="s"), [r, az, el, np.array([0, 2])])
    nowhere = (Scan([Field("intensity")], 2, 0, name="n"), [r])
    one, two, bad = (str(tmp_path / f"{n}.e57") for n in ("one", "two", "bad"))
    for path, data in ((one, codec.write([cartesian, spherical])), (two, codec.write([nowhere, cartesian])), (bad, b"\xab" * 4096)):
        with open(path, "wb") as f:
            f.write(data)
    scans, points = load.session(spark, [one, bad])
    assert [(s.scan_id, s.name, s.position_system) for s in scans.orderBy("scan_id").collect()] == [(0, "c", "cartesian"), (1, "s", "spherical")]
    got = {(p.scan_id, p.record_idx): p for p in points.collect()}
    assert len(got) == 4 and (got[0, 1].x, got[0, 1].y, got[0, 1].invalid_state, got[0, 1].intensity) == (3.0, -1.0, None, 3.0)
    assert math.isclose(got[1, 0].x, 2 * math.cos(0.25) * math.cos(0.5)) and (got[1, 1].invalid_state, got[1, 1].red) == (2, None)
    more = load.append((scans, points), load.session(spark, [two]))
    assert sorted((s.scan_id, s.name) for s in more[0].collect()) == [(0, "c"), (1, "s"), (2, "n"), (3, "c")]
    assert sorted({p.scan_id for p in more[1].collect()}) == [0, 1, 3]
    blocks = load.blocks(points.select("x"), lambda b: b if b.num_rows > 1 else None, "x double")
    assert {p.x for p in blocks.collect()} <= {p.x for p in got.values()}
    audit = {os.path.basename(a.path): a for a in load.read(spark, [one, bad], "audit").collect()}
    assert audit["bad.e57"].error.startswith("bad signature") and audit["one.e57"].error is None


def test_files_by_key_hold_their_catalogue(spark, tmp_path):
    import json

    e2807.register(spark)
    frame = spark.range(40).selectExpr("id % 2 AS k", "id * 1.0 AS cartesianX")
    headers = {"0": {"name": "even", "grouping": True, "index_bounds": [1, 2, 3, 4]}, "1": {"name": "odd", "has_pose": True, "t": [1.0, 2.0, 3.0], "bounds": [0.0, 39.0, 0.0, 0.0, 0.0, 0.0]}}
    out = str(tmp_path / "keyed")
    frame.coalesce(1).write.format("e2807").option("key", "k").option("scans", json.dumps(headers)).mode("append").save(out)
    found = spark.read.format("e2807").option("mode", "scans").load(out).orderBy("path").collect()
    assert [(s.name, s.record_count, s.has_point_grouping, s.col_max, s.has_pose, s.x_max) for s in found] == [("even", 20, True, 4, False, None), ("odd", 20, False, None, True, 39.0)]


def test_a_file_written_as_records_come(tmp_path):
    fields = [Field("cartesianX"), Field("intensity", "Integer", 0, 2047), Field("cartesianInvalidState", "Integer", 0, 2), Field("rowIndex", "Integer", 7, 7), Field("colorRed", precision="single")]
    for n in (0, 1, 8, 55, 56, 57, 1000):
        values = [np.arange(n) / 7, ints(n, 0, 2047, 1), ints(n, 0, 2, 2), np.full(n, 7), np.arange(n) / 8]
        for k, steps in enumerate((56, 8)):
            path = str(tmp_path / f"{n}-{k}.e57")
            file = codec.ScanFile(path, Scan(fields, 0, 0, "g", "s & t", True), 7)
            for a in range(0, n, steps):
                file.add([v[a : a + steps] for v in values], len(values[0][a : a + steps]))
            file.close()
            with open(path, "rb") as f:
                data = f.read()
            if steps == 56:
                assert data == codec.write([(Scan(fields, n, 0, "g", "s & t", True), values)], 7)
            stored, computed = codec.pages(data)
            assert (stored == computed).all()
            file = Paged(data)
            (scan,) = codec.catalogue(file)
            got = codec.decode(file, scan, [f.name for f in fields])
            assert scan.records == n and all((got[f.name] == v).all() for f, v in zip(fields, values))


def test_a_task_holds_little_of_its_scans(tmp_path):
    """Its scans mixed with each other, and many times what is held back."""
    import json
    import tracemalloc

    import pyarrow as pa

    n, k = 20_000, 60
    headers = {str(i): {"name": f"s{i}", "fields": [{"name": "cartesianX"}]} for i in range(3)}

    def batches():
        for b in range(k):
            at = np.arange(b * n, b * n + n)
            yield pa.record_batch([pa.array([None if x % 1000 == 0 else int(x % 3) for x in at], pa.int32()), pa.array(at / 4)], names=["k", "cartesianX"])

    writer = e2807.Writer({"path": str(tmp_path / "out"), "key": "k", "scans": json.dumps(headers)}, ["k", "cartesianX"])
    pa_before, most = pa.total_allocated_bytes(), 0

    def watched():
        nonlocal most
        for b in batches():
            most = max(most, pa.total_allocated_bytes() - pa_before)
            yield b

    tracemalloc.start()
    writer.write(watched())
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.7 * n * k * 12
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 4 and all(x.endswith(".e57") for x in names)
    got = {}
    for name in names:
        file = e2807.open_file(str(tmp_path / "out" / name))
        (scan,) = codec.catalogue(file)
        got[scan.name if scan.name in ("s0", "s1", "s2") else "none"] = codec.decode(file, scan, ["cartesianX"])["cartesianX"]
    at = np.arange(n * k)
    for i in range(3):
        assert (got[f"s{i}"] == at[(at % 3 == i) & (at % 1000 > 0)] / 4).all()
    assert (got["none"] == at[at % 1000 == 0] / 4).all()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lacuna.operators.graph import shared_dir

    session = lambda master, named: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named}))
    assert shared_dir(session("spark://host:7077", "file:///shared")) == "file:///shared"
    assert os.path.isdir(shared_dir(session("local[4]", None)))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            shared_dir(session(master, None))
