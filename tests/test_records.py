"""Record files: checksums and bytes against fixed values, round trips, damage in every place, and steps."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import crc, examples
from trajecta.sources import records


def test_checksums():
    assert crc.crc32c(b"123456789") == 0xE3069283 and crc.crc32c(b"") == 0 and crc.crc32c(bytes(32)) == 0x8A9136AA and crc.crc32c(bytes([255]) * 32) == 0x62A8AB43
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 3, 63, 64, 65, 1023, 1024, 1025, 4096, 70_001, 5)]
    assert crc.crc32c_many(parts).tolist() == [crc.crc32c(p) for p in parts]
    assert crc.crc32c_many([b"ab", b""]).tolist() == [crc.crc32c(b"ab"), 0]
    data = np.frombuffer(rng.randbytes(40), np.uint8)
    assert crc.masked_windows(data).tolist() == [int(crc.masked(crc.crc32c(data[i : i + 8].tobytes()))) for i in range(33)]
    assert int(crc.masked(0)) == 0xA282EAD8 and len(crc.masked_windows(data[:5])) == 0


def test_wire_format():
    """A record that was written by hand after the published message definition."""
    by_hand = bytes.fromhex("0a0d0a0b0a016112061a040a020102")
    assert examples.record({"a": ("int", [1, 2])}) == by_hand
    kind, values = examples.parsed(by_hand)["a"]
    assert kind == "int" and values.tolist() == [1, 2]
    given = {"x/é": ("float", np.float32([1.5, -2, 3e38])), "n": ("int", [0, -1, 300, 2**62, -(2**63)]), "b": ("bytes", [b"", b"\xff\x00", b"x" * 300]), "none": ("int", []), "empty": ("bytes", [])}
    got = examples.parsed(examples.record(given))
    assert {k: (v[0], list(v[1])) for k, v in got.items()} == {k: (v[0], list(v[1])) for k, v in given.items()}
    loose = bytes.fromhex("0a110a0f0a017112") + bytes([10]) + bytes.fromhex("1a080801080208ac02")[:9] + b"\x08"  # not packed, cut off at the end
    with pytest.raises(ValueError):
        examples.parsed(loose)
    unpacked = b"\x08\x01\x08\xac\x02"
    entry = b"\x0a\x01q\x12" + bytes([len(unpacked) + 2]) + b"\x1a" + bytes([len(unpacked)]) + unpacked
    body = b"\x0a" + bytes([len(entry)]) + entry
    assert examples.parsed(b"\x0a" + bytes([len(body)]) + body)["q"][1].tolist() == [1, 300]


SCHEMA = "id long, name string, raw binary, v array<float>, d array<double>, n array<int>, texts array<string>, blobs array<binary>, one double"


def rows(n=60):
    rng = random.Random(2)
    out = []
    for i in range(n):
        v = [float(np.float32(rng.random())) for _ in range(i % 7)]
        out.append((i, None if i % 5 == 0 else f"é{i}", bytes([i]) * (i * 40), v, v or None, [i, -i], ["a", ""] * (i % 3), [b"\x00", b"y" * i], 0.5 if i % 2 else None))
    return out


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    records.write_records(df, path)
    assert len(os.listdir(tmp_path / "set")) == 3
    got = records.read_records(spark, path, SCHEMA)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert sorted(r.id for r in records.read_records(spark, path, "id long, missing array<float>").where("missing is null").collect()) == list(range(60))
    records.write_records(df.where("id < 5"), path, "append")
    assert records.read_records(spark, path, "id long").count() == 65
    records.write_records(df.where("id < 5"), path)
    assert records.read_records(spark, path, "id long").count() == 5
    records.write_records(df.where("false"), path)
    assert records.read_records(spark, path, "id long").count() == 0


def test_small_files_share_a_task(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    records.write_records(spark.range(100).repartition(8), path)
    size = max(os.path.getsize(tmp_path / "set" / f) for f in os.listdir(tmp_path / "set"))
    read = lambda n: spark.read.format(records.FORMAT).schema("id long").option("partitionBytes", n).load(path)
    assert read(1).rdd.getNumPartitions() == 8 and read(size * 100).rdd.getNumPartitions() == 1 and read(size * 2).rdd.getNumPartitions() in (3, 4)
    assert sorted(r.id for r in read(size * 2).collect()) == list(range(100))


def file_of(payloads):
    sums = lambda b: int(crc.masked(crc.crc32c(b)))
    return [examples.framed(p, (sums(struct.pack("<Q", len(p))), sums(p))) for p in payloads]


DAMAGED = "id long, _corrupt_record string"


@pytest.mark.parametrize("kind", ["data", "length", "lengths", "cut", "cut header", "nonsense", "type", "huge"])
def test_damage(spark, tmp_path, kind):
    good = [examples.record({"id": ("int", [i]), "pad": ("bytes", [bytes(i * 90)])}) for i in range(30)]
    parts, lost, bad = file_of(good), {7}, 1
    if kind == "data":
        parts[7] = parts[7][:40] + bytes([parts[7][40] ^ 4]) + parts[7][41:]
    elif kind in ("length", "lengths"):
        for i in (7, 8)[: 1 + (kind == "lengths")]:
            parts[i] = bytes([parts[i][0] ^ 1]) + parts[i][1:]
        lost = {7, 8} if kind == "lengths" else {7}
    elif kind == "cut":
        parts, lost = [*parts[:29], parts[29][:-9]], {29}
    elif kind == "cut header":
        parts, lost = [*parts, b"\x01\x02\x03"], set()
    elif kind == "nonsense":
        parts[7] = file_of([b"\xff\xff\xff no message"])[0]
    elif kind == "type":
        parts[7] = file_of([examples.record({"id": ("bytes", [b"7"])})])[0]
    elif kind == "huge":
        header = struct.pack("<Q", 1 << 60)
        parts[7] = header + struct.pack("<I", int(crc.masked(crc.crc32c(header)))) + parts[7][12:]
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "a.records").write_bytes(b"".join(parts))
    (folder / "_ignored").write_bytes(b"not data")
    path = f"file://{folder}"
    got = records.read_records(spark, path, DAMAGED).collect()
    assert {r.id for r in got if r.id is not None} == set(range(30)) - lost
    wrong = [r._corrupt_record for r in got if r.id is None]
    assert len(wrong) == bad and "a.records" in wrong[0] and all(r._corrupt_record is None for r in got if r.id is not None)
    assert records.read_records(spark, path, "id long", "DROPMALFORMED").count() == 30 - len(lost)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(spark, path, "id long", "FAILFAST").collect()


def test_options(spark, tmp_path):
    for schema, mode, text in (("id map<string,int>", "PERMISSIVE", "no feature"), ("id long", "LOOSE", "mode is one of")):
        with pytest.raises(Exception, match=text):
            records.read_records(spark, f"file://{tmp_path}", schema, mode).collect()
    with pytest.raises(Exception, match="absent"):
        records.read_records(spark, f"file://{tmp_path}/absent", "id long").collect()
    with pytest.raises(Exception, match="nulls"):
        records.write_records(spark.createDataFrame([([1, None],)], "v array<long>"), f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists() or not os.listdir(tmp_path / "x")


def test_steps(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0], ["x", "y"], None), ("b", [], [], None), ("c", None, None, None)], "name string, `s/v` array<double>, `s/x` array<string>, `s/z` array<long>")
    got = records.steps(df, {"s/v": 2, "s/x": 0, "s/z": 3}, {"key": "name"})
    assert got.columns == ["key", "t", "s/v", "s/x", "s/z"]
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, [1.0, 2.0], "x", None), ("a", 1, [3.0, 4.0], "y", None)]
    with pytest.raises(Exception, match="unequal"):
        records.steps(df.where("name = 'a'").withColumn("s/x", F.array(F.lit("x"))), {"s/v": 2, "s/x": 0}).collect()
