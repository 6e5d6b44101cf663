"""Video files: frames of files made by the test, damage, cameras by name, and lock-step against a plain version."""

import random
import struct

import pytest

from trajecta.functions import mp4
from trajecta.sources import video


def parts(n, seed=0):
    rng = random.Random(seed)
    return [rng.randbytes(rng.randint(0, 50)) for _ in range(n)]


@pytest.mark.parametrize("n, chunk", [(0, 3), (1, 8), (8, 8), (9, 8), (23, 5), (4, 1)])
def test_frames_of_a_file(n, chunk):
    given = parts(n)
    content = mp4.muxed(given, 30, "mjpa", 64, 48, keys=range(0, n, 3), chunk=chunk)
    (t,) = mp4.tracks(content)
    assert [content[o : o + s] for o, s in zip(t.offset, t.size)] == given
    assert t.time.tolist() == [pytest.approx(i / 30) for i in range(n)] and t.key.tolist() == [i % 3 == 0 for i in range(n)]
    assert n == 0 or (t.codec, t.width, t.height) == ("mjpa", 64, 48)


def test_frames_are_in_the_order_shown():
    """Stored I P B B, shown I B B P."""
    given = [b"I", b"P", b"B1", b"B2"]
    content = mp4.muxed(given, 10, shown=[0, 2, -1, -1])
    (t,) = mp4.tracks(content)
    assert [content[o : o + s] for o, s in zip(t.offset, t.size)] == [b"I", b"B1", b"B2", b"P"] and t.time.tolist() == [0.0, 0.1, 0.2, 0.3]


def test_other_forms_of_boxes():
    content = mp4.muxed([b"a"] * 3, 10)
    free = struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    moved = content[:20] + free + content[20:]
    (t,) = mp4.tracks(moved)
    assert (t.offset + 20 <= len(moved)).all() and len(t.size) == 3
    at = content.index(b"stsz") + 8
    fixed = content[:at] + struct.pack(">I", 1) + content[at + 4 :]
    assert mp4.tracks(fixed)[0].size.tolist() == [1, 1, 1]
    sound = content.replace(b"vide", b"soun")
    assert mp4.tracks(sound) == []
    last = content[: content.index(b"mdat") - 4] + struct.pack(">I", 0) + content[content.index(b"mdat") :]
    assert len(mp4.tracks(last)[0].size) == 3


def test_every_cut_and_many_changes_are_errors_or_frames():
    content = mp4.muxed(parts(9), 10, keys=[0, 4], chunk=2)
    for end in range(len(content)):
        with pytest.raises(ValueError):
            mp4.tracks(content[:end])
    rng = random.Random(1)
    for _ in range(600):
        changed = bytearray(content)
        changed[rng.randrange(len(content) - 300)] = rng.randrange(256)
        try:
            for t in mp4.tracks(bytes(changed)):
                assert (t.offset + t.size <= len(changed)).all()
        except ValueError:
            pass
    with pytest.raises(ValueError, match="fragments"):
        mp4.tracks(content + struct.pack(">I4s", 8, b"moof"))


def test_files_below_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    given = parts(12, 3)
    (tmp_path / "a" / "22008760.mp4").write_bytes(mp4.muxed(given, 15, keys=[0]))
    (tmp_path / "a" / "22008760-stereo.mp4").write_bytes(mp4.muxed(given[:2], 15))
    (tmp_path / "b-24400334.mp4").write_bytes(mp4.muxed(given[:5], 15))
    (tmp_path / "bad.mp4").write_bytes(b"no video at all")
    (tmp_path / "other.txt").write_text("x")
    found = video.read_videos(spark, f"file://{tmp_path}", data=True)
    assert found.where("error IS NOT NULL").count() == 1 and found.count() == 12 + 2 + 5 + 1
    got = video.by_camera(found, {"22008760": "wrist", "24400334": "side"})
    by = {c: [bytes(r.data) for r in sorted(got.where(f"camera = '{c}'").collect(), key=lambda r: r.frame)] for c in ("wrist", "side")}
    assert by == {"wrist": given, "side": given[:5]}
    side = video.lockstep(got.selectExpr("1 AS e", "camera", "frame", "size"), "e", "camera", "frame", "size", ["wrist", "side"])
    assert sorted((r.frame, r.wrist, r.side) for r in side.collect()) == [(i, len(given[i]), len(given[i])) for i in range(5)]
    none = spark.createDataFrame([(1, None), (2, b"")], "id int, content binary")
    assert [(r.id, r.error) for r in video.frames(none, keys=["id"]).collect()] == [(2, "no index")]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_lockstep(spark, block):
    rng = random.Random(block)
    rows = []
    for e in (*range(30), None):
        for c in ("a", "b", "c")[: 3 if e is None or e % 6 else 2]:
            n = rng.randint(0, 14)
            rows += [(e, c, i, rng.randint(0, 9), rng.random() > 0.05) for i in range(n) if rng.random() > 0.05]
    rows += [(1, "a", 0, 99, True), (1, "z", 0, 1, True), (2, "a", None, 1, True), (2, "a", -1, 1, True)]
    want = []
    for e in {r[0] for r in rows}:
        of = {c: {} for c in "abc"}
        for _, c, i, v, good in (r for r in rows if r[0] == e):
            if c in of and good and i is not None:
                of[c][i] = min(v, of[c].get(i, v))
        i = 0
        while all(i in of[c] for c in "abc"):
            want.append((e, i, *(of[c][i] for c in "abc")))
            i += 1
    df = spark.createDataFrame(rows, "e int, c string, i int, v int, good boolean").repartition(3)
    got = video.lockstep(df, "e", "c", "i", "v", ["a", "b", "c"], "good", block)
    assert got.columns == ["e", "i", "a", "b", "c"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
