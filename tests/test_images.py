import zlib

import numpy as np
import pytest

from tideframe.operators import images, pairs


def test_known_shift():
    page = np.random.default_rng(0).integers(0, 256, (900, 400), dtype=np.uint8)
    dx, dy, response = images.estimate_shift(page[:300], page[60:360])
    assert abs(dy - 60) <= 2 and abs(dx) <= 1 and response > 0.8


def test_shift_of_large_frames():
    page = np.random.default_rng(7).integers(0, 256, (2600, 2400), dtype=np.uint8)
    page = np.kron(page[::8, ::8], np.ones((8, 8), np.uint8))
    dx, dy, response = images.estimate_shift(page[:1200], page[120:1320])
    assert abs(dy - 120) <= 6 and response > 0.7


def test_no_shift_from_flat_or_unlike_frames():
    flat = np.full((300, 400), 7, np.uint8)
    assert images.estimate_shift(flat, flat)[0] < -4  # too far aside to count as a scroll
    assert images.estimate_shift(flat, flat[:200]) == (0.0, 0.0, 0.0)


def planned(spark, dys, height, cap):
    rows = [("s", k, dy, height) for k, dy in enumerate([*dys, None])]
    plan = pairs.stitch_plan(spark.createDataFrame(rows, "run string, idx int, dy double, height int"), "run", cap)
    return [(r["idx"], r["rows"], r["total"]) for r in plan.orderBy("pos").collect()]


def test_stitch(spark):
    page = np.random.default_rng(1).integers(0, 256, (600, 200, 3), dtype=np.uint8)
    down = [page[k : k + 300] for k in (0, 100, 200)]
    made = lambda frames, plan: images.stitch([frames[k] for k, _, _ in plan], [n for _, n, _ in plan])
    assert (made(down, planned(spark, [100.0, 100.0], 300, 20000)) == page[:500]).all()
    assert (made(down[::-1], planned(spark, [-100.0, -100.0], 300, 20000)) == page[:500]).all()
    assert planned(spark, [100.0, 100.0], 300, 350) == [(0, 300, 300), (1, 100, 400)]
    assert planned(spark, [900.0, 0.0, 20.5, 7.0], 300, 610) == [(0, 300, 300), (1, 300, 600), (2, 0, 600), (3, 20, 620)]
    assert planned(spark, [50.0, 60.0], 300, 100) == [(0, 300, 300), (1, 50, 350)]
    assert planned(spark, [], 300, 100) == []
    assert images.stitch(down[:1], [300]) is None and images.stitch([down[0], None], [300, 9]) is None
    assert images.stitch([down[0], down[1][:, :150]], [300, 100]) is None


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pictures_are_read_with_every_filter(tmp_path, channels):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (10, 7, channels))
    lines, above = [], np.zeros((7, channels), int)
    for y, row in enumerate(a):
        left, corner = np.vstack([np.zeros((1, channels), int), row[:-1]]), np.vstack([np.zeros((1, channels), int), above[:-1]])
        guess = left + above - corner
        far = np.abs(np.stack([guess - left, guess - above, guess - corner]))
        near = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        base = [0, left, above, (left + above) // 2, near][y % 5]
        lines.append(bytes([y % 5]) + ((row - base) % 256).astype(np.uint8).tobytes())
        above = row
    plain = images.png_bytes(np.zeros((10, 7, 3), np.uint8))
    head = bytearray(plain[:33])
    head[25] = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    body = zlib.compress(b"".join(lines))
    (tmp_path / "x.png").write_bytes(bytes(head) + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0\0\0\0")
    want = np.repeat(a[:, :, :1], 3, axis=2) if channels < 3 else a[:, :, 2::-1]
    assert (images.read_png(str(tmp_path / "x.png")) == want).all()
    embedder = images.get_embedder("default")
    assert np.allclose(embedder.embed_path(str(tmp_path / "x.png")), embedder.embed(want.astype(np.uint8)))
    (tmp_path / "y.png").write_bytes(b"no picture")
    with pytest.raises(ValueError):
        images.read_png(str(tmp_path / "y.png"))


def test_an_embedder_without_its_packages_says_so():
    with pytest.raises(RuntimeError, match="open_clip"):
        images.get_embedder("clip")


def test_boundaries():
    rng = np.random.default_rng(2)
    a = rng.integers(100, 256, (200, 300, 3), dtype=np.uint8)
    assert images.boundary_metrics(a, a)[:2] == pytest.approx((1.0, 0.0))
    b = a.copy()
    b[50:180] = rng.integers(100, 256, (130, 300, 3), dtype=np.uint8)
    _, drop, top, middle = images.boundary_metrics(a, b)
    assert abs(drop) < 8 and top > 0.99 and middle < 0.6


def test_embedding_is_a_unit_vector():
    a = np.random.default_rng(3).integers(0, 256, (90, 160, 3), dtype=np.uint8)
    v = images.get_embedder("default").embed(a)
    assert v.shape == (1088,) and abs(np.linalg.norm(v) - 1) < 1e-9
    try:
        images.get_embedder("nothing")
    except ValueError as e:
        assert "default" in str(e)
    else:
        raise AssertionError


def test_area_resize_keeps_the_mean():
    a = np.random.default_rng(4).random((37, 53))
    assert abs(images.area_resize(a, 11, 7).mean() - a.mean()) < 1e-9


def test_colour_bins_of_columns(spark):
    rows = [(h, s) for h in range(0, 180, 7) for s in range(0, 256, 15)]
    df = spark.createDataFrame(rows, "h int, s int")
    got = [r[0] for r in df.select(images.color_bin_column(df["h"], df["s"])).collect()]
    assert got == images.color_bin(*np.array(rows).T).tolist()
    assert "Python" not in df.select(images.color_bin_column(df["h"], df["s"]))._jdf.queryExecution().toString()
