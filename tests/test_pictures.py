"""Kernels over pixels against plain loops, and pictures by Spark."""

import colorsys
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import pixels
from orrery.operators import pictures, screens


def noise(n, height, width, seed=1):
    rng = np.random.default_rng(seed)
    blocks = rng.integers(0, 256, (n, -(-height // 5), -(-width // 7), 3), np.uint8)
    return np.repeat(np.repeat(blocks, 5, 1), 7, 2)[:, :height, :width] // np.uint8(2) + rng.integers(0, 120, (n, height, width, 3)).astype(np.uint8)


def grey_of(image):
    return [[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) // 65536 for r, g, b in row] for row in image]


@pytest.mark.parametrize("height, width", [(9, 14), (3, 3), (1, 5), (30, 2), (320, 180)])
def test_brightness_and_edges_equal_loops(height, width):
    frames = noise(3, height, width)
    grey = [grey_of(f) for f in frames]
    for i, g in enumerate(grey):
        flat = [x for row in g for x in row]
        assert pixels.brightness(frames)[i] == pytest.approx(sum(flat) / len(flat) / 255)
        assert pixels.dark(frames, 90)[i] == pytest.approx(sum(x < 90 for x in flat) / len(flat))
        assert pixels.light(frames, 150)[i] == pytest.approx(sum(x >= 150 for x in flat) / len(flat))
        hits = 0
        for y in range(height):
            for x in range(width):
                inner = 0 < y < height - 1 and 0 < x < width - 1
                value = 8 * g[y][x] - sum(g[y + a][x + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) if inner else g[y][x]
                hits += value >= 32
        assert pixels.edges(frames)[i] == pytest.approx(hits / len(flat))


@pytest.mark.parametrize("size, wanted", [((40, 30), (7, 11)), ((10, 9), (20, 9)), ((33, 50), (32, 49)), ((5, 5), (1, 1))])
def test_resizing_equals_a_loop(size, wanted):
    frames = noise(2, *size)

    def line(values, m):
        n, out = len(values), []
        for i in range(m):
            reach = max(n / m, 1.0)
            middle = (i + 0.5) * n / m
            first, last = max(0, int(middle - reach + 0.5)), min(n, int(middle + reach + 0.5))
            w = [max(0.0, 1 - abs((x - middle + 0.5) / reach)) for x in range(first, last)]
            total = sum(round(a / sum(w) * 2**22) * int(values[x]) for a, x in zip(w, range(first, last)))
            out.append(min(255, max(0, (total + 2**21) >> 22)))
        return out

    got = pixels.resized(frames, wanted[1], wanted[0])
    for f, g in zip(frames, got):
        for c in range(3):
            rows = [line(list(row), wanted[1]) if size[1] != wanted[1] else list(map(int, row)) for row in f[..., c]]
            columns = [line(list(col), wanted[0]) if size[0] != wanted[0] else list(col) for col in zip(*rows)]
            assert [list(r) for r in zip(*columns)] == g[..., c].tolist()
    assert pixels.sampled(noise(1, 1000, 400)).shape == (1, 320, 128, 3)


def test_hues_equal_a_loop():
    frames = noise(2, 40, 40, 3)
    for band in (pixels.GREEN, pixels.ORANGE, *pixels.REDS, pixels.COLOURED):
        for i, f in enumerate(frames):
            hits = 0
            for r, g, b in f.reshape(-1, 3).tolist():
                h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
                degrees = int(h * 255 + 1e-9) * 360 / 255
                hits += band[0] <= degrees <= band[1] and int(s * 255 + 1e-9) / 255 >= band[2] and v >= band[3]
            assert abs(pixels.hues(frames, band)[i] - hits / 1600) <= 2 / 1600  # singles against doubles at the borders of a step


def test_runs():
    rng = np.random.default_rng(2)
    mask = rng.random((50, 20)) < 0.6
    want = []
    for i, row in enumerate(mask.tolist()):
        j = 0
        while j < 20:
            k = j
            while k < 20 and row[k]:
                k += 1
            if k > j:
                want.append((i, j, k))
            j = k + 1
    assert list(zip(*(x.tolist() for x in pixels.runs(mask)))) == want


def test_bars_at_shifted_places_and_behind_broad_bands():
    frames = np.full((3, 2424, 1080, 3), (244, 244, 238), np.uint8)
    y = int(0.46 * 2424)
    frames[:2, y : y + 15, 324:756] = (232, 210, 68)
    frames[1, int(0.12 * 2424) : int(0.30 * 2424), 216:864] = (80, 210, 160)
    found = pixels.bar_anchors(frames)
    assert abs(found["anchor_y"][:2] - 0.46).max() < 0.03 and (found["anchor_score"][:2] >= 0.18).all() and math.isnan(found["anchor_y"][2])


def panel(values, lower=False, gap=4, size=(520, 388)):
    """A panel of three bars: labels above tracks of three parts, filled to a value each."""
    width, height = size
    out = np.full((height, width, 3), (250, 250, 246), np.uint8)
    for value, (top, bottom) in zip(values, (pixels.LOWER_BARS if lower else pixels.UPPER_BARS).values()):
        y, end = int(height * top), int(height * bottom)
        out[y + 1 : y + (end - y) // 4, 40:110] = (224, 126, 36)
        row = y + (end - y) * 2 // 3
        for i in range(3):
            left = 46 + i * (118 + gap)
            out[row : row + 8, left : left + 118] = (196, 205, 205)
            out[row : row + 8, left : left + round(118 * max(0, min(5, value - 5 * i)) / 5)] = (224, 126, 36)
    return out


@pytest.mark.parametrize("lower", [False, True])
def test_all_triples_decode(lower):
    """Every triple of values, each bar read on its own: one panel a value and place."""
    for at, key in enumerate(pixels.UPPER_BARS):
        panels = np.stack([panel([v if i == at else 15 - v for i in range(3)], lower) for v in range(16)])
        found = pixels.value_bars(panels)
        assert found[key].tolist() == list(range(16))
    rng = random.Random(4)
    triples = [tuple(rng.randrange(16) for _ in range(3)) for _ in range(60)]
    found = pixels.value_bars(np.stack([panel(t, lower, gap=rng.choice([1, 4, 9])) for t in triples]))
    assert list(zip(*(found[k].tolist() for k in pixels.UPPER_BARS))) == triples


def test_grey_tail_is_not_filled_and_bare_panels_hold_nothing():
    image = np.full((1, 388, 520, 3), (250, 250, 246), np.uint8)
    assert pixels.bar_values(image, (0.12, 0.35)).tolist() == [-1]
    for left, right, colour in ((46, 164, (224, 126, 36)), (168, 289, (224, 126, 36)), (294, 387, (224, 126, 36)), (388, 410, (196, 205, 205))):
        image[:, 97:105, left:right] = colour
    assert pixels.bar_values(image, (0.12, 0.35)).tolist() == [14]
    assert pixels.bar_values(image[:, :10], (0.12, 0.35)).tolist() == [-1]


def test_tabs_at_every_height():
    frames = np.full((300, 400, 200, 3), 250, np.uint8)
    for i in range(300):
        frames[i, 100 + i, 40:90] = 30
    y, score = pixels.tab_anchors(frames, np.full(300, 0.25))
    for i in range(300):
        if int(400 * 0.45) <= 100 + i < int(400 * 0.98):
            assert y[i] == (100 + i) / 400 and score[i] == pytest.approx(1.35 * 50 / 72)
        else:
            assert math.isnan(y[i])
    assert np.isnan(pixels.tab_anchors(frames, np.full(300, np.nan))[0]).all()


def test_bands_and_gaps():
    frames = np.zeros((2, 320, 160, 3), np.uint8)
    for top, high in ((10, 11), (40, 30), (100, 10), (200, 120)):
        frames[0, top : top + high] = 230
    frames[1, 50:90, :50] = 255
    assert pixels.bright_bands(frames).tolist() == [3, 0]
    card = np.full((1, 180, 100, 3), 250, np.uint8)
    card[:, :, 40:58] = 100
    assert pixels.dim_columns(card)[0] == pytest.approx(18 / 90)
    split = np.full((2, 320, 180, 3), 250, np.uint8)
    split[0, 110:140, 80:100] = 20
    split[1, 121:122, 80:100] = 20
    ratio, y = pixels.card_split(split)
    assert ratio.tolist() == [pytest.approx(20 / 162), 0.0] and y.tolist() == [0.38, 0.0]


def test_signals_do_not_depend_on_the_batch():
    frames = noise(6, 64, 48, 8)
    frames[3:] = frames[:1]
    whole = pixels.signals(frames)
    for i in range(6):
        for k, v in pixels.signals(frames[i : i + 1]).items():
            assert v[0] == whole[k][i], k
    assert {"moves_tab_dark_ratio", "tag_edge_ratio"} <= set(whole) and set(screens.signal_names()) - {"sequence_transition_signal"} <= set(whole)


SCHEMA = "source_file string, frame_index long, width int, height int, pixels binary, error int"


def test_pictures_of_several_sizes_and_broken_ones(spark):
    images = [noise(1, h, w, i)[0] for i, (h, w) in enumerate([(20, 30), (40, 25), (20, 30), (1, 1)])]
    rows = [("a", i, x.shape[1], x.shape[0], x.tobytes(), 7) for i, x in enumerate(images)]
    rows += [("a", 9, 20, 30, b"short", 7), ("a", 10, None, 30, b"", 7), ("a", 11, 2, 2, None, 7), ("a", 12, 0, 0, b"", 7)]
    found = {r["frame_index"]: r for r in pictures.signals(spark.createDataFrame(rows, SCHEMA).repartition(2), sample=True).collect()}
    for i, image in enumerate(images):
        want = pixels.signals(image[None])
        assert found[i]["error"] is None and found[i]["pokemon_art_signal"] == want["pokemon_art_signal"][0] and found[i]["iv_attack"] is None
        assert found[i]["sample"] == pixels.motion_samples(image[None])[0].tobytes()
    assert [found[i]["error"] for i in (9, 10, 11, 12)] == ["5 octets for 20 x 30 pixels", "no pixels", "no pixels", "no size"] and found[9]["sample"] is None and found[9]["story_brightness"] is None
    assert pictures.scanned(spark.createDataFrame(rows[4:5], SCHEMA)).first()["raw_classification"] == "error"
    assert pictures.scanned_sequences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_motion_from_pixels(spark):
    images = noise(12, 50, 40, 5)
    rows = [(s, i * 2, 40, 50, images[(i * k) % 12].tobytes(), 0) for s, k, n in (("a", 1, 12), ("b", 5, 7), ("c", 1, 1)) for i in range(n)]
    rows[4] = ("a", 8, 40, 50, None, 0)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r[0], r[1]): (r[2], r[3]) for r in pictures.motion(pictures.motion_samples(df)).collect()}
    samples = {(s, i): None if x is None else pixels.motion_samples(np.frombuffer(x, np.uint8).reshape(1, 50, 40, 3))[0].astype(int) for s, i, _, _, x, _ in rows}
    for (s, i), mine in samples.items():
        for at, other in enumerate((samples.get((s, i - 2)), samples.get((s, i + 6)))):
            want = 0.0 if mine is None or other is None else round(float(np.abs(mine - other).mean()) / 255, 4)
            assert found[s, i][at] == want
    whole = pictures.scanned_sequences(df.union(df)).select("source_file", "frame_index", "previous_frame_delta", "future_frame_delta_3").collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in whole} == found and len(whole) == len(rows)


def png(image):
    """An uncompressed-filter PNG of grey, colour or colour with transparency."""
    height, width, n = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_files_are_pictures(spark, tmp_path):
    from orrery.sources import images

    colour = noise(1, 12, 9)[0]
    grey = colour[..., :1]
    clear = np.concatenate([colour, np.full((12, 9, 1), 255, np.uint8)], 2)
    (tmp_path / "sub").mkdir()
    for name, image in (("c.png", colour), ("sub/g.png", grey), ("a.png", clear)):
        (tmp_path / name).write_bytes(png(image))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    found = {r["source_file"]: r for r in images.read(spark, str(tmp_path)).collect()}
    assert {k: (r["width"], r["height"]) for k, r in found.items()} == {"c.png": (9, 12), "g.png": (9, 12), "a.png": (9, 12), "bad.png": (None, None)}
    assert found["c.png"]["pixels"] == found["a.png"]["pixels"] == colour.tobytes() and found["g.png"]["pixels"] == np.repeat(grey, 3, 2).tobytes()
    signals = {r["source_file"]: r for r in pictures.signals(images.read(spark, str(tmp_path))).collect()}
    assert signals["bad.png"]["error"] == "no pixels" and signals["c.png"]["story_brightness"] == pixels.signals(colour[None])["story_brightness"][0]


def _bars(n):
    frames = np.full((n, 320, 180, 3), 250, np.uint8)
    for i in range(n):
        frames[i, 36 + i % 180 : 36 + i % 180 + i % 19, 40 : 40 + i % 83] = (232, 210, 196)
    return frames


def test_only_what_is_wanted_is_worked_out(monkeypatch):
    frames = np.concatenate([noise(3, 320, 180, 4), _bars(9)])
    whole = pixels.signals(frames)
    for some in (["hp_bar_anchor_y", "hp_bar_anchor_candidate_count"], ["moves_fast_row_dark_ratio"], ["iv_attack", "iv_star_count"], ["hp_area_card_split_signal"], ["tag_edge_ratio", "story_brightness"]):
        found = pixels.signals(frames, some)
        assert list(found) == some and all(np.array_equal(found[k], whole[k]) for k in some)
    for unused in ("resized", "tab_anchors", "stars", "value_bars", "card_split", "edges"):
        monkeypatch.setattr(pixels, unused, None)
    assert pixels.signals(frames, ["hp_bar_anchor_y"])["hp_bar_anchor_y"].tolist() == whole["hp_bar_anchor_y"].tolist()
    with pytest.raises(ValueError):
        pixels.signals(frames, ["no_such_signal"])


def test_a_colour_is_judged_once(monkeypatch):
    seen, judged = [], pixels._judged
    monkeypatch.setattr(pixels, "_table", lambda held=np.zeros(1 << 24, np.uint32): held)
    monkeypatch.setattr(pixels, "_judged", lambda colours: seen.extend(colours.tolist()) or judged(colours))
    frames = noise(4, 40, 30, 6)
    first = pixels.signals(frames)
    assert len(seen) == len(set(seen)) and {int(r) << 16 | int(g) << 8 | int(b) for r, g, b in frames.reshape(-1, 3)} <= set(seen)
    before = len(seen)
    again = pixels.signals(frames)
    assert len(seen) == before and all(np.array_equal(first[k], again[k], equal_nan=True) for k in first)


def test_tasks_grow_with_the_pictures_and_pixels_stay_in_them(spark, monkeypatch):
    from orrery.plans import pictures as plans

    monkeypatch.setattr(plans, "A_TASK", 5)
    made = plans.drawn(spark.range(100).selectExpr("'a' AS source_file", "id AS frame_index", "0 AS paper", "array(array(0, 0, 1, 1, 0)) AS shapes"))
    assert made.rows.rdd.getNumPartitions() == 20 and "pixels" not in made.rows.columns
    found = pictures.signals(made, only=["detail_card_brightness"])
    assert found.columns == ["source_file", "frame_index", "detail_card_brightness", "error"] and found.where("detail_card_brightness = 0 AND error IS NULL").count() == 100


def test_equal_pictures_are_judged_once_a_stack():
    images, stack = noise(2, 20, 30), pictures._Stack()
    for i in range(9):
        stack.add(("a", i), 30, 20, images[int(i % 3 == 0)].tobytes())
    stack.add(("b", 0), 20, 30, images[0].tobytes())  # the same octets, another size
    groups = [(keys[1].to_pylist(), frames, at.to_pylist()) for keys, frames, at in stack.groups()]
    assert [(rows, frames.shape[0], at) for rows, frames, at in groups] == [([*range(9)], 2, [0, 1, 1, 0, 1, 1, 0, 1, 1]), ([0], 1, [0])]
    assert (groups[0][1] == images[[1, 0]]).all()


def test_lines_that_repeat_are_weighted_as_others(monkeypatch):
    image = np.repeat(noise(1, 6, 162), 40, 1)[0].reshape(240, -1)
    whole, lone = pixels._filtered(image, pixels._wide_taps(162, 160, 3), 1), [pixels._filtered(line[None], pixels._wide_taps(162, 160, 3), 1)[0] for line in image]
    assert (whole == np.array(lone)).all()
    seen = []
    monkeypatch.setattr(pixels.np, "cumsum", lambda x, f=np.cumsum: seen.append(np.count_nonzero(x)) or f(x))
    pixels._filtered(image, pixels._wide_taps(162, 160, 3), 1)
    assert seen == [6]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50])
def test_motion_over_batches_of_any_size(cut):
    rng = random.Random(cut)
    rows = [(s, i, None if rng.random() < 0.1 else bytes(rng.choices((0, 9, 200), k=pictures.SAMPLE))) for s, n in (("a", 1), ("b", 2), ("c", 9), ("d", 3), ("e", 4), ("f", 21)) for i in range(n)]
    twice = [r for r in rows for _ in range(rng.choice((1, 1, 1, 3)))]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*twice[at : at + cut]), (pa.string(), pa.int64(), pa.binary()))], [*pictures.KEYS, "sample"]) for at in range(0, len(twice), cut)]
    found = [r for b in pictures._moving(iter(batches)) for r in b.to_pylist()]

    def delta(k, other):
        if not 0 <= other < len(rows) or rows[k][0] != rows[other][0] or rows[k][2] is None or rows[other][2] is None:
            return 0.0
        return round(sum(abs(x - y) for x, y in zip(rows[k][2], rows[other][2])) / pictures.SAMPLE / 255, 4)

    assert [(r["source_file"], r["frame_index"], r["previous_frame_delta"], r["future_frame_delta_3"]) for r in found] == [(*rows[k][:2], delta(k, k - 1), delta(k, k + 3)) for k in range(len(rows))]
    assert list(pictures._moving(iter([]))) == []


def test_sequences_of_pictures_equal_their_sql_on_odd_tables(spark, tmp_path):
    """Short appraisals between dark frames, which are motion; repeated keys; null and negative ones; null sources."""
    import duckdb

    from orrery.plans import REGISTRY

    odd = {1: [300, 301, 302, 600, 601, 700, 701, 702, 703, 1100, 1000, 900], 2: [100, 100, 100, 205, 205, 300, 501], 3: [None, None, 120, 250, -150, -250, -50], None: [150, 151, 210, 510, None], 4: [1 << 40, (1 << 40) + 100]}
    spark.createDataFrame([(k, n) for n, keys in odd.items() for k in keys], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    query, sql = REGISTRY["q_picture_sequences"]
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.execute(sql).fetchall(), key=repr)
    assert len(want) == 33 and ("1", 600, 0) in want
    assert sorted(map(tuple, query(spark, str(tmp_path)).select("source_file", "frame_index", "seq").collect()), key=repr) == want
