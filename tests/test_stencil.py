"""Kernels against plain loops, and the window's rules."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermolith.operators import clusters, saturation, stencil, tiles
from thermolith.operators.windows import tile_windows


def plain_deviation(window, y, x):
    sums, counts = {"close": 0, "far": 0}, {"close": 0, "far": 0}
    depth, h, w = window.shape
    for back in range(3):
        for dy in range(-4, 5):
            for dx in range(-4, 5):
                d = back + abs(dy) + abs(dx)
                if d > 4:
                    continue
                kind = "close" if d <= 2 else "far"
                counts[kind] += 1
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    sums[kind] += int(window[depth - 1 - back, y + dy, x + dx])
    return abs(sums["close"] / counts["close"] - sums["far"] / counts["far"])


def test_counts():
    assert (stencil.CLOSE_COUNT, stencil.FAR_COUNT) == (19, 60)


@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 1 << 30))
@settings(max_examples=25, deadline=None)
def test_kernel_equals_loops(h, w, seed):
    window = np.random.default_rng(seed).integers(0, 65536, (3, h, w))
    found = stencil.window_deviations(window[None])[0]
    for y in range(h):
        for x in range(w):
            assert found[y, x] == plain_deviation(window, y, x)


def test_centre_bounds_and_strict_threshold():
    edges = np.array([[5000, 5001, 64999, 65000, 65001]], np.uint16)
    flat = np.zeros((2, 1, 5), np.uint16)
    y, x, d = stencil.outliers_in([*(a.tobytes() for a in flat), edges.tobytes()], 1, 5)
    assert set(x.tolist()) <= {1, 2}
    assert all(v > 6000 for v in d)
    # 6000 exactly: 19 close values that sum to 19 * 6000, nothing else
    window = np.zeros((3, 9, 9), np.uint16)
    window[2, 4, 4] = 19 * 3000
    window[1, 4, 4] = 19 * 3000
    y, x, d = stencil.outliers_in([a.tobytes() for a in window], 9, 9)
    assert (4, 4) not in zip(y.tolist(), x.tolist(), strict=True)
    assert stencil.window_deviations(window[None])[0, 4, 4] == 6000.0


def test_ties_in_row_major_order():
    window = np.full((3, 8, 8), 60000, np.uint16)
    y, x, d = stencil.outliers_in([a.tobytes() for a in window], 8, 8)
    rows = list(zip((-d).tolist(), y.tolist(), x.tolist(), strict=True))
    assert rows == sorted(rows) and len(set(d.tolist())) < len(d)


def packed_rows(spark, rows):
    schema = "batch_id bigint, print_id string, tile_id bigint, layer bigint, height int, width int, pixels binary"
    return spark.createDataFrame(rows, schema)


def test_short_windows_late_layers_and_gaps(spark):
    rng = np.random.default_rng(5)
    image = [rng.integers(5001, 65000, (6, 6)).astype("<u2") for _ in range(5)]
    layers = [0, 7, 3, 7, 12]  # out of order, repeated, with gaps
    rows = [(i, "p", 0, layer, 6, 6, bytearray(m.tobytes())) for i, (layer, m) in enumerate(zip(layers, image, strict=True))]
    found = {r["seq"]: r for r in stencil.outliers(packed_rows(spark, rows)).collect()}
    assert [len(found[i]["outliers"]) for i in (0, 1)] == [0, 0]
    assert [found[i]["batch_id"] for i in range(5)] == [0, 1, 1, 3, 4]
    window = [image[2], image[1], image[3]]  # layers 3, 7 (earlier), 7 (later)
    y, x, d = stencil.outliers_in([m.tobytes() for m in window], 6, 6)
    assert [(o["y"], o["x"], o["deviation"]) for o in found[3]["outliers"]] == list(zip(y.tolist(), x.tolist(), d.tolist(), strict=True))


def test_empty_table(spark):
    none = packed_rows(spark, [])
    assert stencil.outliers(none).count() == 0
    assert clusters.label_outliers(stencil.outliers(none)).count() == 0
    assert tile_windows(none, "pixels").count() == 0


def test_matrix_and_pixels_agree(spark, sf_dir):
    t = tiles.read_tiles(spark, sf_dir).limit(3)
    m = {r["batch_id"]: r["temperature"] for r in tiles.matrix(t).collect()}
    for p in tiles.pixels(t).collect():
        assert m[p["batch_id"]][p["y"]][p["x"]] == p["t"]


def plain_labels(y, x, eps, least):
    n = len(y)
    near = [[j for j in range(n) if (y[i] - y[j]) ** 2 + (x[i] - x[j]) ** 2 <= eps * eps] for i in range(n)]
    label, k = [-1] * n, 0
    for i in range(n):
        if label[i] != -1 or len(near[i]) < least:
            continue
        label[i], todo = k, list(near[i])
        while todo:
            j = todo.pop(0)
            if label[j] == -1:
                label[j] = k
                if len(near[j]) >= least:
                    todo += near[j]
        k += 1
    return label


@given(st.integers(0, 90), st.sampled_from([(20.0, 5), (1.0, 4), (1.5, 6), (3.0, 4), (1.0, 1)]), st.sampled_from([8, 20, 120]), st.integers(0, 1 << 30))
@settings(max_examples=60, deadline=None)
def test_labels_equal_step_by_step_clustering(n, rule, side, seed):
    at = np.random.default_rng(seed).integers(0, side, (n, 2))
    assert clusters.density_labels(at[:, 0], at[:, 1], *rule).tolist() == plain_labels(at[:, 0].tolist(), at[:, 1].tolist(), *rule)


def test_points_exactly_eps_apart_and_too_few():
    y, x = np.array([0, 0, 0, 0, 0]), np.array([0, 20, 40, 60, 80])
    assert clusters.density_labels(y, x, 20.0, 3).tolist() == [0] * 5
    assert clusters.density_labels(y, x * 2, 20.0, 2).tolist() == [-1] * 5
    square = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    assert clusters.density_labels(*square).tolist() == [-1] * 4


def test_border_point_goes_to_the_first_cluster():
    x = np.array([10, 12, 12, 12, 0, -2, -2, -2, 5])
    labels = clusters.density_labels(np.zeros(9, int), x, 5.0, 4)
    assert labels[8] == labels[0] == 0 and labels[4] == 1


@pytest.mark.parametrize("value,text", [(364.125, "364.13"), (98.125, "98.13"), (1.0, "1.00")])
def test_halves_round_up(spark, value, text):
    from thermolith.functions.formats import deviation_text

    assert spark.range(1).select(deviation_text(F.lit(value)).alias("t")).first()["t"] == text


def test_exchanges(spark, sf_dir):
    t = tiles.read_tiles(spark, sf_dir)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert exchanges(stencil.means_windowed(t)) == 1
    assert exchanges(stencil.outliers(tiles.packed(t))) == 1
    assert exchanges(saturation.saturation(t)) == 0
