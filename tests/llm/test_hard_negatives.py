import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalore.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, id string, anchor int, chunk string"


def brute(rows, positives=5, negatives=10):
    used = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for k, (i, y, v) in enumerate(used):
        if i is None or i % 100:
            continue
        near = [(j, sum(a * b for a, b in zip(v, w))) for m, (j, z, w) in enumerate(used) if m != k and z == y]
        far = sorted(((j, sum(a * b for a, b in zip(v, w))) for j, z, w in used if z != y), key=key)
        for p, s in sorted(near, key=key)[:positives]:
            out += [(i, p, r + 1, j, s, t) for r, (j, t) in enumerate([x for x in far if 30 * s <= 100 * x[1] <= 90 * s][:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = F.when(df["vec_id"] % 7 == 0, (df["label"] + 1) % 10).otherwise(df["label"])
    return sorted((tuple(r) for r in h.mine(df, label, df["vec_id"] % 100 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 16, "BLOCK": 2, "SLICE": 40, "TILE": 2}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(h, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 12))
    rows = [(int(i), [float(x) for x in (base[i % 4] + rng.normal(size=12) * 0.4)[: 12 - i % 3]], int(i % 4), "x", 1, "y") for i in range(0, 500, 4)]
    rows += [(int(i), [float(x) for x in base[i % 4] * 0.5], int(rng.integers(4)), "x", 1, "y") for i in rng.integers(0, 300, 60)]
    rows += rows[:30] + [(0, [0.0] * 12, 1, "", 0, "")] * 5  # repeated rows, equal scores
    odd = [(None, [1.0] * 12, 1), (None, [1.0] * 12, 2), (200, None, 1), (300, [1.0], None), (400, [1.0, None], 1), (500, [float("nan")], 1), (600, [float("-inf")], 1), (700, [], 2), (-100, [-1.5, 700.25], 3), (9, [], 1)]
    rows += [(*r, None, None, None) for r in odd]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_empty_tables_and_lone_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1, "", 0, "")]) == []
    assert mined(spark, [(1, [1.0], 1, "", 0, ""), (2, [1.0], 2, "", 0, "")]) == []


def test_few_planes_decide_most_pairs():
    """After one chunk the bounds of the upper planes rule out most pairs of the next one."""
    rng = np.random.default_rng(2)
    values = rng.integers(-150, 150, (600, 64))
    width = h.planes_needed(values)
    assert (h.from_planes(h.to_planes(values, width), width, 600, 64) == values).all()
    anchors = h.Anchors(np.full(4, 9), np.arange(4), np.arange(4), np.arange(4), np.zeros(4, np.int64), values[:4], np.full((4, 1), h._NONE), np.full((4, 1), h._LAST), 3)
    anchors.compare(1, np.arange(600), np.zeros(600, np.int64), h.to_planes(values, width), width, 64, True)
    left = anchors._products(slice(0, 4), h.to_planes(values, width), width, 600, 64, np.ones((4, 600), bool))
    assert (left != h._NONE).sum() < 40
    with pytest.raises(ArithmeticError):
        h.Anchors(*[np.zeros(1, np.int64)] * 5, np.full((1, 9), 1 << 45), np.full((1, 1), h._NONE), np.full((1, 1), h._LAST), 1).compare(1, np.arange(1), np.zeros(1, np.int64), h.to_planes(np.full((1, 9), 1 << 45), 47), 47, 9, True)
