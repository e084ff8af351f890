"""Hard negatives against all inner products."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from cotflow.llm import hard_negatives as hn
from pyspark.sql import functions as F


@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 1), (2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    places = hn.hilbert_places(cells, bits)
    numbers = [int("".join(map(str, p)), 2) for p in places]
    assert sorted(numbers) == list(range(len(cells)))
    along = cells[np.argsort(numbers)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    draws = np.random.default_rng(1)
    for _ in range(30):
        anchors, block = draws.integers(-300, 300, (4, 8)), draws.integers(-300, 300, (20, 8)) + draws.integers(-200, 200, 8)
        least, most = hn.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
        table = anchors @ block.T
        assert (table >= least).all() and (table <= most).all()
        corner = np.where(anchors > 0, block.max(axis=0), block.min(axis=0))
        assert most[:, 0].tolist() == (anchors * corner).sum(axis=1).tolist()


def test_scores_are_exact_at_every_size():
    for size in (200, 1 << 18, (1 << 26) - 1):
        a = np.full((2, 64), size)
        assert hn.scores(a, -a).tolist() == [[-64 * size * size] * 2] * 2


def plain(rows, is_anchor, k=5, m=10, low=30, high=90):
    known = {}
    for i, label, vector in rows:
        ok = i is not None and label is not None and vector is not None
        if ok and all(x is not None and math.isfinite(x) and abs(256 * x) < hn.LARGEST for x in vector):
            known[(i, label, tuple(math.floor(256 * x) for x in vector))] = True
    known = list(known)
    out = []
    for a, label, v in known:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in known if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            found = [(i, -s) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, positive, rank + 1, i, -p, s) for rank, (i, s) in enumerate(found[:m])]
    return out


def cases():
    draws = random.Random(2)

    def around(center, spread, dims):
        return [c + draws.gauss(0, spread) for c in center[:dims]]

    centers = [[draws.gauss(0, 0.3) for _ in range(12)] for _ in range(9)]
    clustered = [(i, i % 3, around(centers[i % 9], 0.05, 12)) for i in range(700)]
    alike = [(i, i % 4, centers[i % 2][:6]) for i in range(400)]
    odd = [
        (None, 1, [0.5]), (1, None, [0.5]), (2, 1, None), (3, 1, [None, 0.5]), (4, 1, [math.nan]), (5, 1, [math.inf]), (10, 1, [1e30]),
        (20, 1, []), (30, 2, [0.5]), (40, 1, [0.5, 0.25, 0.5]), (50, -1, [0.25]), (50, 1, [0.75]), (50, 1, [0.75]), (50, 2, [0.75]),
        (60, 1, [-0.5]), (70, 1, [0.4]), (71, 2, [0.1]), (72, 2, [0.2]), (73, 3, [0.2]), (80, 4, [200_000.0]), (81, 4, [1.0]),
    ]
    return {"clustered": clustered, "alike": alike, "odd": odd, "one": [(0, 1, [1.0])], "bare": [(i, i % 2, []) for i in range(20)], "none": []}


@pytest.mark.parametrize("name", ["clustered", "alike", "odd", "one", "bare", "none"])
def test_mined_as_by_all_pairs(spark, name):
    rows = cases()[name]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("id", "place", "block", "group", "vector", "window", "page")}).repartition(4)
    got = hn.hard_negatives(df, lambda i: i % 10 == 0, block=32, group=7, page=3)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, lambda i: i % 10 == 0))


def test_zone_maps_leave_blocks_out(spark):
    rows = cases()["clustered"]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    keyed, n, dims = hn.keyed_rows(df, lambda i: i % 10 == 0, "vec_id", "label", "embedding", 256)
    order = keyed.repartitionByRange(1, "place", "id").sortWithinPartitions("place", "id", "label", "vector").drop("place").toArrow()
    along = order.column("label").to_numpy(), np.array([np.frombuffer(v.as_py(), np.int32) for v in order.column("vector")])
    assert n == len(rows) and dims == 12
    blocks = np.array_split(along[1], 20)
    anchor = along[1][:1]
    _, most = hn.bounds(anchor, np.stack([b.min(axis=0) for b in blocks]), np.stack([b.max(axis=0) for b in blocks]))
    best = np.sort((anchor @ along[1].T)[0])[-6]
    assert (most[0] >= best).sum() < 10
