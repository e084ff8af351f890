"""Id sets compared through small tables: the same differences as by comparing the ids."""

import random

import pytest

from cotflow.operators import consistency, reconciliation


def listed(df):
    return sorted(tuple(r) for r in df.select("file", "side", "id").collect())


def made(spark, seed, size, changes):
    draw = random.Random(seed)
    base = [f"id_{i}" for i in range(size)]
    rows = [("a", i) for i in base]
    for name in ("b", "c"):
        own = set(base) - set(draw.sample(base, changes)) | {f"{name}_{i}" for i in range(changes)}
        rows += [(name, i) for i in own]
        rows += [(name, i) for i in draw.sample(sorted(own), 5)]  # repeated rows
    rows += [("d", i) for i in base] + [("d", None), ("a", None)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "file string, id string").repartition(4)


@pytest.mark.parametrize("changes, cell_bits", [(0, (8,)), (20, (8,)), (200, (4, 9)), (200, (2,)), (20, ())])
def test_same_as_comparing_ids(spark, changes, cell_bits):
    rows = made(spark, changes, 600, changes)
    for reference in ("a", "c"):
        found = reconciliation.reconcile_ids(rows, reference_file=reference, cell_bits=cell_bits)
        assert listed(found) == listed(consistency.id_differences(rows, reference_file=reference))


def peeled(rows, cell_bits):
    cells = reconciliation.id_cells(rows, cell_bits)
    beyond = reconciliation.cells_beyond(cells, ["b", "c", "d"], "a")
    return reconciliation.peeled_keys(beyond, cell_bits).collect()


def test_both_paths_are_taken(spark):
    rows = made(spark, 1, 600, 20)
    got = peeled(rows, 8)
    assert not [r for r in got if r["left"]]
    assert {r["file"] for r in got} == {"b", "c"} and 80 <= len(got) <= 90
    assert {r["file"] for r in peeled(rows, 2) if r["left"]} == {"b", "c"}


def test_peeling_takes_no_mixed_cell_for_one_id():
    bits = 4
    draw = random.Random(3)
    for n in range(1, 12):
        keys = [draw.getrandbits(64) for _ in range(n)]
        counts = [draw.choice([-2, -1, 1, 3]) for _ in keys]
        table = {}
        for key, times in zip(keys, counts, strict=True):
            second = key * 0x9E3779B97F4A7C15 % 2**64
            check = reconciliation.zlib.crc32(str(reconciliation._signed(key)).encode())
            sums = (1, key & reconciliation.LOW, key >> 32, second & reconciliation.LOW, second >> 32, check)
            for place in reconciliation._places(key, bits):
                cell = table.setdefault(place, [0] * 6)
                for i, s in enumerate(sums):
                    cell[i] += times * s
        found, left = reconciliation.peel([(c, *v) for c, v in table.items() if any(v)], bits)
        wanted = {reconciliation._signed(k) for k in keys}
        assert set(found) <= wanted and (left or set(found) == wanted)


def test_edges(spark):
    rows = spark.createDataFrame(
        [("a", "1", 1), ("a", "1", 2), ("a", None, 3), ("b", "1", 4), ("b", "", 5)],
        "file string, id string, key int",
    )
    found = reconciliation.reconcile_ids(rows, ["a", "b", "gone"], "a")
    assert listed(found) == [("b", "extra", ""), ("gone", "missing", "1")]
    assert listed(reconciliation.reconcile_ids(rows.where("id = '1'"))) == []
    assert listed(reconciliation.reconcile_ids(rows.limit(0))) == []
    assert listed(reconciliation.reconcile_ids(rows.where("file = 'a'"))) == []
    with pytest.raises(ValueError, match="no dataset file"):
        reconciliation.reconcile_ids(rows, reference_file="x")
    with pytest.raises(ValueError, match="cell_bits"):
        reconciliation.reconcile_ids(rows, cell_bits=(22,))


def test_ids_are_not_exchanged(spark):
    rows = made(spark, 2, 600, 20)
    beyond = reconciliation.cells_beyond(reconciliation.id_cells(rows, 8), ["b"], "a")
    plan = beyond._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not [line for line in keys if "id#" in line or "key#" in line]
