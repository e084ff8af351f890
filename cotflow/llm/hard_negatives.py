"""Hard negatives from candidate blocks along a Hilbert curve, chosen by zone maps.

Every component becomes floor(scale * x); a score is an integer inner product. Rows are put in the
order of their place on a Hilbert curve through all dimensions, a few bits each, and written as
Parquet rows of BLOCK candidates each: a block keeps close vectors together. Beside its vectors a
block has a zone map: the least and greatest value of every dimension, and the labels it holds. The
zone maps alone are read to choose blocks: with interval arithmetic the score of an anchor with
anything in a block lies between sum(min(a * low, a * high)) and sum(max(a * low, a * high)), so a
window of scores needs a block only if the two ranges meet and the labels allow it.

Anchors are packed into groups of GROUP along the same curve. The positives of an anchor are its
best rows of the same label: its own block gives the score that others must reach, and the blocks
that can reach it are read. Each positive then opens a window, from ``low_percent`` to
``high_percent`` of its score, and the blocks that a window meets are read for the best rows of
other labels in it. Anchors and zone maps meet in blocks, group by page; every task keeps the few
best rows per window of what it has read and one small exchange joins these. Nothing is approximate:
blocks left out cannot hold a result. Close vectors gain most; independent ones in many dimensions
have wide zones, and most blocks are read.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or with
one so large that scores might exceed a long (2**26 after scaling) take no part; shorter vectors
count as filled with zeros. A row repeated in full counts once. Rows that share an id but differ are
rows of their own; no row of an anchor's id is its positive or negative. Ties go to the smaller id.
A positive score below zero opens no window. No anchors, no rows: no results. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cotflow.llm.batches import arrow_schema
from cotflow.llm.frames import staged

SCALE = 256
BITS = 2
BLOCK = 1024
GROUP = 128
# Zone maps that meet a group of anchors at once.
PAGE = 256
PART_ROWS = 8 * BLOCK
MAX_PARTS = 10_000
LARGEST = 1 << 26
NONE, ALL = -(2**62), 2**62

KEYED = "id long, label long, anchor boolean, vector binary, place binary"
BLOCKS = (
    "block long, n int, dims int, ids array<long>, labels array<long>, anchors array<int>, kinds array<long>, "
    "lows binary, highs binary, vectors binary"
)
HOME = "block long, at int, id long, label long, vector binary, least long"
GROUPS = "group long, dims int, ids array<long>, labels array<long>, vectors binary, least array<long>"
FOUND = "group long, window int, id long, score long"


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Per row of cell numbers (rows x dims) the bits of its place on the curve, most significant first."""
    x = cells.T.astype(np.uint32).copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(dims):
            on = (x[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    levels = [(x >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return np.concatenate(levels).T.astype(np.uint8)


def matrix(buffer, dims: int) -> np.ndarray:
    return np.frombuffer(buffer, np.int32).reshape(-1, dims) if dims else np.zeros((0, 0), np.int32)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.int32).tobytes()


def _lists(column, kind=np.int64) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _keyed(dims: int, cuts: np.ndarray, batches):
    """Vectors as bytes, filled to ``dims``, and their places."""
    for batch in batches:
        lists = batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        values = np.zeros((batch.num_rows, dims), np.int32)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        values[np.repeat(np.arange(batch.num_rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        places = np.packbits(hilbert_places(np.searchsorted(cuts, values, side="right"), BITS), axis=1) if dims else values
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (values, places)]],
            schema=arrow_schema(KEYED),
        )


def keyed_rows(rows: DataFrame, is_anchor: Callable[[Column], Column], id_col: str, label_col: str, vector_col: str, scale: int):
    """Rows that take part with integer vectors and their place on the curve, the number of rows and of dimensions."""
    sound = F.forall(rows[vector_col], lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))
    taken = rows.where(rows[id_col].isNotNull() & rows[label_col].isNotNull() & rows[vector_col].isNotNull() & sound)
    ints = F.transform(taken[vector_col], lambda x: F.floor(x.cast("double") * scale).cast("int"))
    own_id = taken[id_col].cast("long")
    plain = taken.select(own_id.alias("id"), taken[label_col].cast("long").alias("label"), is_anchor(own_id).alias("anchor"), ints.alias("vector"))

    def total(power: int) -> Column:
        return F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double"), F.lit(power))))

    n, dims, values, first, second = plain.agg(
        F.count("*"), F.max(F.size("vector")), F.sum(F.size("vector")), total(1), total(2)
    ).first()
    dims = dims or 0
    mean = (first or 0) / (values or 1)
    spread = max((second or 0) / (values or 1) - mean**2, 0) ** 0.5 or 1.0
    cuts = np.array([NormalDist(mean, spread).inv_cdf(k / 2**BITS) for k in range(1, 2**BITS)])
    return plain.mapInArrow(partial(_keyed, dims, cuts), KEYED), n, dims


def _full_batches(batches, size: int):
    """Batches cut and joined into ``size`` rows each, the last one smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(dims: int, size: int, batches):
    """Sorted rows as blocks; a row equal to the one before it is left out."""
    before, seq = None, 0

    def fresh():
        nonlocal before
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (0, 1, 3)], strict=True))
            new = [k != p for k, p in zip(keys, [before, *keys[:-1]], strict=True)]
            before = keys[-1] if keys else before
            yield batch.filter(pa.array(new, pa.bool_()))

    for block in _full_batches(fresh(), size):
        block = block.sort_by("id")
        vectors = matrix(b"".join(block.column("vector").to_pylist()), dims) if dims else np.zeros((block.num_rows, 0), np.int32)
        labels = block.column("label").to_numpy()
        row = {
            "block": (TaskContext.get().partitionId() << 32) + seq, "n": block.num_rows, "dims": dims,
            "ids": block.column("id").to_numpy(), "labels": labels, "anchors": np.flatnonzero(block.column("anchor").to_numpy()),
            "kinds": np.unique(labels), "lows": _bytes(vectors.min(axis=0)), "highs": _bytes(vectors.max(axis=0)), "vectors": _bytes(vectors),
        }
        seq += 1
        yield pa.RecordBatch.from_pylist([row], schema=arrow_schema(BLOCKS))


def scores(anchors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products; in the narrowest floating type that holds every partial sum."""
    largest = [int(np.abs(m.astype(np.int64)).max(initial=0)) for m in (anchors, others)]
    bound = anchors.shape[1] * largest[0] * largest[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (anchors.astype(kind) @ others.astype(kind).T).astype(np.int64)


def bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors x blocks) least and greatest score that a block could hold."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return scores(up, lows) + scores(down, highs), scores(up, highs) + scores(down, lows)


class Best:
    """The first k rows of every window, by score and then by id, of all rows offered so far."""

    def __init__(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        order = np.argsort(at, kind="stable")
        self.names, self.at, self.low, self.high, self.k = order, at[order], low[order].copy(), high[order], k
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, n: int, table: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores of n anchors with the rows of ``ids``, where ``fits``."""
        least, most = np.full(n, ALL), np.full(n, NONE)
        np.minimum.at(least, self.at, self.low)
        np.maximum.at(most, self.at, self.high)
        anchor, row = np.nonzero(fits & (table >= least[:, None]) & (table <= most[:, None]))
        if not len(anchor):
            return
        start, stop = np.searchsorted(self.at, anchor), np.searchsorted(self.at, anchor, side="right")
        each = stop - start
        of = np.repeat(np.arange(len(anchor)), each)
        window = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + start[of]
        score, found = table[anchor, row][of], ids[row][of]
        inside = (score >= self.low[window]) & (score <= self.high[window])
        window = np.concatenate([self.window, window[inside]])
        score, found = np.concatenate([self.score, score[inside]]), np.concatenate([self.id, found[inside]])
        order = np.lexsort((found, -score, window))
        window, score, found = window[order], score[order], found[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        last = rank == self.k - 1
        self.low[window[last]] = np.maximum(self.low[window[last]], score[last])
        kept = rank < self.k
        self.window, self.score, self.id = window[kept], score[kept], found[kept]


def allowed(labels: np.ndarray, others: np.ndarray, same: bool) -> np.ndarray:
    return (labels[:, None] == others[None]) == same


def _home(k: int, batches):
    """Every anchor with the score of its k-th best row of the same label in its own block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            at = np.array(row["anchors"], np.int64)
            if not len(at):
                continue
            ids, labels = np.array(row["ids"]), np.array(row["labels"])
            vectors = matrix(row["vectors"], row["dims"]) if row["dims"] else np.zeros((len(ids), 0), np.int32)
            table = scores(vectors[at], vectors)
            table[~allowed(labels[at], labels, True) | (ids[at][:, None] == ids)] = NONE
            least = -np.sort(-table, axis=1)[:, k - 1] if table.shape[1] >= k else np.full(len(at), NONE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), row["block"])), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(labels[at]),
                    pa.array([v.tobytes() for v in vectors[at]], pa.binary()), pa.array(least),
                ],
                schema=arrow_schema(HOME),
            )


def _groups(dims: int, size: int, batches):
    for seq, group in enumerate(_full_batches(batches, size)):
        row = {
            "group": (TaskContext.get().partitionId() << 32) + seq, "dims": dims,
            "ids": group.column("id").to_numpy(), "labels": group.column("label").to_numpy(),
            "vectors": b"".join(group.column("vector").to_pylist()), "least": group.column("least").to_numpy(),
        }
        yield pa.RecordBatch.from_pylist([row], schema=arrow_schema(GROUPS))


def _anchors(batch, i: int):
    dims = batch.column("dims")[i].as_py()
    ids = np.array(batch.column("ids")[i].as_py(), np.int64)
    vectors = matrix(batch.column("vectors")[i].as_buffer(), dims) if dims else np.zeros((len(ids), 0), np.int32)
    return ids, np.array(batch.column("labels")[i].as_py(), np.int64), vectors


def _windows(batch, i: int):
    return [np.array(batch.column(c)[i].as_py(), np.int64) for c in ("w_at", "w_low", "w_high")]


def _choose(same: bool, batches):
    """(block, group) where a window of the group meets what the zone map of the block allows."""
    for batch in batches:
        out = [], []
        for i in range(batch.num_rows):
            _, labels, vectors = _anchors(batch, i)
            at, low, high = _windows(batch, i)
            zones = batch.column("zones")[i].as_py()
            lows, highs = (np.frombuffer(b"".join(z[c] for z in zones), np.int32).reshape(len(zones), -1) for c in ("lows", "highs"))
            least, most = bounds(vectors, lows, highs)
            kinds = [np.array(z["kinds"]) for z in zones]
            fits = np.stack([np.isin(labels, k) if same else (len(k) > 1) | (labels != k[0]) for k in kinds], axis=1)
            need = fits[at] & (most[at] >= low[:, None]) & (least[at] <= high[:, None])
            chosen = np.flatnonzero(need.any(axis=0))
            out[0].extend(zones[z]["block"] for z in chosen)
            out[1].extend([batch.column("group")[i].as_py()] * len(chosen))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["block", "group"])


# Groups that a task has open at once.
OPEN = 256


def _search(k: int, same: bool, batches):
    """The k best rows per window in the blocks that a task has read."""
    best: dict[int, Best] = {}

    def done():
        for group, b in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b.id), group)), pa.array(b.names[b.window].astype(np.int32)), pa.array(b.id), pa.array(b.score)],
                schema=arrow_schema(FOUND),
            )
        best.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, vectors = _anchors(batch, i)
            group = batch.column("group")[i].as_py()
            if group not in best:
                if len(best) >= OPEN:
                    yield from done()
                best[group] = Best(*_windows(batch, i), k)
            rows, kinds = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("c_ids", "c_labels"))
            dims = vectors.shape[1]
            others = matrix(batch.column("c_vectors")[i].as_buffer(), dims) if dims else np.zeros((len(rows), 0), np.int32)
            fits = allowed(labels, kinds, same) & (ids[:, None] != rows)
            best[group].offer(len(ids), scores(vectors, others), fits, rows)
    yield from done()


def search(groups: DataFrame, blocks: DataFrame, pages: DataFrame, n_pages: int, k: int, same: bool) -> DataFrame:
    """(group, window, id, score, rank): the k best rows of every window (w_at, w_low, w_high) of the groups."""
    met = groups.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page")
    pairs = staged(met.mapInArrow(partial(_choose, same), "block long, group long"), "negatives-pairs")
    candidates = blocks.select("block", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("vectors").alias("c_vectors"))
    read = candidates.join(pairs, "block").join(groups, "group")
    found = read.mapInArrow(partial(_search, k, same), FOUND)
    rank = F.row_number().over(Window.partitionBy("group", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id", label_col: str = "label",
    vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: int = SCALE, block: int = BLOCK, group: int = GROUP, page: int = PAGE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` says by its id whether a row is an anchor.
    """
    spark = rows.sparkSession
    keyed, n, dims = keyed_rows(rows, is_anchor, id_col, label_col, vector_col, scale)
    parts = min(n // PART_ROWS + 1, MAX_PARTS)
    order = ["place", "id", "label", "vector"]
    sorted_rows = keyed.repartitionByRange(parts, "place", "id").sortWithinPartitions(*order).drop("place")
    blocks = staged(sorted_rows.mapInArrow(partial(_blocks, dims, block), BLOCKS), "negatives-blocks")
    n_blocks = blocks.count()

    n_pages = n_blocks // page + 1
    number = F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int")
    zones = blocks.select(number.alias("page"), F.struct("block", "kinds", "lows", "highs").alias("zone"))
    pages = staged(zones.groupBy("page").agg(F.collect_list("zone").alias("zones")), "negatives-pages")

    homes = blocks.select("block", "dims", "ids", "labels", "anchors", "vectors").mapInArrow(partial(_home, positives), HOME)
    homes = staged(homes, "negatives-anchors")
    n_groups = homes.count() // group + 1
    ordered = homes.repartitionByRange(min(n_groups, parts), "block", "at").sortWithinPartitions("block", "at")
    groups = staged(ordered.mapInArrow(partial(_groups, dims, group), GROUPS), "negatives-groups")

    whole = F.array_repeat(F.lit(ALL), F.size("ids"))
    single = F.transform("ids", lambda _, i: i)
    near = search(
        groups.select("group", "dims", "ids", "labels", "vectors", single.alias("w_at"), F.col("least").alias("w_low"), whole.alias("w_high")),
        blocks, pages, n_pages, positives, True,
    )
    near = staged(near, "negatives-positives")

    def percent(p: int) -> Column:
        return F.col("score").cast("decimal(20,0)") * p

    low, high = F.ceil(percent(low_percent) / 100).cast("long"), F.floor(percent(high_percent) / 100).cast("long")
    opened = near.withColumns({"w_low": low, "w_high": high}).where("w_low <= w_high")
    window = F.struct(F.col("window").alias("w_at"), "w_low", "w_high", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    opened = opened.groupBy("group").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    asking = staged(groups.drop("least").join(opened, "group"), "negatives-windows")
    columns = [F.col(f"windows.{c}").alias(c) for c in ("w_at", "w_low", "w_high")]
    far = search(asking.select("group", "dims", "ids", "labels", "vectors", *columns), blocks, pages, n_pages, negatives, False)

    named = asking.select("group", F.col("ids").alias("anchors"), F.posexplode("windows").alias("window", "w"))
    named = named.select("group", "window", F.get("anchors", F.col("w.w_at")).alias("anchor_id"), "w.positive_id", "w.positive_score")
    return far.join(named, ["group", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
