"""Near-duplicates by ProbMinHash over weighted shingles, banding, verification and components.

Shingles are five consecutive words, weighted by how often the text has them; a text of one to
four words has its whole word sequence as its only shingle. A shingle's arrivals are a Poisson
process whose rate is its weight, drawn from the shingle alone; each arrival falls into one of the
registers, and a register keeps the shingle that arrives first. Two texts agree in a register with
the probability Jaccard similarity of their shingle weights. Arrivals are drawn in rounds up to a
horizon at which all registers are full with high probability; a shingle whose next arrival lies
beyond ends early, and a text with a register left empty goes on with twice the horizon.

BANDS bands of ROWS registers each: at similarity 0.8 two texts share some band with probability
1 - 3e-6, and eleven of them on average. In every band bucket all texts are verified against one
leader by exact probability Jaccard. Buckets that hold several components after that are mixed:
their texts are of middling similarity, and a link between two of them may have met no leader.
These are refined, each round in work that grows with its buckets' rows and not with pairs:

- a mixed bucket of at most SMALL texts verifies all its pairs of different classes;
- in a larger one the texts meet its most central members, CENTRAL of them at most and the more the
  fewer texts lie outside the bucket's largest class. Central is who shares most shingles with most
  of these texts: among texts made from one template, whoever links to any links to the most
  central, so one leader of that kind is exact there;
- a pair whose signatures agree in less than LIKELY of the registers is not verified;
- texts of larger buckets that are still mixed get longer keys, drawn from all registers in as many
  combinations as make EXPECTED keys agree at the threshold, and go through the same steps.

What these rounds leave is then compared in full: in every larger bucket that is still mixed, each
text outside the largest class faces each text of another class. Both sides come in blocks of at most
FACING texts, so a task holds two blocks, however large the bucket. With s and t the shares of weight
that two texts have in common, their similarity is at most 1 / (1/s + 1/t - 1), and just that where
each text's weights are equal; two matrix products per block give this bound for all its pairs, and
pairs that reach the threshold by it are verified. This is quadratic in the texts outside the largest
class, and only there.

Connected components of the verified links are the classes. New links are joined to the classes
found so far; what a round stored goes when the next has been stored. Links are exact, so classes
never mix texts that no chain of verified links connects; no pair that shares a bucket of more than
SMALL texts is left out.

Texts with equal word sequences are one node, named by a hash of their digest that is checked to be
unique. Hot buckets are joined, not gathered: adaptive execution splits them, and leaders come
from partial aggregates and limits.

Defined results: every row gives one row. A null text and one without words is a class of its own;
so is a null id, with class_id null. Rows that share an id but not a text are judged text by text;
classes that meet only in such an id share their class_id. A text is handled whole, in a few times
its size. The empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cotflow.llm.batches import BLOCK_BYTES, Texts, arrow_schema, blocks, give_back, mix, span_hashes, window_hashes, window_starts
from cotflow.llm.frames import forget, free_name, staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
# Mixed buckets up to so many texts verify all pairs.
SMALL = 8
CENTRAL = 16
# Agreement of signatures below which a pair is not verified: 0.8 less four standard errors.
LIKELY = 0.7
# Registers in the longer keys of each further round, and how many keys agree on average at the threshold.
LONGER = (18,)
EXPECTED = 5
# Texts in a block of the full comparison, and shingles counted at a time there.
FACING, COLUMNS = 256, 4096
# Ids of texts to verify are broadcast up to this many (some 100 bytes each), else joined.
BROADCAST_IDS = 200_000

SKETCH = "doc_id long, tag string, digest string, bands array<long>, size long"
SIGNED = "id long, text string, signature binary"
KEYED = "id long, class_id long, outer boolean, keys array<long>"


def weighted_shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct shingles, ordered by row and hash."""
    if not len(texts.starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(float)
    words = texts.word_hashes()
    starts, rows = window_starts(texts.first_word[:-1], texts.n_words, SHINGLE)
    hashes = window_hashes(words, starts, SHINGLE)
    few = np.flatnonzero((texts.n_words > 0) & (texts.n_words < SHINGLE))
    if len(few):
        whole = span_hashes(words, texts.first_word[few], texts.first_word[few + 1], np.uint64(0xA0761D6478BD642F))
        rows = np.concatenate([rows, few])
        hashes = np.concatenate([hashes, mix(whole + texts.n_words[few].astype(np.uint64))])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows))).astype(float)


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Per row and register, 32 bits that name the shingle arriving first; 0 for rows without any.

    A register holds (arrival time as float bits, shingle bits) in one integer, so the earliest
    arrival is the smallest integer; equal times go to the smaller name.
    """
    empty = np.uint64(2**64 - 1)
    registers = np.full((n, REGISTERS), empty, np.uint64)
    totals = np.bincount(rows, weights, n)
    todo = np.flatnonzero(totals > 0)
    horizon = np.zeros(n)
    horizon[todo] = REGISTERS / totals[todo] * (math.log(REGISTERS) + 4)
    names = hashes >> np.uint64(32)
    active = np.arange(len(rows))
    while len(active):
        times = np.zeros(len(active))
        step = 0
        live = active
        while len(live):
            step += 1
            drawn = mix(hashes[live] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
            uniform = ((drawn >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
            times = times - np.log(uniform) / weights[live]
            goes = times <= horizon[rows[live]]
            live, times, drawn = live[goes], times[goes], drawn[goes]
            place = mix(drawn) % np.uint64(REGISTERS)
            value = (times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | names[live]
            np.minimum.at(registers.reshape(-1), rows[live] * REGISTERS + place.astype(np.int64), value)
        unfilled = np.zeros(n, bool)
        unfilled[todo] = (registers[todo] == empty).any(axis=1)
        todo = np.flatnonzero(unfilled)
        horizon[todo] *= 2
        active = np.flatnonzero(unfilled[rows])
    out = (registers & np.uint64(2**32 - 1)).astype(np.uint32)
    out[totals == 0] = 0
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; the band's number is part of the key."""
    n = len(signature)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
    parts = signature.reshape(n, BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x100000001B3) + parts[:, :, i] + np.uint64(1))
    return keys


def _sketch(batches):
    """doc_id and tag of every row, a digest of the word sequence and band keys, which are null
    where there are no words or there is no id, and the bytes of the text."""
    schema = arrow_schema(SKETCH)
    for part, texts in blocks(batches, "text"):
        rows, hashes, weights = weighted_shingles(texts)
        known = (texts.n_words > 0) & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        keys = band_keys(signatures(rows, hashes, weights, texts.n)[known])
        words = texts.word_hashes() if len(texts.starts) else np.zeros(0, np.uint64)
        digests = [
            span_hashes(codes, texts.first_word[:-1], texts.first_word[1:])
            for codes in (words, mix(words ^ np.uint64(0x632BE59BD9B4E019)))
        ]
        ends = np.concatenate([[0], np.cumsum(known) * BANDS]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()), mask=pa.array(~known))
        named = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(*digests, known, strict=True)]
        size = pc.binary_length(part.column("text")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("tag"), pa.array(named, pa.string()), bands, size], schema=schema
        )


def _signed(batches):
    """Texts with their whole signatures."""
    for part, texts in blocks(batches, "text"):
        found = signatures(*weighted_shingles(texts), texts.n)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array([row.tobytes() for row in found], pa.binary())], schema=arrow_schema(SIGNED)
        )


def _longer_keys(rows: int, batches):
    """Keys of ``rows`` registers each, in as many draws as make EXPECTED of them agree at the threshold."""
    count = math.ceil(EXPECTED / THRESHOLD**rows)
    draws = np.random.default_rng(rows)
    places = np.stack([draws.permutation(REGISTERS)[:rows] for _ in range(count)])
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(3)]).astype(np.uint64)
            keys = np.tile(np.arange(count, dtype=np.uint64) + np.uint64(rows << 32), (part.num_rows, 1))
            for j in range(rows):
                keys = mix(keys * np.uint64(0x100000001B3) + found[:, places[:, j]] + np.uint64(1))
            ends = np.arange(part.num_rows + 1, dtype=np.int32) * count
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))],
                schema=arrow_schema(KEYED),
            )


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two weight vectors over one set of shingles: sum over d of 1 / sum over e of
    max(x[e] / x[d], y[e] / y[d]). The inner sums come from prefix sums by ratio x / y."""
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    below = np.concatenate([[0.0], np.cumsum(y)])
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    both = np.flatnonzero((x > 0) & (y > 0))
    cut = np.searchsorted(ratio, ratio[both], "left")
    return float((x[both] / (above[cut] + below[cut] * ratio[both])).sum())


class _Shingles:
    """Shingles of the texts of a column, made once per run of equal ids."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        change = np.ones(len(ids), bool)
        change[1:] = ids[1:] != ids[:-1]
        self.at = np.cumsum(change) - 1
        rows, self.hashes, self.weights = weighted_shingles(Texts(texts.take(pa.array(np.flatnonzero(change)))))
        self.edges = np.searchsorted(rows, np.arange(change.sum() + 1))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.edges[self.at[i]], self.edges[self.at[i] + 1])
        return self.hashes[span], self.weights[span]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])] = a[1]
    y[np.searchsorted(union, b[0])] = b[1]
    return probability_jaccard(x, y)


def _alike(left, right) -> bool:
    """Do two signatures agree often enough for a pair to be verified?"""
    if not (left.is_valid and right.is_valid):
        return True
    a, b = (np.frombuffer(x.as_buffer(), np.uint32) for x in (left, right))
    return np.count_nonzero(a == b) >= LIKELY * REGISTERS


def _verify(batches):
    """Rows whose two texts reach the threshold; shingles are made for some bytes of text at a time."""
    for batch in batches:
        alike = [_alike(a, b) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
        batch = batch.select([0, 1, 2, 3]).filter(pa.array(alike, pa.bool_()))
        sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES, prepend=-1))
        for start, stop in zip(edges, [*edges[1:], batch.num_rows]):
            part = batch.slice(start, stop - start)
            sides = [
                _Shingles(part.column(c).to_numpy(zero_copy_only=False), part.column(c + 2)) for c in (0, 1)
            ]
            linked = [similarity(sides[0].of(k), sides[1].of(k)) >= THRESHOLD for k in range(part.num_rows)]
            yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))
        give_back()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (id, text, perhaps signature) reach the threshold, stored."""
    signed = F.col("signature") if "signature" in texts.columns else F.lit(None).cast("binary")
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"{x}_text"), signed.alias(f"{x}_signature")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text", "a_signature", "b_signature")
    return staged(both.mapInArrow(_verify, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id): for every id in a link the smallest id it is connected to.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    links stop changing.
    """
    links = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high > low").distinct()
    before = None
    while True:
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        smallest = both.groupBy("high").agg(F.min("low").alias("m")).withColumn("m", F.least("m", "high"))
        large = both.join(smallest, "high").where("low > high").select(F.col("low").alias("high"), F.col("m").alias("low"))
        large = large.where("high > low").distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(smallest, "high")
        small = (
            joined.select(F.col("low").alias("high"), F.col("m").alias("low"))
            .unionByName(smallest.select("high", F.col("m").alias("low")))
            .where("high > low")
            .distinct()
        )
        stored = links if hasattr(links, "stage_path") else None
        links = staged(small, "near-stars")
        if stored is not None:
            forget(stored)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("high").alias("id"), F.col("low").alias("class_id")).unionByName(
        links.select(F.col("low").alias("id"), F.col("low").alias("class_id")).distinct()
    )


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes when ``links`` join some of them: components of the classes' own links."""
    a, b = (classes.select(F.col("id").alias(x), F.col("class_id").alias(f"{x}_class")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left")
    moves = components(ends.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")))
    new = moves.select(F.col("id").alias("class_id"), F.col("class_id").alias("into"))
    known = classes.join(new, "class_id", "left").select("id", F.coalesce("into", "class_id").alias("class_id"))
    # Nodes that had no link yet are classes of their own.
    fresh = moves.join(classes, "id", "left_anti").select("id", "class_id")
    return staged(known.unionByName(fresh).dropDuplicates(["id"]), "near-classes")


def _shingle_rows(batches):
    for part, texts in blocks(batches, "text"):
        rows, hashes, weights = weighted_shingles(texts)
        yield pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(rows)), pa.array(hashes.view(np.int64)), pa.array(weights)],
            schema=arrow_schema("id long, shingle long, weight double"),
        )


def centrality(texts: DataFrame) -> DataFrame:
    """(id, central): in how many of the texts a shingle of this one is found, on average by weight."""
    shingles = staged(texts.select("id", "text").mapInArrow(_shingle_rows, "id long, shingle long, weight double"), "near-shingles")
    spread = shingles.groupBy("shingle").agg(F.count("*").alias("n"))
    mean = F.sum(F.col("weight") * F.col("n")) / F.sum("weight")
    found = staged(shingles.join(spread, "shingle").groupBy("id").agg(mean.alias("central")), "near-central")
    forget(shingles)
    return found


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """(key, n, major, others) of the buckets of more than one class: texts, the largest class, texts outside it."""
    by_class = placed.groupBy("key", "class_id").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "class_id")).alias("top")
    found = by_class.groupBy("key").agg(F.sum("n").alias("n"), top, F.count("*").alias("kinds")).where("kinds > 1")
    return found.select("key", "n", F.col("top.class_id").alias("major"), (F.col("n") - F.col("top.n")).alias("others"))


def refining_pairs(own: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify in mixed buckets; at most SMALL or CENTRAL per row. ``compared`` takes the rest."""
    few = own.where(F.col("n") <= SMALL).select("key", "id", "class_id")
    other = few.select("key", F.col("id").alias("end"), F.col("class_id").alias("end_class"))
    among = few.join(other, "key").where((F.col("class_id") != F.col("end_class")) & (F.col("id") < F.col("end")))
    many = own.where(F.col("n") > SMALL)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("central"), "id"))
    wanted = F.greatest(F.lit(2), F.least(F.lit(CENTRAL), F.call_function("div", F.col("n"), F.col("others"))))
    leaders = many.select("key", "id", "class_id", "n", "others", rank.alias("rank")).where(F.col("rank") <= CENTRAL)
    leaders = leaders.where(F.col("rank") <= wanted).select("key", F.col("id").alias("end"), F.col("class_id").alias("end_class"))
    starred = many.select("key", "id", "class_id").join(leaders, "key").where(F.col("class_id") != F.col("end_class"))
    pairs = among.unionByName(starred.select("key", "id", "class_id", "end", "end_class"))
    return pairs.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()


def similarity_bounds(left: tuple, right: tuple, n_left: int, n_right: int) -> np.ndarray:
    """An upper bound of the similarity of every text of one side with every text of the other.

    A side is (row, hash, weight) as of ``weighted_shingles``. The bound is the similarity where the
    weights of each text are equal. Single precision: good to 1e-4.
    """
    shared = np.intersect1d(left[1], right[1])
    sides = []
    for (rows, hashes, weights), n in ((left, n_left), (right, n_right)):
        share = weights / np.bincount(rows, weights, n)[rows]
        at = np.minimum(np.searchsorted(shared, hashes), max(len(shared) - 1, 0))
        met = shared[at] == hashes if len(shared) else np.zeros(len(hashes), bool)
        order = np.argsort(at[met], kind="stable")
        sides.append((rows[met][order], at[met][order], share[met][order]))
    common = np.zeros((2, n_left, n_right), np.float32)
    for low in range(0, len(shared), COLUMNS):
        dense = []
        for (rows, at, share), n in zip(sides, (n_left, n_right), strict=True):
            span = slice(*np.searchsorted(at, (low, low + COLUMNS)))
            part = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            part[rows[span], at[span] - low] = share[span]
            dense.append((part, (part > 0).astype(np.float32)))
        (x, in_x), (y, in_y) = dense
        common[0] += x @ in_y.T
        common[1] += in_x @ y.T
    with np.errstate(divide="ignore"):
        return 1 / (1 / common[0] + 1 / common[1] - 1)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _faced(table: pa.Table) -> pa.Table:
    """Links (a, b) between the asking and the answering texts of one pair of blocks, one for every two classes."""
    asks = table.column("asks")
    blocks_of = [table.filter(asks).combine_chunks(), table.filter(pc.invert(asks)).combine_chunks()]
    ids, classes, outer = ([b.column(c).to_numpy() for b in blocks_of] for c in ("id", "class_id", "outer"))
    shingles = [weighted_shingles(Texts(_whole(b.column("text")))) for b in blocks_of]
    edges = [np.searchsorted(rows, np.arange(b.num_rows + 1)) for (rows, _, _), b in zip(shingles, blocks_of, strict=True)]
    bounds = similarity_bounds(*shingles, *[b.num_rows for b in blocks_of])
    # Two texts that both ask meet twice.
    wanted = (classes[0][:, None] != classes[1]) & (~outer[1] | (ids[0][:, None] < ids[1]))
    links, linked = [], set()
    for i, j in zip(*np.nonzero(wanted & (bounds >= THRESHOLD - 1e-4)), strict=True):
        kinds = (classes[0][i], classes[1][j])
        if kinds in linked:
            continue
        sides = [(h[e[k] : e[k + 1]], w[e[k] : e[k + 1]]) for (_, h, w), e, k in zip(shingles, edges, (i, j), strict=True)]
        if similarity(*sides) >= THRESHOLD:
            linked.add(kinds)
            links.append(sorted((int(ids[0][i]), int(ids[1][j]))))
    give_back()
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def facing_blocks(placed: DataFrame) -> DataFrame:
    """(key, asking, facing, id, class_id, outer, asks): which blocks of the mixed buckets of
    ``placed`` (key, id, size, class_id) each text belongs to.

    Texts outside the largest class ask, in ``asking`` blocks; all answer, in ``facing`` blocks. Of
    buckets of the same texts one is taken. The members bring the bytes of their texts, as a join
    with the texts would look each text up once per bucket, and that twice.
    """
    placed = placed.join(mixed_buckets(placed), "key").withColumn("outer", F.col("class_id") != F.col("major"))

    def parts(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / FACING), F.ceil(size / BLOCK_BYTES)).cast("int")

    sizes = placed.groupBy("key").agg(
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same"), F.count("*").alias("n"), F.sum("size").alias("bytes"),
        F.count_if("outer").alias("asked"), F.sum(F.when(F.col("outer"), F.col("size")).otherwise(0)).alias("asked_bytes"),
    )
    once = sizes.groupBy("same", "n").agg(F.min_by(F.struct(*sizes.columns), "key").alias("one")).select("one.*")
    dealt = once.select("key", parts(F.col("asked"), F.col("asked_bytes")).alias("askers"), parts(F.col("n"), F.col("bytes")).alias("all"))
    rows = placed.select("key", "id", "class_id", "outer").join(dealt, "key")

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(of)), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    kept = ["id", "class_id", "outer"]
    asking = rows.where("outer").select("key", block("askers").alias("asking"), every("all").alias("facing"), *kept, F.lit(True).alias("asks"))
    answering = rows.select("key", every("askers").alias("asking"), block("all").alias("facing"), *kept, F.lit(False).alias("asks"))
    return asking.unionByName(answering)


def compared(members: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes when in every mixed bucket of ``members`` (key, id, size) all pairs of different classes are compared."""
    placed = staged(with_classes(members, classes), "near-classed")
    blocks_of = staged(facing_blocks(placed), "near-facing")
    forget(placed)
    if blocks_of.isEmpty():
        return classes
    faced = blocks_of.join(texts.select("id", "text"), "id").groupBy("key", "asking", "facing").applyInArrow(_faced, "a long, b long")
    links = staged(faced.distinct(), "near-links")
    forget(blocks_of)
    return classes if links.isEmpty() else merged(classes, links)


def refined(members: DataFrame, texts: DataFrame, classes: DataFrame, done: DataFrame) -> DataFrame:
    """The classes when all mixed buckets of ``members`` (key, id, size) have been refined; size is the
    bytes of the text.

    ``texts`` (id, text) holds the members' texts, the pairs ``done`` need no second look.
    """
    placed = staged(with_classes(members, classes), "near-classed")
    mixed = mixed_buckets(placed)
    own = staged(placed.join(mixed, "key").distinct(), "near-mixed")
    forget(placed)
    if own.isEmpty():
        return classes
    rest = texts.join(own.select("id").distinct(), "id", "left_semi").select("id", "text")
    rest = staged(rest.mapInArrow(_signed, SIGNED), "near-signed")
    central = centrality(rest)
    rounds = iter(LONGER)
    large = staged(own.where(F.col("n") > SMALL).select("key", "id", "size"), "near-large")
    while True:
        ranked = staged(own.join(central, "id", "left"), "near-ranked")
        pairs = staged(refining_pairs(ranked).join(done, ["a", "b"], "left_anti"), "near-pairs")
        forget(ranked)
        links = verified(pairs, rest)
        if not links.isEmpty():
            classes = merged(classes, links)
        rows = next(rounds, None)
        if rows is None:
            break
        done = done.unionByName(pairs)
        # Who lies outside the largest class of a large bucket that is still mixed looks further; the
        # others only answer.
        many = with_classes(own.where(F.col("n") > SMALL).select("key", "id"), classes)
        still = many.join(mixed_buckets(many), "key")
        asks = still.groupBy("id").agg(F.max(F.col("class_id") != F.col("major")).alias("outer"))
        asking = rest.join(with_classes(asks, classes), "id").select("id", "class_id", "outer", "signature")
        keys = staged(asking.mapInArrow(lambda batches, rows=rows: _longer_keys(rows, batches), KEYED), "near-longer-keys")
        spread = keys.select("id", "class_id", "outer", F.explode("keys").alias("key"))
        ends = F.min("class_id").alias("x"), F.max("class_id").alias("y")
        shared = spread.groupBy("key").agg(*ends, F.max("outer").alias("asked")).where("x < y AND asked")
        placed = staged(spread.join(shared.select("key"), "key", "left_semi").select("key", "id", "class_id"), "near-longer-members")
        before = own
        own = staged(placed.join(mixed_buckets(placed), "key"), "near-mixed")
        forget(before, keys, placed)
        if own.isEmpty():
            break
    return compared(large, rest, classes)


def named_nodes(sketches: DataFrame) -> DataFrame:
    """(digest, first_id, n_copies, size, node): a number of its own for every word sequence; size is
    the bytes of its longest text."""
    copies = sketches.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.max("size").alias("size")
    )
    copies = staged(copies, "near-copies")
    salt = 0
    while True:
        nodes = copies.withColumn("node", F.xxhash64("digest", F.lit(salt)))
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            return nodes
        salt += 1


def judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, tag (md5 of its text), class_id, n_copies, class_node (null
    without id or words)."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.md5(text).alias("tag"), text.alias("text"))
    sketches = staged(rows.mapInArrow(_sketch, SKETCH), "near-sketches")
    nodes = named_nodes(sketches)
    firsts = sketches.drop("size").join(nodes.select("digest", F.col("first_id").alias("doc_id"), "size", "node"), ["doc_id", "digest"])
    keys = firsts.select(F.col("node").alias("id"), "size", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    members = staged(keys.join(buckets.select("key", "leader"), "key"), "near-members")
    stars = members.where("id > leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = staged(stars, "near-stars")

    wanted = staged(firsts.select("doc_id", "tag", "node").join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "near-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    # Rows of one node share their words, so any of them serves.
    texts = rows.dropna().join(wanted, ["doc_id", "tag"]).select(F.col("node").alias("id"), "text")
    texts = staged(texts.dropDuplicates(["id"]), "near-texts")
    classes = components(verified(stars, texts))
    classes = refined(members.select("key", "id", "size"), texts, classes, stars)

    placed = nodes.join(classes.withColumnRenamed("id", "node"), "node", "left").select(
        "digest", "first_id", "n_copies", F.coalesce("class_id", "node").alias("class_node")
    )
    placed = staged(placed, "near-placed")
    forget(members, stars, texts)
    found = placed.join(placed.groupBy("class_node").agg(F.min("first_id").alias("class_id")), "class_node")
    worded = sketches.select("doc_id", "tag", "digest").join(found, "digest").select("doc_id", "tag", "class_id", "n_copies", "class_node")
    others = sketches.where("digest IS NULL").select(
        "doc_id", "tag", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("class_node")
    )
    return worded.unionByName(others)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class), n_copies.

    n_copies counts the rows with the same word sequence, itself included.
    """
    return judged(docs, id_col, text_col).select("doc_id", "class_id", "n_copies")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of every class, all columns as they are; rows without an id stay.

    First is the smallest id, then the smallest md5 of the text; of rows equal in both one stays.
    """
    rows = staged(judged(docs, id_col, text_col).where("doc_id IS NOT NULL"), "near-judged")
    first = rows.where("doc_id = class_id").groupBy("class_node").agg(F.min("tag").alias("first_tag"))
    extra = rows.join(first, "class_node").where("doc_id <> class_id OR tag <> first_tag").select("doc_id", "tag").distinct()

    def is_row(other: DataFrame) -> Column:
        return (docs[id_col].cast("long") == other["doc_id"]) & F.md5(docs[text_col].cast("string")).eqNullSafe(other["tag"])

    kept = docs.join(extra, is_row(extra), "left_anti")
    again = rows.groupBy("doc_id", "tag").count().where("count > 1")
    if again.isEmpty():
        return kept
    again = again.select("doc_id", "tag")
    name = free_name(docs, "tag")
    once = kept.join(again, is_row(again), "left_semi").withColumn(name, F.md5(docs[text_col].cast("string")))
    return kept.join(again, is_row(again), "left_anti").unionByName(once.dropDuplicates([id_col, name]).drop(name))
