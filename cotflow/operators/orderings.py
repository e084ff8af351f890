"""Topological orderings of step graphs: capped enumeration, sampling, reasoning paths.

Everything is a Column expression over one graph record, so a run over any number of
examples is a single map-only stage. The memory of a row is bounded by cap x nodes ints for
the prefixes kept and as much for the children that the cap is cut from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cotflow.functions.hashing import next_state, start_state
from cotflow.functions.lambdas import computed_once, empty, let, upto
from cotflow.operators.graphs import (
    CYCLIC,
    INVALID_INPUT,
    MAX_BITS,
    bit,
    complexity_estimate,
    listed_in_order,
    mark,
    with_graph,
)
from cotflow.operators.order_batches import TAIL, add_orderings, listed_first

# How many orderings each level of detail asks for.
SAMPLES_FULL, SAMPLES_COTS = 500, 50
CAPS_FULL = {"MEDIUM": 1000, "LOW": 10000}
CAPS_COTS = {"MEDIUM": 100, "LOW": 200}
ATTEMPTS_PER_SAMPLE = 5

FIRST_ROUND = 8
TABLE_BITS = 10


class _Bits:
    """Placed nodes as the bits of a long."""

    def __init__(self, graph: Column, table: Column | None = None):
        self.slots, self.table = graph["slots"], table
        self.start = F.lit(0).cast("bigint")

    def ready(self, placed: Column) -> Column:
        return F.filter(self.slots, lambda x: placed.bitwiseAND(x["both"]) == x["before"])

    def choose(self, placed: Column, rng: Column) -> Column:
        listed = F.get(self.table, placed.cast("int"))
        return F.coalesce(_pick(listed, rng), let(self.ready(placed), lambda r: _pick(r, rng)))

    def slot(self, node: Column) -> Column:
        return F.get(self.slots, node)

    def place(self, placed: Column, slot: Column) -> Column:
        return placed.bitwiseOR(slot["bit"])


class _Lists:
    """Placed nodes as bits of several longs beside the queue of ready nodes, for graphs with more
    nodes than a long has bits. A step looks at the queue and at what its node unlocks alone."""

    def __init__(self, graph: Column):
        self.before, self.after = graph["wide"]["before"], graph["wide"]["after"]
        n = F.size(graph["ids"])
        words = F.array_repeat(F.lit(0).cast("bigint"), F.floor(n / MAX_BITS).cast("int") + 1)
        first = F.filter(
            F.transform(upto(n), lambda v: v - 1), lambda v: F.size(F.get(self.before, v)) == 0
        )
        self.start = F.struct(words.alias("words"), first.alias("ready"))

    @staticmethod
    def _in(words: Column, v: Column) -> Column:
        word = F.get(words, F.call_function("div", v, F.lit(MAX_BITS)).cast("int"))
        return word.bitwiseAND(bit(v % MAX_BITS)) != 0

    def ready(self, state: Column) -> Column:
        return F.transform(state["ready"], self.slot)

    def slot(self, node: Column) -> Column:
        return F.struct(node.alias("node"), mark(node).alias("mark"))

    def choose(self, state: Column, rng: Column) -> Column:
        node = _pick(state["ready"], rng)
        return F.when(node.isNotNull(), self.slot(node))

    def place(self, state: Column, slot: Column) -> Column:
        node = slot["node"]
        at = F.call_function("div", node, F.lit(MAX_BITS))
        words = F.transform(
            state["words"],
            lambda w, i: F.when(i == at, w.bitwiseOR(bit(node % MAX_BITS))).otherwise(w),
        )

        def with_words(placed: Column) -> Column:
            unlocked = F.filter(
                F.get(self.after, node),
                lambda w: (w != node)
                & F.forall(F.get(self.before, w), lambda p: self._in(placed, p)),
            )
            waiting = F.filter(state["ready"], lambda v: v != node)
            return F.struct(
                placed.alias("words"),
                F.sort_array(F.concat(waiting, unlocked)).alias("ready"),
            )

        return let(words, with_words)


_State = _Bits | _Lists


def _pick(ready: Column, rng: Column) -> Column:
    return F.get(ready, F.try_mod(rng, F.size(ready)).cast("int"))


def _by_size(
    graph: Column, build: Callable[[_State], Column], table: Column | None = None
) -> Column:
    return F.when(F.size(graph["ids"]) <= MAX_BITS, build(_Bits(graph, table))).otherwise(
        build(_Lists(graph))
    )


def _ready_table(graph: Column) -> Column:
    """The ready nodes for every set of placed nodes; NULL unless the graph is small.

    Sampling looks the same few sets up thousands of times.
    """
    bits = _Bits(graph)
    sets = F.sequence(F.lit(0), (bit(F.size(graph["ids"])) - 1).cast("int"))
    return F.when(
        F.size(graph["ids"]) <= TABLE_BITS,
        F.transform(sets, lambda placed: bits.ready(placed.cast("bigint"))),
    )


def _wide(graph: Column, build: Callable[[_State], Column], table: Column | None = None) -> Column:
    """``_by_size`` where all graphs are wide: half the expression to plan."""
    return build(_Lists(graph))


def enumerate_orderings(
    graph: Column, cap: Column | int = 10000, by_size: Callable[..., Column] | None = None
) -> Column:
    """The first ``cap`` orderings in lexicographic order of node numbers.

    Grows all prefixes by one node per level. In an acyclic graph every valid prefix can
    be completed, so keeping the ``cap`` smallest prefixes per level loses none of the
    ``cap`` smallest orderings. A cyclic graph runs out of prefixes and gives an empty
    list. Children follow their parents in ascending order, so no sort is needed.

    Orderings that begin like the smallest one come before all others. So its last TAIL nodes alone
    are arranged first, then twice as many, until there are ``cap`` orderings or all nodes take part.

    The graphs of an Arrow batch are handled together (``order_batches``). With ``by_size`` it is an
    expression over the row instead, which may stand in a condition or a lambda.
    """
    cap = F.lit(cap) if isinstance(cap, int) else cap
    if by_size is None:
        return _enumerated()(F.size(graph["ids"]), graph["codes"], cap.cast("bigint"))
    return by_size(graph, lambda state: _enumerate(graph, cap, state))


@cache
def _enumerated():
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return listed_first(batches)

    return F.arrow_udf(run, "array<array<int>>")


def _first(graph: Column, state: _State) -> Column:
    """The smallest ordering, or as far as it goes in a cyclic graph."""

    def step(s: Column, _: Column) -> Column:
        def placed(slot: Column) -> Column:
            grown = F.struct(
                F.concat(s["path"], F.array(slot["node"])).alias("path"),
                state.place(s["state"], slot).alias("state"),
            )
            return F.when(slot.isNull(), s).otherwise(grown)

        return let(F.get(state.ready(s["state"]), F.lit(0)), placed)

    start = F.struct(empty("array<int>").alias("path"), state.start.alias("state"))
    return F.aggregate(upto(F.size(graph["ids"])), start, step, lambda s: s["path"])


def _enumerate(graph: Column, cap: Column, state: _State) -> Column:
    n = F.size(graph["ids"])
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n / TAIL, F.lit(1.0)))).cast("int"))
    tails = F.transform(doublings, lambda k: F.least(n, F.call_function("shiftleft", F.lit(TAIL), k)))

    def behind(head: Column, tail: Column) -> Column:
        begun = F.aggregate(head, state.start, lambda s, v: state.place(s, state.slot(v)))
        found = let(begun, lambda start: _arranged(tail, cap, state, start))
        return F.transform(found, lambda path: F.concat(head, path))

    def longer(first: Column) -> Column:
        return F.aggregate(
            tails,
            empty("array<array<int>>"),
            lambda found, tail: F.when(F.size(found) >= cap, found).otherwise(
                let(F.slice(first, F.lit(1), n - tail), lambda head: behind(head, tail))
            ),
        )

    return let(
        _first(graph, state),
        lambda first: F.when(F.size(first) == n, longer(first)).otherwise(empty("array<array<int>>")),
    )


def _arranged(levels: Column, cap: Column, state: _State, begun: Column) -> Column:
    """The first ``cap`` ways to go on from a state by so many nodes."""

    def grow(prefixes: Column, _: Column) -> Column:
        """A child is its parent's place and a slot until the cap has cut; only then it gets a state."""
        picks = F.flatten(
            F.transform(
                prefixes,
                lambda s, i: F.transform(
                    state.ready(s["state"]), lambda x: F.struct(i.alias("parent"), x.alias("slot"))
                ),
            )
        )

        def child(p: Column) -> Column:
            return let(
                F.get(prefixes, p["parent"]),
                lambda s: F.struct(
                    F.concat(s["path"], F.array(p["slot"]["node"])).alias("path"),
                    state.place(s["state"], p["slot"]).alias("state"),
                ),
            )

        return F.transform(F.slice(picks, F.lit(1), cap), child)

    start = F.array(F.struct(empty("array<int>").alias("path"), begun.alias("state")))
    return F.aggregate(
        upto(levels),
        start,
        grow,
        lambda prefixes: F.transform(prefixes, lambda s: s["path"]),
    )


def count_orderings(graph: Column, cap: int, by_size: Callable[..., Column] = _by_size) -> Column:
    """The number of orderings of an acyclic graph, or ``cap`` if there are more.

    Every prefix leads to an ordering of its own, so counting stops at the first level
    that has ``cap`` prefixes.
    """

    def build(state: _State) -> Column:
        def grow(states: Column, _: Column) -> Column:
            children = F.flatten(
                F.transform(
                    states,
                    lambda s: F.transform(
                        F.slice(state.ready(s), 1, cap), lambda x: state.place(s, x)
                    ),
                )
            )
            grown = F.slice(children, 1, cap)
            if isinstance(state, _Lists):
                # Many wide states are not built only to be counted.
                total = F.aggregate(
                    states, F.lit(0), lambda t, s: t + F.size(s["ready"]).cast("int")
                )
                enough = F.array_repeat(F.get(states, F.lit(0)), cap)
                grown = F.when(total >= cap, enough).otherwise(grown)
            return F.when(F.size(states) >= cap, states).otherwise(grown)

        return F.aggregate(upto(F.size(graph["ids"])), F.array(state.start), grow, F.size)

    return F.least(by_size(graph, build), F.lit(cap))


def is_acyclic(graph: Column) -> Column:
    return _by_size(graph, lambda state: F.size(_first(graph, state)) == F.size(graph["ids"]))


def _draw(graph: Column, rng: Column, state: _State) -> Column:
    """One random ordering as text ',0,2,1': a uniform choice among the ready nodes per step."""

    def step(s: Column, _: Column) -> Column:
        def advance(slot: Column) -> Column:
            return F.struct(
                F.concat(s["path"], slot["mark"]).alias("path"),
                state.place(s["state"], slot).alias("state"),
                next_state(s["rng"]).alias("rng"),
            )

        return let(state.choose(s["state"], s["rng"]), advance)

    start = F.struct(F.lit("").alias("path"), state.start.alias("state"), rng.alias("rng"))
    return F.aggregate(upto(F.size(graph["ids"])), start, step, lambda s: s["path"])


def _rounds(attempts: int) -> list[tuple[int, int]]:
    """1..attempts cut into ranges, each half as long as all before it."""
    cuts, low = [], 1
    while low <= attempts:
        width = max(FIRST_ROUND, low // 2)
        cuts.append((low, min(low + width - 1, attempts)))
        low += width
    return cuts


def sample_orderings(
    graph: Column, key: Column, n: int = 500, seed: int = 0, by_size: Callable[..., Column] = _by_size
) -> Column:
    """The first n distinct orderings among 5n random ones, in order of their attempts.

    Attempts run in rounds. A round is skipped once n distinct orderings are there, or
    all the graph has: more attempts could not change the answer then. A cyclic graph
    has no orderings and gives an empty list.
    """
    bounds = F.array(
        *[
            F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))
            for low, high in _rounds(n * ATTEMPTS_PER_SAMPLE)
        ]
    )

    def run(goal: Column, state: _State) -> Column:
        def one_round(found: Column, bound: Column) -> Column:
            drawn = F.transform(
                F.sequence(bound["low"], bound["high"]),
                lambda attempt: _draw(graph, start_state(seed, key, attempt), state),
            )
            return F.when(F.size(found) >= goal, found).otherwise(
                F.array_distinct(F.concat(found, F.array_compact(drawn)))
            )

        return F.aggregate(bounds, empty("array<string>"), one_round)

    prepared = F.struct(
        count_orderings(graph, n, by_size).alias("goal"), _ready_table(graph).alias("table")
    )
    found = let(
        prepared,
        lambda p: by_size(graph, lambda state: run(p["goal"], state), p["table"]),
    )
    return F.transform(
        F.slice(found, 1, n),
        lambda text: F.split(F.substring(text, F.lit(2), F.length(text)), ",").cast("array<int>"),
    )


def generation_plan(estimate: Column, for_cots: bool = False) -> Column:
    """struct(method, cap): sampling for loosely constrained graphs, else exhaustive."""
    caps, samples = (CAPS_COTS, SAMPLES_COTS) if for_cots else (CAPS_FULL, SAMPLES_FULL)
    return F.struct(
        F.when(estimate["use_sampling"], "sampling").otherwise("exhaustive").alias("method"),
        F.when(estimate["use_sampling"], samples)
        .when(estimate["complexity"] == "MEDIUM", caps["MEDIUM"])
        .otherwise(caps["LOW"])
        .alias("cap"),
    )


def reasoning_paths(results: DataFrame, for_cots: bool = False, seed: int = 0) -> DataFrame:
    """Orderings per example; examples that cannot have any keep a row with an error.

    Orderings stay node numbers next to one copy of the node ids and texts; ``path_rows``
    spells them out. ``example_ord`` passes through when the input has it. Graphs of up to MAX_BITS
    nodes are handled together by Arrow batch (``order_batches``), wider ones as expressions.
    """
    keys = [c for c in ("example_ord", "example_id") if c in results.columns]
    graph, key = F.col("graph"), F.col("example_id")
    error = F.when(graph.isNull(), INVALID_INPUT).when(
        ~listed_in_order(graph) & ~is_acyclic(graph), CYCLIC
    )
    checked = computed_once(with_graph(results, lean=True), [*keys, "graph"], error.alias("error"))
    planned = computed_once(
        checked,
        [*keys, "graph", "error"],
        F.when(F.col("error").isNull(), complexity_estimate(graph)).alias("complexity_estimate"),
    ).withColumn("plan", generation_plan(F.col("complexity_estimate"), for_cots))
    samples = SAMPLES_COTS if for_cots else SAMPLES_FULL
    good, plan = F.col("error").isNull(), F.col("plan")
    sampling, small = plan["method"] == "sampling", F.size(graph["ids"]) <= MAX_BITS
    wide = F.when(
        good & ~small,
        F.when(sampling, sample_orderings(graph, key, samples, seed, _wide)).otherwise(
            enumerate_orderings(graph, plan["cap"], _wide)
        ),
    )
    rows = planned.select(
        *keys,
        "error",
        "complexity_estimate",
        F.when(good, plan["method"]).alias("method"),
        graph["ids"].alias("node_ids"),
        graph["texts"].alias("node_texts"),
        wide.alias("wide"),
        F.when(good & small, F.size(graph["ids"])).otherwise(0).cast("bigint").alias("nodes"),
        F.coalesce(F.when(good & small, graph["codes"]), empty("array<bigint>")).alias("edges"),
        F.coalesce(plan["cap"], F.lit(0)).cast("bigint").alias("cap"),
        F.coalesce(sampling, F.lit(False)).alias("sample"),
        key.alias("key"),
    )
    rounds = _rounds(samples * ATTEMPTS_PER_SAMPLE)
    schema = StructType([*rows.schema.fields[:-5], StructField("orderings", ArrayType(ArrayType(IntegerType())))])
    found = rows.mapInArrow(partial(add_orderings, samples, seed, rounds), schema)
    found = found.withColumn("orderings", F.coalesce("orderings", "wide"))
    return found.select(
        *keys,
        "error",
        "complexity_estimate",
        "method",
        F.when(F.col("error").isNull(), F.size("orderings")).alias("total_paths"),
        "node_ids",
        "node_texts",
        "orderings",
    )


def path_rows(paths: DataFrame) -> DataFrame:
    """One row per ordering: example_id, path_no (1-based), sequence, texts."""
    keys = [c for c in ("example_ord", "example_id") if c in paths.columns]
    rows = paths.select(
        *keys, "node_ids", "node_texts", F.posexplode("orderings").alias("at", "ordering")
    )
    return rows.select(
        *keys,
        (F.col("at") + 1).alias("path_no"),
        spelled(F.col("ordering"), F.col("node_ids")).alias("sequence"),
        spelled(F.col("ordering"), F.col("node_texts")).alias("texts"),
    )


def spelled(ordering: Column, names: Column) -> Column:
    """Node numbers of one ordering replaced by their ids or texts."""
    return F.transform(ordering, lambda v: F.get(names, v))
