"""Step graphs: one graph per example record, expressed over its node and edge arrays.

A graph comes out of one bounded model response, so all work on it stays inside its own
row: no shuffle, and no example waits for another. Nodes are numbered 0.. in list order,
because string ids would sort s10 before s2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotflow.functions.lambdas import computed_once, empty, let, upto

# Constraint-ratio thresholds with their labels and path-count texts.
LEVELS = (
    (2.0, "LOW", "1–10"),
    (1.0, "MEDIUM", "10–1,000"),
    (0.5, "HIGH", "1,000–100,000"),
    (None, "VERY HIGH", "100,000+"),
)
SAMPLED_LEVELS = ("HIGH", "VERY HIGH")
INVALID_INPUT = "Invalid input"
CYCLIC = "Graph contains cycles"

MAX_BITS = 62


def node_ids(nodes: Column) -> Column:
    return F.array_distinct(F.transform(nodes, lambda n: n["id"]))


def valid_edges(edges: Column, ids: Column) -> Column:
    """Edges with exactly two endpoints that both name a node."""

    def known(e: Column) -> Column:
        return (
            (F.size(e) == 2)
            & F.array_contains(ids, F.get(e, F.lit(0)))
            & F.array_contains(ids, F.get(e, F.lit(1)))
        )

    return F.filter(edges, lambda e: F.coalesce(known(e), F.lit(False)))


def build_graph(nodes: Column, edges: Column, lean: bool = False) -> Column:
    """struct(ids, texts, codes, sources, sinks, slots, wide).

    ``codes`` holds each distinct edge as src*n+dst. ``slots`` has one entry per node for
    graphs whose node set fits the bits of a long: the node's own bit, the bits of its
    predecessors, both together, and the node's text mark. Larger graphs use ``wide``: per node
    the lists of its predecessors and of its successors. A ``lean`` graph has slots only where it is
    not ``listed_in_order``: what lists orderings by batch reads the codes.
    """

    def with_ids(ids: Column) -> Column:
        n = F.size(ids).cast("bigint")

        def code(e: Column) -> Column:
            src = F.array_position(ids, F.get(e, F.lit(0))) - 1
            return src * n + F.array_position(ids, F.get(e, F.lit(1))) - 1

        codes = F.array_distinct(F.transform(valid_edges(edges, ids), code))
        return let(F.struct(ids.alias("ids"), codes.alias("codes")), lambda g: with_codes(g, n))

    def with_codes(g: Column, n: Column) -> Column:
        ids, codes = g["ids"], g["codes"]
        steps = F.transform(upto(F.size(ids)), lambda v: v - 1)

        def last_text(v: Column) -> Column:
            return F.element_at(F.filter(nodes, lambda m: m["id"] == v), -1)["text"]

        def sources_of(w: Column) -> Column:
            return F.transform(
                F.filter(codes, lambda c: c % n == w), lambda c: F.floor(c / n).cast("int")
            )

        def slot(w: Column) -> Column:
            bits = F.aggregate(
                sources_of(w), F.lit(0).cast("bigint"), lambda m, v: m.bitwiseOR(bit(v))
            )
            return let(
                bits,
                lambda before: F.struct(
                    w.alias("node"),
                    mark(w).alias("mark"),
                    bit(w).alias("bit"),
                    before.alias("before"),
                    before.bitwiseOR(bit(w)).alias("both"),
                ),
            )

        def targets_of(v: Column) -> Column:
            return F.transform(
                F.filter(codes, lambda c: F.floor(c / n) == v), lambda c: (c % n).cast("int")
            )

        def unused(ends: Column) -> Column:
            return F.size(ids) - F.size(F.array_distinct(ends))

        wide = F.when(
            n > MAX_BITS,
            F.struct(
                F.transform(steps, sources_of).alias("before"),
                F.transform(steps, targets_of).alias("after"),
            ),
        )
        narrow = n <= MAX_BITS
        if lean:
            narrow = narrow & ~listed_in_order(g)
        return F.struct(
            ids.alias("ids"),
            F.transform(ids, last_text).alias("texts"),
            codes.alias("codes"),
            unused(F.transform(codes, lambda c: c % n)).alias("sources"),
            unused(F.transform(codes, lambda c: F.floor(c / n))).alias("sinks"),
            F.when(narrow, F.transform(steps, slot)).alias("slots"),
            wide.alias("wide"),
        )

    return let(node_ids(nodes), with_ids)


def listed_in_order(graph: Column) -> Column:
    """Does every edge lead from a node to one listed later? Such a graph has no cycle."""
    n = F.size(graph["ids"])
    return F.forall(graph["codes"], lambda c: F.call_function("div", c, n) < c % n)


def mark(v: Column) -> Column:
    """A node number as it is appended to an ordering's text."""
    return F.concat(F.lit(","), v.cast("string"))


def bit(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), v)


def edge_list(graph: Column) -> Column:
    """Distinct edges of a built graph as array<struct<src,dst>> of node ids."""
    n = F.size(graph["ids"])
    return F.transform(
        graph["codes"],
        lambda c: F.struct(
            F.get(graph["ids"], F.floor(c / n).cast("int")).alias("src"),
            F.get(graph["ids"], (c % n).cast("int")).alias("dst"),
        ),
    )


def constraint_ratio(graph: Column) -> Column:
    return F.size(graph["codes"]) / F.greatest(F.size(graph["ids"]) - 1, F.lit(1))


def complexity_estimate(graph: Column) -> Column:
    """Labels from the unrounded ratio; the reported ratio is rounded half-even."""

    def ladder(ratio: Column, pick: int) -> Column:
        found = None
        for level in LEVELS:
            if level[0] is None:
                return found.otherwise(F.lit(level[pick]))
            hit = ratio >= F.lit(level[0])
            found = F.when(hit, level[pick]) if found is None else found.when(hit, level[pick])
        raise AssertionError("the last level has no threshold")

    def describe(ratio: Column) -> Column:
        label = ladder(ratio, 1)
        return F.struct(
            label.alias("complexity"),
            ladder(ratio, 2).alias("estimated_paths"),
            F.size(graph["ids"]).alias("nodes"),
            F.size(graph["codes"]).alias("edges"),
            F.bround(ratio, 2).alias("constraint_ratio"),
            graph["sources"].alias("source_nodes"),
            graph["sinks"].alias("sink_nodes"),
            (graph["sources"] * graph["sinks"]).alias("source_sink_pairs"),
            label.isin(*SAMPLED_LEVELS).alias("use_sampling"),
        )

    return let(constraint_ratio(graph), describe)


def valid_input(success: Column, nodes: Column, edges: Column) -> Column:
    return F.coalesce(success & (F.size(nodes) > 0) & (F.size(edges) > 0), F.lit(False))


def with_graph(results: DataFrame, lean: bool = False) -> DataFrame:
    """The keys and ``graph``, which is NULL where the record is no valid graph input."""
    keys = [c for c in ("example_ord", "example_id") if c in results.columns]
    graph = F.when(
        valid_input(F.col("success"), F.col("nodes"), F.col("edges")),
        build_graph(F.col("nodes"), F.col("edges"), lean),
    )
    return computed_once(results, keys, graph.alias("graph"))


# A calculated number follows an equals sign; every other number of a text is used.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
RESULT = rf"=\s*\$?({NUMBER})"


def _numbers(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))


def calculated_numbers(text: Column) -> Column:
    return _numbers(text, RESULT)


def used_numbers(text: Column) -> Column:
    return _numbers(F.regexp_replace(text, RESULT, "="), f"({NUMBER})")


def value_dependency_edges(nodes: Column) -> Column:
    """Edge A→B when B uses a number that the earlier A calculated.

    Compares the nodes of a record pair by pair; ``value_dependency_edge_rows`` looks numbers up
    instead, for records of hundreds of nodes.
    """
    parsed = F.transform(
        nodes,
        lambda n, i: F.struct(
            n["id"].alias("id"),
            i.alias("at"),
            calculated_numbers(n["text"]).alias("made"),
            used_numbers(n["text"]).alias("used"),
        ),
    )

    def edges_of(all_nodes: Column) -> Column:
        def out_of(a: Column) -> Column:
            users = F.filter(
                all_nodes,
                lambda b: (b["at"] > a["at"]) & F.arrays_overlap(a["made"], b["used"]),
            )
            return F.transform(users, lambda b: F.array(a["id"], b["id"]))

        return F.flatten(F.transform(all_nodes, out_of))

    return F.coalesce(let(parsed, edges_of), empty("array<array<string>>"))


def value_dependency_edge_rows(records: DataFrame) -> DataFrame:
    """(example_id, src, dst, src_at, dst_at): the same edges for (example_id, nodes) as rows.

    Nodes meet in an equi-join on record and number, so the work grows with the numbers and the
    edges there are, and a long record spreads over all partitions. Positions tell nodes apart that
    share an id.
    """
    nodes = records.select("example_id", F.posexplode("nodes").alias("at", "n")).select("example_id", "at", "n.id", "n.text")

    def numbers(found: Column, end: str) -> DataFrame:
        return nodes.select(
            "example_id", F.col("at").alias(f"{end}_at"), F.col("id").alias(end), F.explode(F.array_distinct(found)).alias("value")
        )

    made = numbers(calculated_numbers(F.col("text")), "src")
    used = numbers(used_numbers(F.col("text")), "dst")
    met = made.join(used, ["example_id", "value"]).where("src_at < dst_at")
    return met.select("example_id", "src", "dst", "src_at", "dst_at").distinct()
