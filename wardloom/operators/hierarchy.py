"""Parent-child links to full hierarchies by tree contraction.

Each round rakes every leaf and splices an independent set of unary nodes
(nodes with one child left), so long chains shrink as fast as bushy trees and
the number of links falls geometrically. The contractions are recorded. The
core that is left, of bounded size, is finished by one task with pointer
jumping; what does not end at a root there is a cycle. Playing the records
backwards gives root, depth and path of every node. As the rounds shrink
geometrically, reading all later rounds in each step of the replay adds up to
a constant number of passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wardloom.session import discard, materialize

ON_CYCLE, INTO_CYCLE = -1, -2
CORE = 8192  # links that one task may finish
CORE_VIA = 500_000  # ids spliced out of these links, at most


def parent_links(
    relations: DataFrame,
    concepts: DataFrame,
    up: str = "isa",
    down: str = "subsumes",
) -> DataFrame:
    """Distinct ``(node, parent)`` edges in force between concepts that exist.

    Letter case, blanks and punctuation of ``relationship_id`` are ignored.
    Self edges, withdrawn edges (non-blank ``invalid_reason``), null ends and
    edges to absent concepts are left out; repeated edges count once.
    """
    kind = F.regexp_replace(F.lower("relationship_id"), "[^a-z]", "")
    edges = (
        relations.where(F.trim(F.coalesce("invalid_reason", F.lit(""))) == "")
        .where(kind.isin(up, down) & (F.col("concept_id_1") != F.col("concept_id_2")))
        .select(
            F.when(kind == up, F.col("concept_id_1")).otherwise(F.col("concept_id_2")).alias("node"),
            F.when(kind == up, F.col("concept_id_2")).otherwise(F.col("concept_id_1")).alias("parent"),
        )
        .distinct()
    )
    known = concepts.select(F.col("concept_id").alias("node")).where("node is not null").distinct()
    return edges.join(known, "node", "left_semi").join(
        known.withColumnRenamed("node", "parent"), "parent", "left_semi"
    )


def _order(c: Column, salt: int) -> Column:
    return F.xxhash64(c, F.lit(salt))


def _kept(edges: DataFrame) -> DataFrame:
    """One parent per node, the smallest id."""
    return (
        edges.select("node", "parent")
        .where("node is not null and parent is not null and node <> parent")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"), F.max("parent").alias("last"))
    )


def resolve(edges: DataFrame, paths: bool = False, max_rounds: int = 200, core: int = CORE) -> DataFrame:
    """``(node, root, depth, steps, from_cycle)`` of every end of ``edges(node, parent)``.

    ``depth`` is the distance from the root, ``ON_CYCLE`` (-1) for a node on a
    cycle and ``INTO_CYCLE`` (-2) for a node whose ancestors lead into one; for
    both ``root`` is the smallest id of that cycle. ``steps`` counts the links
    from the root down to the node, around the cycle where there is one;
    ``from_cycle`` counts those after the cycle (0 on it, null in a tree). With
    ``paths`` a column ``path`` lists the ids from the root down to the node,
    in cyclic parts too.

    A node with several parents keeps the smallest parent id, so the result has
    one row per node; the other links are no part of any path, but their ends
    come out, and :func:`link_report` lists them. Null ends and self edges are
    ignored, repeated edges count once; an empty input gives an empty result.
    Extra columns are ignored. ``core`` is the number of links from which on
    contraction goes on in rounds; results do not depend on it.
    """
    via_type = "array<" + dict(edges.dtypes)["node"] + ">"
    via = ["via"] if paths else []
    size = F.sum(F.size("via")) if paths else F.lit(0)

    def watched(df: DataFrame, label: str, left: Column, other: Column) -> tuple[DataFrame, int, int, int, int]:
        """``df`` written, with the links left, those that are no self loops, the ids in them, and rows that are ``other``."""
        seen = Observation()
        count = lambda c: F.count(F.when(c, 1))
        out = materialize(
            df.observe(
                seen,
                count(left).alias("left"),
                count(left & (F.col("node") != F.col("parent"))).alias("open"),
                F.coalesce(size, F.lit(0)).alias("via"),
                count(other).alias("other"),
            ),
            label,
        )
        got = seen.get
        return out, got["left"], got["open"], got["via"], got["other"]

    links = _kept(edges).select(
        "node", "parent", F.lit(1).cast("long").alias("w"), *([F.array().cast(via_type).alias("via")] if paths else []), "last"
    )
    links, left, open_, _, dropped = watched(links, "links", F.lit(True), F.col("last") != F.col("parent"))
    live, held, steps = links.drop("last"), 0, []
    for salt in range(max_rounds):
        if open_ == 0 or (left <= core and held <= CORE_VIA):
            break
        step, left, open_, held, _ = watched(_contract(live, salt, via), f"contract{salt}", F.col("what") == "live", F.lit(False))
        steps.append(step)
        live = step.where("what = 'live'").drop("child", "what")
    else:
        raise RuntimeError(f"contraction did not end within {max_rounds} rounds")

    # links that no path uses may have ends of their own
    ends = edges.where("node is not null and node <> parent") if dropped else links
    roots = ends.select(F.col("parent").alias("node")).where("node is not null").distinct()
    roots = roots.join(links.select("node"), "node", "left_anti")
    zero = F.lit(0).cast("long")
    roots = roots.select(
        "node",
        F.col("node").alias("root"),
        zero.alias("steps"),
        F.lit(None).cast("long").alias("from_cycle"),
        *([F.array("node").cast(via_type).alias("path")] if paths else []),
    )
    if left <= core and held <= CORE_VIA:
        finished = live.repartition(1).mapInArrow(_finish, roots.schema)
    else:  # self loops only: cycles contracted to their smallest ids
        finished = live.select(
            "node", F.col("node").alias("root"), zero.alias("steps"), zero.alias("from_cycle"),
            *([F.array("node").cast(via_type).alias("path")] if paths else []),
        )
    done = materialize(roots.unionByName(finished), "core")
    for k, step in enumerate(reversed(steps)):
        found = materialize(_restore(done, step.where("what <> 'live'"), paths), f"expand{k}")
        done = done.unionByName(found)
    discard(links, *steps)
    depth = F.when(F.col("from_cycle") == 0, ON_CYCLE).when(F.col("from_cycle") > 0, INTO_CYCLE).otherwise(F.col("steps"))
    return done.select(
        "node", "root", depth.cast("long").alias("depth"), "steps", "from_cycle", *(["path"] if paths else [])
    )


def _contract(live: DataFrame, salt: int, via: list[str]) -> DataFrame:
    """One round: every link with what becomes of its node, and links across spliced nodes joined.

    The smallest id of a chain's neighbourhood is never spliced, so a cycle
    ends as a self loop of its smallest id.
    """
    children = live.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("child"))
    own = _order(F.col("node"), salt)
    splice = (
        (F.col("n") == 1)
        & (F.col("node") != F.col("parent"))
        & (own < _order(F.col("parent"), salt))
        & (own < _order(F.col("child"), salt))
        & ((F.col("node") > F.col("parent")) | (F.col("node") > F.col("child")))
    )
    marked = live.join(children, "node", "left").select(
        *live.columns,
        F.when(splice, F.col("child")).alias("child"),
        F.when(F.col("n").isNull(), "rake").when(splice, "splice").otherwise("live").alias("what"),
    )
    # a spliced node tells its only child, raked or not, to hang from the spliced node's parent
    told = marked.where("what = 'splice'").select(
        F.col("child").alias("node"),
        F.col("node").alias("through"),
        F.col("parent").alias("to"),
        F.col("w").alias("more"),
        *(F.col(c).alias("front") for c in via),
    )
    moved = F.col("through").isNotNull()
    return marked.join(told, "node", "left").select(
        "node",
        F.coalesce("to", "parent").alias("parent"),
        (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
        *(F.when(moved, F.concat("front", F.array("through"), c)).otherwise(F.col(c)).alias(c) for c in via),
        "child",
        "what",
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root, steps and distance from the cycle of every node of a core, by pointer jumping."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    links = pa.Table.from_batches(batches)
    node, parent, w = (links.column(c).to_numpy() for c in ("node", "parent", "w"))
    ids = np.unique(np.concatenate([node, parent]))
    at = np.searchsorted(ids, node)
    up = np.arange(len(ids))
    up[at] = np.searchsorted(ids, parent)
    length = np.zeros(len(ids), np.int64)
    length[at] = w
    rounds = range(len(ids).bit_length())

    def summed(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the way to each fixed point, and that point."""
        total, to = np.where(to == np.arange(len(to)), 0, length), to
        for _ in rounds:
            total, to = total + total[to], to[to]
        return total, to

    far, low = up, np.arange(len(ids))
    for _ in rounds:
        low, far = np.minimum(low, low[far]), far[far]
    ring = np.zeros(len(ids), bool)
    ring[far] = True
    linked = np.zeros(len(ids), bool)
    linked[at] = True
    ring &= linked
    cut = np.where(ring & (low == np.arange(len(ids))), np.arange(len(ids)), up)
    steps, root = summed(cut)
    below, entry = summed(np.where(ring, np.arange(len(ids)), up))
    names = ["node", "root", "steps", "from_cycle"]
    columns = [pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(steps[at]), pa.array(below[at], mask=~ring[entry[at]])]
    if "via" not in links.column_names:
        yield pa.record_batch(columns, names)
        return
    skipped = dict(zip(at.tolist(), links.column("via").to_pylist()))

    def path(x: int) -> list[int]:
        parts = []
        while cut[x] != x:
            parts.append([*skipped[x], int(ids[x])])
            x = int(cut[x])
        return [int(ids[x]), *(y for part in reversed(parts) for y in part)]

    begin = 0
    while begin < len(at):
        rows, held = [], 0
        while begin + len(rows) < len(at) and held < 200_000:
            rows.append(path(int(at[begin + len(rows)])))
            held += len(rows[-1])
        piece = [c.slice(begin, len(rows)) for c in columns]
        yield pa.record_batch([*piece, pa.array(rows, pa.list_(pa.from_numpy_dtype(ids.dtype)))], [*names, "path"])
        begin += len(rows)


def _restore(done: DataFrame, record: DataFrame, paths: bool) -> DataFrame:
    """Undo one round: every removed node hangs from a node that is already resolved."""
    above = done.select(F.col("node").alias("parent"), "root", "steps", "from_cycle", *(["path"] if paths else []))
    # a spliced node lies on a cycle exactly when its parent and its only child do
    asks = (F.col("what") == "splice") & F.coalesce(F.col("from_cycle") == 0, F.lit(False))
    rings = done.where("from_cycle = 0").select(F.col("node").alias("asked"), F.lit(True).alias("ring"))
    back = (
        record.join(above, "parent")
        .withColumn("asks", asks)
        # rows that need no answer are spread by a hash, not gathered in one key
        .withColumn("asked", F.when(F.col("asks"), F.col("child")).otherwise(F.xxhash64("node")))
        .join(rings, "asked", "left")
    )
    on_ring = F.col("asks") & F.coalesce("ring", F.lit(False))
    return back.select(
        "node",
        "root",
        (F.col("steps") + F.col("w")).alias("steps"),
        F.when(on_ring, F.lit(0)).otherwise(F.col("from_cycle") + F.col("w")).cast("long").alias("from_cycle"),
        *([F.concat("path", "via", F.array("node")).alias("path")] if paths else []),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for every proper pair of ``resolve(paths=True)``.

    One row per pair, never one array per ancestor, so a root above a third of
    all nodes stays spread over tasks. Every node of a cycle is an ancestor of
    all others on it and of all below it; ``distance`` counts the links of the
    shortest way down.
    """
    first = F.coalesce(F.col("steps") - F.col("from_cycle") + 2, F.lit(1)).cast("int")
    many = F.greatest(F.size("path") - first, F.lit(0))
    plain = resolved.select(
        F.posexplode(F.slice("path", first, many)).alias("at", "ancestor"),
        F.col("node").alias("descendant"),
        (F.col("steps") - first + 1 - F.col("at")).cast("long").alias("distance"),
    ).select("ancestor", "descendant", "distance")
    cyclic = resolved.where("from_cycle is not null")
    rings = cyclic.where("from_cycle = 0").select("root", F.col("node").alias("ancestor"), F.col("steps").alias("pos"))
    rings = rings.join(rings.groupBy("root").agg(F.count("*").alias("around")), "root")
    below = cyclic.select("root", F.col("node").alias("descendant"), (F.col("steps") - F.col("from_cycle")).alias("entry"), "from_cycle")
    around = (
        below.join(rings, "root")
        .where("ancestor <> descendant")
        .select("ancestor", "descendant", (F.expr("pmod(entry - pos, around)") + F.col("from_cycle")).cast("long").alias("distance"))
    )
    return plain.unionByName(around)


def link_report(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(node, parent, status)`` of every distinct edge.

    'tree', 'on cycle' or 'below cycle' by where the node lies, and 'other
    parent' for a link that no path uses because the node has a smaller
    parent. Null ends and self edges are left out.
    """
    clean = edges.select("node", "parent").where("node is not null and parent is not null and node <> parent").distinct()
    used = _kept(edges).select("node", F.col("parent").alias("first"))
    status = (
        F.when(F.col("parent") != F.col("first"), "other parent")
        .when(F.col("from_cycle") == 0, "on cycle")
        .when(F.col("from_cycle") > 0, "below cycle")
        .otherwise("tree")
    )
    return (
        clean.join(used, "node")
        .join(resolved.select("node", "from_cycle"), "node")
        .select("node", "parent", status.alias("status"))
    )
