"""Most similar vectors for every vector: a hierarchical k-means tree walked best bin first.

The tree splits a sample until its leaves are small, so its depth follows the
data. Every vector lies in the
nearest leaf that a few nearest nodes at each depth lead to. A query walks
the tree through a priority queue of nodes, the nearest first: it opens inner
nodes and visits leaves until the nearest node left lies beyond a margin over
the nearest on the query's own way down. The margins are widened until the leaves visited hold
the wanted share of the true neighbours of sample queries, found by brute
force. Neighbouring leaves share a block, one task's unit of work, so a query
travels once per block, not once per leaf; a leaf larger than a block is cut
into several, and a block that many queries visit is copied for parts of them,
so a group holds a bounded number of rows on both sides. Within a large leaf
the walk goes on in a tree of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.session import materialize

SAMPLE, MOST_SAMPLE = 60_000, 500_000  # vectors the tree is fitted on: a fiftieth of all within these bounds
LEAST_LEAF = 8  # sample vectors a leaf holds at least; bounds the tree at MOST_SAMPLE / LEAST_LEAF leaves (12 MB of 48 values)
LEAF_ROWS = 1000  # rows a leaf should hold
FANOUT = 64  # children of a node, at most
BEAM = 3  # nodes opened at each depth to find the leaf a vector lies in
LARGE_LEAF = 4 * LEAF_ROWS  # rows of a leaf in a block above which the leaf gets a tree of its own
BLOCK_ROWS = 8192  # rows a block holds, about
BLOCK_ASKS = 65_536  # queries a copy of a block should get, about
PROBES = 600  # sample queries for calibration
PIECE = 4096  # queries walked at once
ROUND = 7  # digits to which similarities are compared


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, vec)`` of rows with a key and a vector of ``dim`` finite values, not all zero; rows sent twice stay."""
    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vec")).where(
        f"id is not null and vec is not null and size(vec) = {dim}"
        " and forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('Infinity'))"
        " and exists(vec, x -> x <> 0)"
    )


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as unit vectors in double precision, safe for any length."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each row, of at most ``k`` (k-means with farthest-first reseeding of empty ones)."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        member = np.zeros((k, len(x)), np.float32)
        member[at, np.arange(len(x))] = 1
        sums = member @ x
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            far = d[np.arange(len(x)), at].argsort()[::-1][: int((n == 0).sum())]
            centres[n == 0] = x[far]
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class Tree:
    """Nodes by number: centre, parent, depth, children; node 0 is the root. Leaves are numbered side by side."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 7):
        """Splits until nodes hold at most ``leaf`` rows of ``x`` or rows that no split parts."""
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        centres, parents, depths, kids = [x.mean(0)], [-1], [0], {}
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if len(rows) <= leaf:
                continue
            fit = rows if len(rows) <= 20_000 else rng.choice(rows, 20_000, replace=False)
            at = _kmeans(x[fit], min(FANOUT, max(2, -(-len(rows) // leaf))), 8, rng)
            centre = np.stack([x[fit[at == c]].mean(0) for c in np.unique(at)])
            if len(centre) < 2:
                continue
            at = ((centre * centre).sum(1)[None, :] - 2 * x[rows] @ centre.T).argmin(1)
            kids[node] = (len(centres), len(centre))
            for c in range(len(centre)):
                stack.append((len(centres), rows[at == c]))
                centres.append(centre[c])
                parents.append(node)
                depths.append(depths[node] + 1)
        self.centres, self.parent, self.depth = np.stack(centres), np.array(parents), np.array(depths)
        self.first = np.array([kids.get(i, (0, 0))[0] for i in range(len(centres))])
        self.many = np.array([kids.get(i, (0, 0))[1] for i in range(len(centres))])
        self.levels = int(self.depth.max()) + 1
        # leaves in the order of a walk down, so that neighbours in the tree are neighbours in number
        self.leaf_of, self.node_of, stack = np.full(len(centres), -1), [], [0]
        while stack:
            node = stack.pop()
            if self.many[node]:
                stack.extend(range(self.first[node], self.first[node] + self.many[node]))
            else:
                self.leaf_of[node] = len(self.node_of)
                self.node_of.append(node)
        self.node_of = np.array(self.node_of)
        self.squares = (self.centres * self.centres).sum(1)
        self.inner = np.full(self.levels, np.inf, np.float32)  # margins of inner nodes by depth
        self.slack = np.float32(np.inf)  # margin of leaves

    def _distances(self, x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child, distance) of the children of each row's node; absent children are infinitely far."""
        if len(nodes) and (nodes == nodes[0]).all():
            child = np.broadcast_to(self.first[nodes[0]] + np.arange(self.many[nodes[0]]), (len(x), self.many[nodes[0]]))
            d = self.squares[child[0]][None, :] - 2 * x @ self.centres[child[0]].T
        else:
            wide = int(self.many[nodes].max(initial=1))
            child = self.first[nodes][:, None] + np.arange(wide)
            there = np.arange(wide) < self.many[nodes][:, None]
            child = np.where(there, child, 0)
            d = self.squares[child] - 2 * np.matmul(self.centres[child], x[:, :, None])[:, :, 0]
            d[~there] = np.inf
        return child, np.sqrt(np.maximum(d + (x * x).sum(1)[:, None], 0))

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf node of each row, and the least distance to inner nodes by depth, to leaves last."""
        x = x.astype(np.float32)
        every = np.arange(len(x))
        best, node = np.full(len(x), np.inf, np.float32), np.zeros(len(x), np.int64)
        way = np.full((len(x), self.levels + 1), np.inf, np.float32)
        beam = np.zeros((len(x), 1), np.int64)
        for level in range(1, self.levels):
            keys, kids = [], []
            for b in range(beam.shape[1]):
                go = np.flatnonzero(beam[:, b] >= 0)
                if not len(go):
                    continue
                child, d = self._distances(x[go], beam[go, b])
                end = self.many[child] == 0
                leaf_d = np.where(end, d, np.inf)
                at = leaf_d.argmin(1)
                near = leaf_d[np.arange(len(go)), at]
                closer = near < best[go]
                best[go[closer]], node[go[closer]] = near[closer], child[np.arange(len(go)), at][closer]
                key, kid = np.full((len(x), child.shape[1]), np.inf, np.float32), np.full((len(x), child.shape[1]), -1)
                key[go], kid[go] = np.where(end, np.inf, d), child
                keys.append(key)
                kids.append(kid)
            if not keys:
                break
            key, kid = np.hstack(keys), np.hstack(kids)
            take = np.argpartition(key, min(BEAM, key.shape[1]) - 1, axis=1)[:, :BEAM]
            key, kid = np.take_along_axis(key, take, 1), np.take_along_axis(kid, take, 1)
            way[:, level] = key.min(1)
            beam = np.where(np.isfinite(key), kid, -1)
            beam = beam[:, (beam >= 0).any(0)]
            if not beam.shape[1]:
                break
        way[:, -1] = best if self.levels > 1 else 0
        # where no inner node lies at a depth, the leaf stands for it
        way = np.where(np.isfinite(way), way, way[:, -1:])
        return node, way

    def home(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf each row lies in."""
        parts = [self.leaf_of[self.descend(x[i : i + PIECE])[0]] for i in range(0, len(x), PIECE)]
        return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)

    def visits(self, x: np.ndarray, widen: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves each row takes from its queue, the nearest first; ``widen`` multiplies the margins."""
        rows, leaves = [], []
        for i in range(0, len(x), PIECE):
            r, leaf = self._walk(x[i : i + PIECE].astype(np.float32), widen)
            rows.append(r + i)
            leaves.append(leaf)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)

    def visits_enough(self, x: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`visits`, with wider margins for rows whose leaves hold fewer than ``least`` of the ``rows`` per leaf."""
        row, leaf = self.visits(x)
        least, widen = min(least, int(rows.sum())), 1.0
        while True:
            short = np.bincount(row, rows[leaf], minlength=len(x)) < least
            if not short.any():
                return row, leaf
            widen *= 2
            who = np.flatnonzero(short)
            if widen > 1e6:  # every leaf
                more, at = np.repeat(np.arange(len(who)), len(rows)), np.tile(np.arange(len(rows)), len(who))
            else:
                more, at = self.visits(x[who], widen)
            keep = ~short[row]
            row, leaf = np.concatenate([row[keep], who[more]]), np.concatenate([leaf[keep], at])

    def _keys(self, way: np.ndarray, nodes: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Distances over the query's own way down, in margins: what lies above 1 is not visited."""
        deep = self.depth[nodes]
        leaf = self.many[nodes] == 0
        own = np.where(leaf, way[:, -1:], np.take_along_axis(way, deep, 1))
        return (d - own) / np.where(leaf, self.slack, self.inner[deep])

    def _walk(self, x: np.ndarray, widen: float) -> tuple[np.ndarray, np.ndarray]:
        _, way = self.descend(x)
        if self.levels == 1:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        queue_key, queue_node = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
        rows, leaves = [], []
        while len(live):
            # everything in the queue lies within the margins: leaves nearer than the nearest inner node leave it, then that node
            inner = np.where(self.many[queue_node] > 0, queue_key, np.inf)
            at = inner.argmin(1)
            every = np.arange(len(live))
            nearest = inner[every, at]
            out = (inner == np.inf) & (queue_key <= np.minimum(nearest, 1)[:, None])
            row, column = np.nonzero(out)
            order = np.lexsort((queue_key[row, column], row))
            rows.append(live[row[order]])
            leaves.append(self.leaf_of[queue_node[row[order], column[order]]])
            queue_key[out] = np.inf
            go = np.flatnonzero(nearest <= 1)
            live, queue_key, queue_node = live[go], queue_key[go], queue_node[go]
            if not len(go):
                break
            at = at[go]
            every = np.arange(len(go))
            node = queue_node[every, at]
            queue_key[every, at] = np.inf
            child, d = self._distances(x[live], node)
            keys = self._keys(way[live], child, d) / widen
            queue_key = np.hstack([queue_key, np.where(keys <= 1, keys, np.inf)])
            queue_node = np.hstack([queue_node, child])
            used = int(np.isfinite(queue_key).sum(1).max(initial=0))
            if queue_key.shape[1] > used + FANOUT:  # room of entries that have left
                keep = np.argpartition(queue_key, min(used, queue_key.shape[1] - 1), axis=1)[:, : max(used, 1)]
                queue_key, queue_node = np.take_along_axis(queue_key, keep, 1), np.take_along_axis(queue_node, keep, 1)
        return np.concatenate(rows), np.concatenate(leaves)

    def calibrate(self, probes: np.ndarray, neighbours: np.ndarray, of: np.ndarray, recall: float) -> None:
        """Widen the margins of inner nodes, then of leaves, until visits hold ``recall`` of the probes' neighbours."""
        if self.levels == 1:
            return
        probes = probes.astype(np.float32)
        _, way = self.descend(probes)
        node = self.descend(neighbours.astype(np.float32))[0]
        needs = []
        while (node > 0).any():
            deep = self.depth[node]
            d = np.sqrt(np.maximum(((probes[of] - self.centres[node]) ** 2).sum(1), 0))
            own = np.where(self.many[node] == 0, way[of, -1], way[of, deep])
            needs.append((node.copy(), d - own))
            node = np.where(node > 0, self.parent[node], 0)

        def widened(need: np.ndarray, share: float) -> np.float32:
            need = np.sort(need)
            return np.float32(max(need[min(len(need) - 1, int(np.ceil(share * len(need))))], 0) + 1e-4) if len(need) else np.float32(1e-4)

        loss = (1 - recall) / 2
        for level in range(1, self.levels):
            at = np.concatenate([need[(n > 0) & (self.depth[n] == level) & (self.many[n] > 0)] for n, need in needs])
            self.inner[level] = widened(at, 1 - loss / self.levels)
        self.slack = widened(np.concatenate([need[(n > 0) & (self.many[n] == 0)] for n, need in needs]), 1 - loss)
        self.inner[0] = 1
        while True:
            held = np.ones(len(of), bool)
            for n, need in needs:
                margin = np.where(self.many[n] == 0, self.slack, self.inner[self.depth[n]])
                held &= (n == 0) | (need <= margin)
            if held.mean() >= recall:
                return
            self.slack, self.inner = self.slack * np.float32(1.1), self.inner * np.float32(1.1)


def _probe_truth(vectors: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int, dim: int) -> tuple:
    """Brute-force neighbours of the probes: (probe, neighbour vector) pairs."""
    bc = vectors.sparkSession.sparkContext.broadcast((probes, ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a task's rows, a few more than ``k`` as rows may be repeated."""
        q, own = bc.value
        sims = np.full((len(q), 2 * k), -2.0)
        found, vecs = np.full((len(q), 2 * k), -1), np.zeros((len(q), 2 * k, dim), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            every, ids = _units(batch.column(1), dim), batch.column(0).to_numpy()
            for i in range(0, len(every), 2048):
                v, vid = every[i : i + 2048], ids[i : i + 2048]
                sim = q @ v.T
                sim[own[:, None] == vid[None, :]] = -2
                m = min(2 * k, sim.shape[1])
                top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                both = np.hstack([sims, np.take_along_axis(sim, top, 1)])
                keep = np.argpartition(-both, 2 * k - 1, axis=1)[:, : 2 * k]
                sims = np.take_along_axis(both, keep, 1)
                found = np.take_along_axis(np.hstack([found, vid[top]]), keep, 1)
                vecs = np.take_along_axis(np.concatenate([vecs, v[top].astype(np.float32)], 1), keep[:, :, None], 1)
        rows, cols = np.nonzero(sims > -2)
        yield pa.record_batch(
            [
                pa.array(rows.astype(np.int32)),
                pa.array(found[rows, cols]),
                pa.array(sims[rows, cols].round(ROUND)),
                pa.array(list(vecs[rows, cols]), pa.list_(pa.float32())),
            ],
            ["probe", "id", "sim", "vec"],
        )

    found = vectors.mapInArrow(best, "probe int, id long, sim double, vec array<float>").dropDuplicates(["probe", "id"])
    order = Window.partitionBy("probe").orderBy(F.desc("sim"), "id")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "vec").toArrow()
    return top.column(0).to_numpy(), _units(top.column(1).combine_chunks(), dim)


def plant(vectors: DataFrame, k: int, dim: int, recall: float) -> tuple[Tree | None, np.ndarray, float]:
    """A tree fitted on a bounded sample with margins calibrated to ``recall``, the sample, and its share of all rows."""
    n = vectors.count()
    if n == 0:
        return None, np.zeros((0, dim)), 1.0
    mark = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000_000))
    rate = min(1.0, max(SAMPLE, min(MOST_SAMPLE, n // 50)) / n)
    got = vectors.where(mark < int(rate * 1_000_000_000)).toArrow() if rate < 1 else vectors.toArrow()
    ids, at = np.unique(got.column(0).to_numpy(), return_index=True)
    sample = _units(got.column(1).combine_chunks(), dim)[at]
    tree = Tree(sample, max(LEAST_LEAF, round(LEAF_ROWS * rate)))
    rng = np.random.default_rng(11)
    pick = rng.choice(len(sample), min(PROBES, len(sample)), replace=False)
    probe, neighbour = _probe_truth(vectors, sample[pick], ids[pick], k, dim)
    if len(probe):
        tree.calibrate(sample[pick], neighbour, probe, recall)
    return tree, sample, rate


def neighbours(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, recall: float = 0.998) -> DataFrame:
    """``(id, neighbour, sim)``: the ``k`` most similar others of every usable vector by cosine.

    ``recall`` is the share of true neighbours the walk is calibrated to.
    Similarities are compared at ROUND digits, ties go to the smaller id; a
    vector is not its own neighbour. Null, short, long, zero, NaN or infinite
    vectors and null keys take no part; rows sent twice count once. Of a group
    of equal directions all members are answered, but only the k+1 smallest
    ids, which are all that can appear in any answer, are searched.
    """
    spark = df.sparkSession
    vectors = usable(df, key, vector, dim)
    tree, sample, rate = plant(vectors, k, dim, recall)
    if tree is None:
        return spark.createDataFrame([], "id long, neighbour long, sim double")
    bc = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = bc.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _units(batch.column(1), dim)
            leaf = tree.home(v)
            # equal directions of any length meet in one key; borders of rounding only split a group
            grid = np.ascontiguousarray(np.round(v, 5) + 0.0)
            bits = grid.view(np.uint64).reshape(grid.shape)
            mix = (np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            h = ((bits ^ (bits >> np.uint64(29))) * mix).sum(1, dtype=np.uint64)
            h ^= h >> np.uint64(31)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(leaf),
                    pa.array(h.view(np.int64)),
                    pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(dim * 4), len(v), [None, pa.py_buffer(v.astype(np.float32).tobytes())]
                    ).cast(pa.binary()),
                ],
                ["id", "leaf", "way", "unit"],
            )

    placed = materialize(
        vectors.mapInArrow(place, "id long, leaf int, way long, unit binary"), "placed"
    )
    # groups of equal directions with more members than any answer can use
    crowds = (
        placed.groupBy("way")
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > k + 1)
        .select("way")
    )
    crowds = materialize(crowds, "crowds")
    if crowds.isEmpty():
        searched, crowd_answers = placed, None
    else:
        first = Window.partitionBy("way").orderBy("id")
        heads = (
            placed.join(crowds, "way", "left_semi")
            .select("way", "id")
            .groupBy("way", "id")
            .agg(F.lit(1).alias("one"))
            .withColumn("r", F.row_number().over(first))
            .where(F.col("r") <= k + 1)
            .groupBy("way")
            .agg(F.sort_array(F.collect_list("id")).alias("heads"))
        )
        heads = materialize(heads, "heads")
        marked = placed.join(heads, "way", "left")
        searched = marked.where("heads is null or array_contains(heads, id)").select(*placed.columns)
        crowd_answers = (
            marked.where("heads is not null and not array_contains(heads, id)")
            .select("id", F.explode(F.slice("heads", 1, k)).alias("neighbour"))
            .distinct()
            .select("id", "neighbour", F.lit(1.0).alias("sim"))
        )
    sizes = {r["leaf"]: r["n"] for r in searched.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    blocks, first_block, n_blocks = _pack(len(tree.node_of), sizes)
    parts = _parts(tree, sample, rate, blocks, first_block, n_blocks)
    held = np.array([sizes.get(i, 0) for i in range(len(tree.node_of))])
    bb = spark.sparkContext.broadcast((first_block, n_blocks, parts, held))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (first_block, n_blocks, parts, held) = bc.value, bb.value
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                piece = batch.slice(i, PIECE)
                ids, leaf = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                v = np.frombuffer(b"".join(piece.column(3).to_pylist()), np.float32).reshape(-1, dim)
                row, at = tree.visits_enough(v, held, 2 * (k + 1))  # rows may be sent twice
                # queries: one row per block they visit, with the leaves wanted there
                times = n_blocks[at]
                row, at = np.repeat(row, times), np.repeat(at, times)
                block = first_block[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((at, block, row))
                row, at, block = row[order], at[order], block[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
                begin = np.flatnonzero(new)
                q_row, q_block = row[begin], block[begin]
                q_part = (ids[q_row] // 7) % parts[q_block]
                # points: one row per copy of their block
                own = first_block[leaf] + ids % n_blocks[leaf]
                p_row = np.repeat(np.arange(len(ids)), parts[own])
                p_block = own[p_row]
                p_part = np.arange(len(p_row)) - np.repeat(np.cumsum(parts[own]) - parts[own], parts[own])
                wanted = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(p_row) + 1, np.int32)), pa.array([], pa.int32()))
                both = np.concatenate([q_row, p_row])
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([q_block, p_block]).astype(np.int32)),
                        pa.array(np.concatenate([q_part, p_part]).astype(np.int32)),
                        pa.array(ids[both]),
                        pa.array(np.concatenate([np.full(len(q_row), -1), leaf[p_row]]).astype(np.int32)),
                        pa.concat_arrays([wanted, none]),
                        piece.column(3).take(pa.array(both)),
                    ],
                    ["block", "part", "id", "leaf", "wanted", "unit"],
                )

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, leaf = table.column("id").to_numpy(), table.column("leaf").to_numpy()
        v = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(-1, dim)
        lists = table.column("wanted").combine_chunks()
        many = lists.value_lengths().to_numpy()
        asker, asked = np.repeat(np.arange(len(ids)), many), lists.flatten().to_numpy()
        points, queries = np.flatnonzero(leaf >= 0), np.flatnonzero(leaf < 0)
        points = points[np.unique(ids[points], return_index=True)[1]]
        number = np.full(len(ids), -1)  # rows sent twice ask once
        queries = queries[np.unique(ids[queries], return_index=True)[1]]
        number[queries] = np.arange(len(queries))
        asked, asker = asked[number[asker] >= 0], number[asker[number[asker] >= 0]]
        best_sim = np.full((len(queries), k + 1), -2.0, np.float64)
        best_id = np.full((len(queries), k + 1), np.iinfo(np.int64).max)

        def compare(who: np.ndarray, own: np.ndarray) -> None:
            """Queries ``who`` against points ``own``."""
            for s in range(0, len(own), 4096):
                mine = own[s : s + 4096]
                for t in range(0, len(who), 512):
                    ask = who[t : t + 512]
                    sim = v[queries[ask]] @ v[mine].T
                    m = min(k + 3, sim.shape[1])
                    part = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    # the few finalists again in double precision
                    exact = np.einsum("qd,qmd->qm", v[queries[ask]].astype(np.float64), v[mine][part].astype(np.float64))
                    cand_sim = np.hstack([best_sim[ask], exact.round(ROUND)])
                    cand_id = np.hstack([best_id[ask], ids[mine][part]])
                    cand_sim[cand_id == ids[queries[ask]][:, None]] = -2.0
                    order = np.lexsort((cand_id, -cand_sim), axis=1)[:, : k + 1]
                    best_sim[ask] = np.take_along_axis(cand_sim, order, 1)
                    best_id[ask] = np.take_along_axis(cand_id, order, 1)

        order = np.argsort(asked, kind="stable")
        asker, asked = asker[order], asked[order]
        points = points[np.argsort(leaf[points], kind="stable")]
        for b in np.unique(leaf[points]):
            own = points[np.searchsorted(leaf[points], b, "left") : np.searchsorted(leaf[points], b, "right")]
            who = asker[np.searchsorted(asked, b, "left") : np.searchsorted(asked, b, "right")]
            if len(own) <= large or not len(who):
                compare(who, own)
                continue
            sub = _subtree(v[own], k, recall)
            home = sub.home(v[own])
            row, at = sub.visits_enough(v[queries[who]], np.bincount(home, minlength=len(sub.node_of)), k + 1)
            for c in np.unique(at):
                compare(who[row[at == c]], own[home == c])
        row, col = np.nonzero(best_sim[:, :k] > -2)
        return pa.table(
            {
                "id": pa.array(ids[queries][row]),
                "neighbour": pa.array(best_id[row, col]),
                "sim": pa.array(best_sim[row, col]),
            }
        )

    large = LARGE_LEAF
    routed = searched.mapInArrow(route, "block int, part int, id long, leaf int, wanted array<int>, unit binary")
    partial = routed.groupBy("block", "part").applyInArrow(search, "id long, neighbour long, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    answers = (
        partial.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    )
    return answers.unionByName(crowd_answers) if crowd_answers is not None else answers


def _pack(leaves: int, sizes: dict[int, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of blocks, and per leaf its first block and how many it has; leaves side by side share blocks of about BLOCK_ROWS."""
    n = np.array([sizes.get(i, 0) for i in range(leaves)])
    first, count = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    block, filled = 0, 0
    for i in range(leaves):
        if n[i] > BLOCK_ROWS:
            block += filled > 0
            count[i] = -(-n[i] // BLOCK_ROWS)
            first[i] = block
            block, filled = block + count[i], 0
            continue
        if filled and filled + n[i] > BLOCK_ROWS:
            block, filled = block + 1, 0
        first[i] = block
        filled += n[i]
    return int(block) + 1, first, count


def _parts(tree: Tree, sample: np.ndarray, rate: float, blocks: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Copies of each block, by the queries it should get: those of part of the sample, carried on to all rows."""
    some = sample[:: max(1, len(sample) // 4096)]
    row, leaf = tree.visits(some)
    times = count[leaf]
    row = np.repeat(row, times)
    block = np.repeat(first[leaf], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    asks = np.bincount(np.unique(np.stack([row, block]), axis=1)[1], minlength=blocks) if len(row) else np.zeros(blocks)
    return np.maximum(1, np.ceil(asks * len(sample) / max(len(some), 1) / rate / BLOCK_ASKS)).astype(np.int64)


def _subtree(x: np.ndarray, k: int, recall: float) -> Tree:
    """A tree within a large leaf, with margins calibrated on the leaf's own points."""
    tree = Tree(x, LEAF_ROWS)
    pick = np.random.default_rng(5).choice(len(x), min(64, len(x)), replace=False)
    sim = x[pick] @ x.T
    sim[np.arange(len(pick)), pick] = -2
    m = min(k, len(x) - 1)
    top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
    tree.calibrate(x[pick], x[top.ravel()], np.repeat(np.arange(len(pick)), m), 1 - (1 - recall) / 2)
    return tree
