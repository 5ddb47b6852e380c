"""Most similar vectors for every vector: a small-world graph per shard, shard results merged.

1. Exact copies of a vector are one node (by a 128-bit hash), so a vector that a third
   of all rows repeat is indexed once; the copies come back when results are merged.
2. Each node goes to the shards of its nearest pivots: the first and those within a
   margin of it, ``SHARDS_AT_MOST`` at most.  Pivots are a sample of the vectors, one for
   every so many, so shards keep their size however many vectors there are, and a dense
   region gets pivots in proportion.  Many pivots are searched through a tree of pivots.
3. Each shard builds one graph (``memlake.llm.hnsw``) and is then asked for every node
   in it; what insertion saw is added, and the k best of a node kept.
4. The directed results of all shards are merged, ranked and cut to the k best.

Every usable vector is indexed and asked.  The margin, the beam and the number of
links set the accuracy; tests measure recall against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.hnsw import Graph

#: Rows aimed at in a shard (with ``COPIES`` shards a vector), and the bounds of the sample that gives the pivots: with the
#: most, shards keep their size up to 220 million vectors a kind and grow in proportion beyond (23,000 rows at a billion).
SHARD_ROWS, COPIES, PIVOTS_AT_LEAST, PIVOTS_AT_MOST = 5000, 3, 16, 1 << 17
#: A kind with fewer vectors is one shard.
ONE_SHARD = 3000
#: A vector also joins shards whose pivot is nearly as similar as its best: within MARGIN / sqrt(dimension).
MARGIN, SHARDS_AT_MOST = 0.8, 4
#: More pivots than this are searched from above: each node of the tree has about FANOUT below it, WAYS are followed.
FLAT, FANOUT, WAYS = 1024, 64, 40
LINKS, BEAM = 8, 16
#: Beams with which the finished graph is asked, so many rows at a time: the next is for nodes whose wanted ones fill half of
#: the one before.
ASK, ASK_ROWS = (20, 64, 256), 512
#: Vectors travel as 16-bit fixed point; this shifts a similarity by about 0.00001.
GRAIN = 32767
#: Exact search: a task holds at most so many vectors and so many asking ones, and multiplies them in tiles;
#: a kind that one task could hold is still cut into BLOCKS, to use more cores.
BLOCK_ROWS, ASKED_ROWS, TILE, BLOCKS = 200_000, 100_000, 2048, 16


def usable(signatures: DataFrame) -> DataFrame:
    """(sig_id, space, vid, vec) of the rows that take part; copies of a vector share ``vid``.

    A row takes part if it has id, kind and dim, and its vector has that length, a
    value other than zero and no null, NaN or infinite one.
    """
    vec = F.col("vec")
    finite = (F.array_max(vec) < float("inf")) & (F.array_min(vec) > float("-inf"))
    good = (F.size(vec) == F.col("dim")) & ~F.array_contains(vec, F.lit(float("nan")).cast("float")) & finite
    some = (F.array_max(vec) != 0) | (F.array_min(vec) != 0)
    return signatures.where(
        F.col("sig_id").isNotNull() & F.col("kind").isNotNull() & (F.col("dim") > 0) & good & some
    ).select(
        F.col("sig_id").cast("string").alias("sig_id"),
        F.concat_ws("/", "kind", F.col("dim").cast("string")).alias("space"),
        F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("vec"), F.xxhash64(F.lit(7), "vec"))))).alias("vid"),
        "vec",
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return (flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]).astype(np.float32)


def pivots_of(count: int) -> int:
    return max(PIVOTS_AT_LEAST, min(PIVOTS_AT_MOST, -(-COPIES * count // SHARD_ROWS))) if count >= ONE_SHARD else 1


class Pivots:
    """The pivots nearest to vectors; many are searched through a smaller set of them, which knows which are near."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.above = self.below = None
        if len(x) > FLAT:
            self.above = Pivots(x[: -(-len(x) // FANOUT)])
            _, owner, _ = self.above.near(x, 1)
            order = np.argsort(owner, kind="stable")
            self.below = np.split(order, np.searchsorted(owner[order], np.arange(1, len(self.above.x))))

    def near(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, pivot, similarity) of up to the ``k`` nearest pivots of each query, ordered by query."""
        if self.above is None:
            sims = q @ self.x.T
            k = min(k, sims.shape[1])
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            return np.repeat(np.arange(len(q)), k), top.ravel(), np.take_along_axis(sims, top, 1).ravel()
        rows, ways, _ = self.above.near(q, WAYS)
        order = np.argsort(ways, kind="stable")
        starts = np.flatnonzero(np.r_[True, ways[order][1:] != ways[order][:-1]])
        found = []
        for at in np.split(order, starts[1:]):
            below = self.below[ways[at[0]]]
            if len(below):
                sims = q[rows[at]] @ self.x[below].T
                n = min(k, len(below))
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                found.append((np.repeat(rows[at], n), below[top].ravel(), np.take_along_axis(sims, top, 1).ravel()))
        r, p, s = (np.concatenate(f) for f in zip(*found))
        order = np.lexsort((p, -s, r))
        r, p, s = r[order], p[order], s[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[best], p[best], s[best]


class Routing:
    """The shards of one space: one a pivot."""

    def __init__(self, count: int, sample: np.ndarray):
        sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])] if len(sample) else sample
        self.pivots = Pivots(sample[: pivots_of(count)])

    def shards(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) pairs, at most ``SHARDS_AT_MOST`` a row."""
        if len(self.pivots.x) < 2:
            return np.arange(len(x)), np.zeros(len(x), int)
        r, shard, value = self.pivots.near(x, SHARDS_AT_MOST)
        best = np.full(len(x), -2.0, np.float32)
        np.maximum.at(best, r, value)
        near = value >= best[r] - MARGIN / math.sqrt(x.shape[1])
        return r[near], shard[near]


def plan_routing(signatures: DataFrame) -> dict[str, Routing]:
    """The routing of each space, from row counts and a bounded sample by hash of the id."""
    space = F.concat_ws("/", "kind", F.col("dim").cast("string"))
    known = signatures.where("kind IS NOT NULL AND dim > 0 AND sig_id IS NOT NULL")
    counts = {r["space"]: r["n"] for r in known.groupBy(space.alias("space")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # some more than needed, as the draw is by hash and copies and unusable vectors drop out
    wanted = {s: pivots_of(n) * 1.25 + 64 for s, n in counts.items() if n >= ONE_SHARD}
    out = {s: Routing(n, np.zeros((0, 1), np.float32)) for s, n in counts.items()}
    if wanted:
        grain = 1 << 30
        limit = F.lit(0)
        for s, n in wanted.items():
            limit = F.when(space == s, F.lit(int(min(1.0, n / counts[s]) * grain))).otherwise(limit)
        drawn = usable(known.where(F.pmod(F.xxhash64("sig_id"), F.lit(grain)) < limit))
        table = drawn.select("space", "vid", "vec").toArrow().combine_chunks()
        for s in wanted:
            own = table.filter(pc.equal(table["space"], s)).sort_by("vid")
            if len(own):
                out[s] = Routing(counts[s], _matrix(own["vec"].combine_chunks()))
    return out


def _route(routing: dict[str, Routing]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for b in batches:
            spaces, vids = b.column("space").to_pylist(), b.column("vid").to_pylist()
            by: dict[str, list[int]] = {}
            for i, key in enumerate(zip(spaces, vids)):
                if key not in seen:
                    seen.add(key)
                    by.setdefault(key[0], []).append(i)
            for space, rows in by.items():
                at = pa.array(rows)
                x = _matrix(b.column("vec").take(at))
                r, shard = routing[space].shards(x)
                size = x.shape[1] * 2
                raw = np.rint(x * GRAIN).astype(np.int16).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([space] * len(r), pa.string()),
                        pa.array(shard.astype(np.int64)),
                        b.column("vid").take(at).take(pa.array(r)),
                        pa.array([raw[i * size : (i + 1) * size] for i in r.tolist()], pa.binary()),
                    ],
                    ["space", "shard", "vid", "unit"],
                )

    return run


def _ask(graph: Graph, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, row, similarity) found in the finished graph from each row, with a wide beam where many are wanted."""
    rows = np.arange(len(graph.x))
    for ef in ASK:
        again = []
        for i in range(0, len(rows), ASK_ROWS):
            start = rows[i : i + ASK_ROWS]
            ids, sims = graph.search(graph.x[start], ef, start)
            wanted = (sims >= least) & (ids >= 0)
            crowded = (wanted.sum(1) * 2 >= ef) & (ef != ASK[-1])
            r, c = np.nonzero(wanted & ~crowded[:, None])
            yield graph.order[start[r]], ids[r, c], sims[r, c]
            again.append(start[crowded])
        rows = np.concatenate(again) if again else rows


def _keep(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs in both directions, each once, the ``k`` best of every first one."""
    a, b, s = np.r_[a, b], np.r_[b, a], np.r_[s, s]
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)] & (a != b)
    a, b, s = a[once], b[once], s[once]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    near = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[near], b[near], s[near]


def _search(least: float, k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        seen: set[bytes] = set()
        rows = [i for i, v in enumerate(table["vid"].to_pylist()) if not (v in seen or seen.add(v))]
        table = table.take(pa.array(rows)).sort_by("vid")
        raw = b"".join(table["unit"].to_pylist())
        x = np.frombuffer(raw, np.int16).reshape(len(table), -1).astype(np.float32)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        graph = Graph(x, m=LINKS, ef=BEAM)
        found = list(graph.insert_all(least))
        found += _ask(graph, least)
        a, b, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((int, int, np.float32)))
        a, b, s = _keep(a, b, s, k)
        vid, space = table["vid"].combine_chunks(), table["space"][0].as_py()
        return pa.table(
            {
                "space": pa.array([space] * len(a), pa.string()),
                "a": vid.take(pa.array(a)),
                "b": vid.take(pa.array(b)),
                "similarity": pa.array(s.astype(np.float32)),
            }
        )

    return run


def similar_nodes(signatures: DataFrame, vectors: DataFrame, floor: float, k: int) -> DataFrame:
    """(space, a, b, similarity) of different vectors at least ``floor`` alike, for each ``a`` the ``k`` best of each of its shards."""
    routing = plan_routing(signatures)
    if not routing:
        return vectors.sparkSession.createDataFrame([], "space string, a binary, b binary, similarity float")
    routed = vectors.select("space", "vid", "vec").mapInArrow(
        _route(routing), "space string, shard bigint, vid binary, unit binary"
    )
    found = routed.groupBy("space", "shard").applyInArrow(
        _search(floor, k), "space string, a binary, b binary, similarity float"
    )
    return found.groupBy("space", "a", "b").agg(F.max("similarity").alias("similarity"))


def _members(vectors: DataFrame) -> DataFrame:
    """(sig_id, space, vid): the one vector of each signature."""
    return vectors.groupBy("sig_id").agg(F.min(F.struct("space", "vid")).alias("m")).select("sig_id", "m.*")


def _ranked(near: DataFrame, members: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Pairs of nodes as pairs of signatures, the copies of a vector among them, cut to the ``k`` best of each asking one."""
    best = Window.partitionBy("space", "a").orderBy(F.desc("similarity"), "b")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    within = Window.partitionBy("space", "vid").orderBy("sig_id")
    targets = members.withColumn("r", F.row_number().over(within)).where(F.col("r") <= k + 1)
    copies = targets.where("r = 2").select(
        "space", F.col("vid").alias("a"), F.col("vid").alias("b"), F.lit(1.0).cast("float").alias("similarity")
    )
    ends = targets.select("space", F.col("vid").alias("b"), F.col("sig_id").alias("neighbour"))
    starts = asking.select("space", F.col("vid").alias("a"), "sig_id")
    pairs = (
        near.unionByName(copies)
        .join(ends, ["space", "b"])
        .join(starts, ["space", "a"])
        .where(F.col("sig_id") != F.col("neighbour"))
    )
    rank = Window.partitionBy("sig_id").orderBy(F.desc("similarity"), "neighbour")
    return (
        pairs.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("sig_id", "neighbour", "similarity", "rank")
    )


def nearest(signatures: DataFrame, k: int = 10, floor: float = -1.0) -> DataFrame:
    """(sig_id, neighbour, similarity, rank): for each signature up to ``k`` most similar of its kind, at least ``floor`` alike.

    Ties go to the smaller id.  A signature delivered twice is one.  Copies of a vector
    are neighbours of each other with similarity 1; a class of copies is never paired
    out: of each class only the ``k + 1`` smallest ids can be anyone's neighbour.
    Empty or unusable input gives no rows.  Shards hold what is much alike: neighbours
    that resemble a vector little are mostly missed (see ``nearest_of``).
    """
    vectors = usable(signatures)
    members = _members(vectors)
    near = similar_nodes(signatures, vectors, floor, k).where(F.col("similarity") >= floor)
    return _ranked(near, members, members, k)


def _best(k: int):
    """The ``k`` best nodes of a block for each node that asks, by matrix products."""

    def nodes(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        table = table.combine_chunks()
        seen: set[bytes] = set()
        rows = [i for i, v in enumerate(table["vid"].to_pylist()) if not (v in seen or seen.add(v))]
        vid = table["vid"].combine_chunks().take(pa.array(rows, pa.int64()))
        if not rows:
            return vid, np.zeros((0, 1), np.float32)
        unit = table["unit"].combine_chunks().take(pa.array(rows, pa.int64()))
        return vid, np.frombuffer(b"".join(unit.to_pylist()), np.float32).reshape(len(rows), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (ask_vid, asks), (vid, x) = nodes(left), nodes(right)
        place = {v: i for i, v in enumerate(vid.to_pylist())}
        own = np.array([place.get(v, -1) for v in ask_vid.to_pylist()], np.int64)
        a, b, s = [], [], []
        for i in range(0, len(asks) if len(x) else 0, TILE):
            q, me = asks[i : i + TILE], own[i : i + TILE]
            ids, sims = np.full((len(q), 0), -1, np.int64), np.zeros((len(q), 0), np.float32)
            for j in range(0, len(x), TILE):
                value = q @ x[j : j + TILE].T
                r = np.flatnonzero((me >= j) & (me < j + TILE))
                value[r, me[r] - j] = -2.0
                n = min(k, value.shape[1])
                top = np.argpartition(-value, n - 1, axis=1)[:, :n]
                ids, sims = np.concatenate([ids, top + j], 1), np.concatenate([sims, np.take_along_axis(value, top, 1)], 1)
                n = min(k, ids.shape[1])
                keep = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                ids, sims = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)
            r, c = np.nonzero(sims > -1.5)
            a.append(r + i), b.append(ids[r, c]), s.append(sims[r, c])
        a, b, s = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((a, np.int64), (b, np.int64), (s, np.float32)))
        space = left["space"][0].as_py() if len(left) else None
        return pa.table(
            {
                "space": pa.array([space] * len(a), pa.string()),
                "a": ask_vid.take(pa.array(a)),
                "b": vid.take(pa.array(b)),
                "similarity": pa.array(s.astype(np.float32)),
            }
        )

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spaces = b.column("space").to_pylist()
        by: dict[str, list[int]] = {}
        for i, space in enumerate(spaces):
            by.setdefault(space, []).append(i)
        for space, rows in by.items():
            at = pa.array(rows)
            x = _matrix(b.column("vec").take(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([space] * len(rows), pa.string()), b.column("vid").take(at), pa.array([v.tobytes() for v in x], pa.binary())],
                ["space", "vid", "unit"],
            )


def nearest_of(signatures: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """``nearest`` of the signatures for which ``asked`` holds (of sig_id), among all rows of their kind, however little alike.

    Exact: every asking vector meets every vector of its kind, in blocks.  Vectors
    without close neighbours have theirs in all directions, where no shard leads.
    The work is the product of both numbers, so it grows with the square of the table.
    """
    vectors = usable(signatures)
    members = _members(vectors)
    counts = vectors.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).collect()
    plan = {r["space"]: (max(-(-r["n"] // BLOCK_ROWS), min(BLOCKS, -(-r["n"] // 2000))), max(1, -(-r["q"] // ASKED_ROWS))) for r in counts}
    blocks, parts = F.lit(1), F.lit(1)
    for space, (n, q) in plan.items():
        blocks = F.when(F.col("space") == space, F.lit(n)).otherwise(blocks)
        parts = F.when(F.col("space") == space, F.lit(q)).otherwise(parts)
    units, form = (lambda rows: rows.select("space", "vid", "vec").mapInArrow(_units, "space string, vid binary, unit binary")), ["space", "vid", "unit"]
    block, part = F.pmod(F.xxhash64("vid"), blocks).cast("int"), F.pmod(F.xxhash64(F.lit(5), "vid"), parts).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    asks = units(vectors.where(asked)).select(*form, part.alias("part"), every(blocks).alias("block"))
    shown = units(vectors).select(*form, block.alias("block"), every(parts).alias("part"))
    key = ["space", "block", "part"]
    near = asks.groupBy(*key).cogroup(shown.groupBy(*key)).applyInArrow(_best(k), "space string, a binary, b binary, similarity float")
    return _ranked(near, members, members.where(asked), k)


def similar_pairs(signatures: DataFrame, k: int = 10, floor: float = 0.8) -> DataFrame:
    """(sig_id_a, sig_id_b): pairs of which at least one is among the other's ``k`` nearest, smaller id first."""
    return (
        nearest(signatures, k, floor)
        .select(F.least("sig_id", "neighbour").alias("sig_id_a"), F.greatest("sig_id", "neighbour").alias("sig_id_b"))
        .distinct()
    )
