"""Near-duplicate embeddings by cross-polytope hashing: links at a least cosine, and the classes they form.

Only vectors of one label and one length are compared. Equal vectors are one entry with a count. Then

1. Balls. The entries that share an own key look at one leader; those within half the link's angle
   of it are its ball. Any two of a ball are linked, by the triangle inequality of angles, so a group
   of near copies of any size is settled by aggregations. The first round has fine keys and leaders
   with the smallest number; the next ones have coarse keys and the leader whose ball is largest
   there, so the balls of one tight group flow together.
2. Buckets. Every entry files its probe keys. Buckets whose entries are all of one ball are dropped.
   In the others entries of different balls are compared in tiles of bounded size: a ball that fills
   more than a tile has blocks of its own, which are not compared with each other.
3. Tiles verify by cosine in double precision. A pair that meets in several buckets is counted in the
   one with the smallest key, so counts need no list of pairs: a task gives back sums per entry and
   a spanning forest of the balls it linked.

Two loose clusters of m entries each, not balls, cost m * m comparisons, as exact counts must; they
are spread over (m / TILE)^2 tiles.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label or null vec_id, link with nothing and are classes of their own. Every row is a
vector: rows that repeat a vec_id count apart, and each gets a row. ``kept`` is vec_id = component_id
(true for a null vec_id).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotweave.llm.common import lookup, signed, written
from lotweave.llm.components import components
from lotweave.llm.cross_polytope import Hasher

#: Hash functions a key, tables, and keys a vector files in a table. A pair at a cosine of 0.93 in 64
#: dimensions shares a key of a table with a probability of 0.83, of one of three with 0.995.
FUNCTIONS, TABLES, PROBES = 3, 3, 8
#: Entries of one block of a bucket; a task compares two blocks at a time.
TILE = 2048
#: (hash functions, table) of the own keys of each round of balls.
ROUNDS = ((FUNCTIONS, 0), (1, 0), (1, 1), (1, 2))
#: Keeps the ball's bound safe from rounding.
MARGIN = 1e-9


def _units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in doubles) for each vector length of the batch."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        vectors = flat[starts[rows][:, None] + np.arange(d)]
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        out.append((rows, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)))
    return out


class _Keys:
    """Keys of a label's vectors, with one hasher per vector length."""

    def __init__(self, shape: tuple[int, int, int]):
        self.shape, self.hashers = shape, {}

    def __call__(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        d = unit.shape[1]
        if d not in self.hashers:
            self.hashers[d] = Hasher(d, *self.shape)
        keys = self.hashers[d].keys(unit)
        return signed((keys ^ label.view(np.uint64)[:, None, None]) * np.uint64(0xD6E8FEB86659FD93))


def entries(vectors: DataFrame) -> DataFrame:
    """Rows that can link: vec_id, label (hashed), two hashes of the vector, and the vector."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("embedding", lambda c: c != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))
    one, two = F.xxhash64(F.lit(1), F.size("embedding"), "embedding"), F.xxhash64(F.lit(2), F.size("embedding"), "embedding")
    return vectors.select(F.col("vec_id").cast("bigint"), F.xxhash64(F.col("label").cast("string")).alias("lab"), F.when(usable, one).alias("h1"),
                          F.when(usable, two).alias("h2"), F.when(usable, F.col("embedding")).alias("embedding"))


PLACED = "node bigint, id bigint, lab bigint, copies bigint, embedding {}, ball bigint"


def _own_keys(functions: int, table: int):
    """Placed entries with their own key of a table."""
    def run(batches):
        keys = _Keys((functions, table + 1, 1))
        for batch in batches:
            home = np.zeros(batch.num_rows, np.int64)
            label = batch.column(2).to_numpy()
            for rows, unit in _units(batch.column(4)):
                home[rows] = keys(unit, label[rows])[:, table, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "home"])

    return run


def _in_ball(cosine: float):
    """Entries with a leader's vector: in its ball if the angle is at most half the link's, else where they were."""
    least = math.cos(math.acos(cosine) / 2) + MARGIN

    def run(batches):
        for batch in batches:
            leader, ball = batch.column(6).to_numpy(), batch.column(5).to_numpy().copy()
            own, other = batch.column(4), batch.column(7)
            same = np.diff(own.offsets.to_numpy()) == np.diff(other.offsets.to_numpy())
            for rows, unit in _units(own):
                rows_same = same[rows]
                if not rows_same.any():
                    continue
                rows, unit = rows[rows_same], unit[rows_same]
                lead = _units(other.take(pa.array(rows)))[0][1]
                near = np.einsum("ij,ij->i", unit, lead) >= least
                ball[rows[near]] = leader[rows[near]]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(ball)], names=["node", "id", "lab", "copies", "embedding", "ball"])

    return run


def balls(distinct: DataFrame, cosine: float, total: int) -> DataFrame:
    """node, id, lab, copies, embedding, ball (its leader's node) for every distinct vector."""
    form = PLACED.format(_kind(distinct))
    placed = distinct.select("node", "id", "lab", "copies", "embedding", F.col("node").alias("ball"))
    for functions, table in ROUNDS:
        homes = written(placed.mapInArrow(_own_keys(functions, table), form + ", home bigint"), "homes")
        held = homes.groupBy("lab", "home", "ball").agg(F.count(F.lit(1)).alias("held"))
        leaders = held.groupBy("lab", "home").agg(F.max_by("ball", F.struct("held", -F.col("ball"))).alias("leader"), F.sum("held").alias("size"))
        leaders = leaders.join(homes.select(F.col("node").alias("leader"), F.col("embedding").alias("lead")), "leader")
        met = lookup(homes, leaders, ["lab", "home"], ["leader", "lead"], "size", total)
        placed = met.select("node", "id", "lab", "copies", "embedding", "ball", "leader", "lead").mapInArrow(_in_ball(cosine), form)
    return placed


def _kind(df: DataFrame) -> str:
    return df.schema["embedding"].dataType.simpleString()


def _filed(shape):
    def run(batches):
        keys = _Keys(shape)
        for batch in batches:
            label, node, ball = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for rows, unit in _units(batch.column(3)):
                for at in range(0, len(rows), 2048):
                    some = rows[at:at + 2048]
                    code = keys(unit[at:at + 2048], label[some]).reshape(len(some), -1)
                    per = code.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), *[pa.array(np.repeat(c[some], per)) for c in (label, node, ball)]],
                                                     names=["key", "lab", "node", "ball"])

    return run


def tiles(placed: DataFrame, shape: tuple[int, int, int], total: int, tile: int) -> DataFrame:
    """(key, lab, i, j, block, node) for entries of buckets with more than one ball."""
    filed = placed.select("lab", "node", "ball", "embedding").mapInArrow(_filed(shape), "key bigint, lab bigint, node bigint, ball bigint")
    filed = written(filed, "filed")
    rows = total * shape[1] * shape[2]
    held = filed.groupBy("key", "lab", "ball").agg(F.count(F.lit(1)).alias("held"))
    small = F.when(F.col("held") <= tile, F.col("held")).otherwise(0)
    wide = F.when(F.col("held") > tile, F.ceil(F.col("held") / tile)).otherwise(0)
    buckets = held.groupBy("key", "lab").agg(F.count(F.lit(1)).alias("balls"), F.ceil(F.sum(small) / tile).cast("bigint").alias("shared"),
                                             F.sum(wide).cast("bigint").alias("own"), F.sum("held").alias("size")).filter("balls > 1")
    live = written(lookup(held, buckets, ["key", "lab"], ["shared", "own"], "size", rows), "live")
    # blocks of a ball that fills more than a tile: numbered behind the shared ones; there is one such row per tile of rows at most
    big = live.filter(F.col("held") > tile).withColumn("width", F.ceil(F.col("held") / tile).cast("bigint"))
    before = F.sum("width").over(Window.partitionBy("key", "lab").orderBy("ball").rowsBetween(Window.unboundedPreceding, -1))
    big = big.withColumn("first", F.col("shared") + F.coalesce(before, F.lit(0)))
    rest = live.filter(F.col("held") <= tile).withColumn("width", F.col("shared")).withColumn("first", F.lit(0).cast("bigint"))
    plan = rest.unionByName(big.select(*rest.columns)).withColumn("blocks", F.col("shared") + F.col("own"))
    at = lookup(filed, plan, ["key", "lab", "ball"], ["held", "width", "first", "blocks"], "held", rows)
    at = at.withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("width")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    apart = F.filter(every, lambda b: (F.col("held") <= tile) | (b < F.col("first")) | (b >= F.col("first") + F.col("width")))
    at = at.withColumn("other", F.explode(apart))
    return at.select("key", "lab", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, smallest of x's component) of the graph of ``a`` and ``b``."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


class _Tile:
    """Verified links among the rows of tiles that came sorted by (key, lab, i, j)."""

    def __init__(self, cosine: float, shape: tuple[int, int, int]):
        self.cosine, self.keys = cosine, _Keys(shape)

    def links(self, t, x, y) -> tuple[np.ndarray, np.ndarray]:
        """Of row pairs, those linked that are counted here: no smaller key is shared."""
        ok = (t["ball"][x] != t["ball"][y]) & (t["lab"][x] == t["lab"][y])
        x, y = x[ok], y[ok]
        if not len(x):
            return x, y
        used, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        code = self.keys(t["unit"][used], t["lab"][used])
        keep = np.zeros(len(x), bool)
        for first in range(0, len(x), 4096):
            part = slice(first, first + 4096)
            one, two = code[at[:len(x)][part]], code[at[len(x):][part]]
            shared = one[:, :, :, None] == two[:, :, None, :]
            least = np.where(shared, one[:, :, :, None], np.iinfo(np.int64).max).min(axis=(1, 2, 3))
            keep[part] = least == t["key"][x[part]]
        return x[keep], y[keep]

    def small(self, t, group, most):
        """Links of all groups of at most ``most`` rows, by distance between rows."""
        n = len(group)
        for k in range(1, most):
            x = np.flatnonzero(group[k:] == group[:n - k])
            if not len(x):
                return
            near = np.einsum("ij,ij->i", t["unit"][x], t["unit"][x + k]) >= self.cosine
            yield self.links(t, x[near], x[near] + k)

    def large(self, t, first, end):
        """Links of one group, by blocks of a matrix product."""
        i, j = t["i"][first], t["j"][first]
        own = np.arange(first, end)
        left, right = (own, own) if i == j else (own[t["block"][own] == i], own[t["block"][own] == j])
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            near = t["unit"][some] @ t["unit"][right].T >= self.cosine
            a, b = np.nonzero(near)
            a, b = some[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            yield self.links(t, a, b)

    def compare(self, t):
        """(node, links) sums and (ball, ball) edges of whole tiles."""
        n = len(t["key"])
        new = np.concatenate(([True], np.any([t[c][1:] != t[c][:-1] for c in ("key", "lab", "i", "j")], axis=0)))
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        few = (sizes[group] <= 16) & (t["i"] == t["j"])
        found = []
        if few.any():
            rows = np.flatnonzero(few)
            sub = {c: v[rows] for c, v in t.items()}
            found += [(rows[x], rows[y]) for x, y in self.small(sub, group[rows], 16)]
        starts = np.flatnonzero(new)
        for g in np.flatnonzero((sizes > 16) | (t["i"][starts] != t["j"][starts])):
            found += self.large(t, starts[g], starts[g] + sizes[g])
        x = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
        y = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
        if not len(x):
            return None
        links = np.bincount(x, t["copies"][y], n) + np.bincount(y, t["copies"][x], n)
        some = np.flatnonzero(links)
        a, b = _forest(t["ball"][x], t["ball"][y])
        nodes = np.concatenate((t["node"][some], np.zeros(len(a), np.int64)))
        counts = np.concatenate((links[some].astype(np.int64), np.zeros(len(a), np.int64)))
        pad = np.zeros(len(some), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts), pa.array(np.concatenate((pad, a))), pa.array(np.concatenate((pad, b)))],
                                          names=["node", "links", "a", "b"])


def _verified(cosine: float, shape):
    def run(batches):
        tile, held = _Tile(cosine, shape), None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            key = [held.column(c).to_numpy() for c in range(4)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
            if len(ends):  # the last tile may go on in the next batch
                yield from _tile_rows(tile, held.slice(0, ends[-1]))
                held = held.slice(ends[-1])
        if held is not None:
            yield from _tile_rows(tile, held)

    return run


def _tile_rows(tile: _Tile, batch: pa.RecordBatch):
    names = ("key", "lab", "i", "j", "block", "node", "ball", "copies")
    columns = {c: batch.column(k).to_numpy() for k, c in enumerate(names)}
    for rows, unit in _units(batch.column(8)):  # keys of different vector lengths differ
        out = tile.compare({**{c: v[rows] for c, v in columns.items()}, "unit": unit})
        if out is not None:
            yield out


def near_classes(vectors: DataFrame, cosine: float = 0.93, functions: int = FUNCTIONS, tables: int = TABLES, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    shape = (functions, tables, probes)
    rows = entries(vectors)
    groups = rows.filter("h1 is not null").groupBy("lab", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    distinct = written(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = distinct.count()
    placed = written(balls(distinct, cosine, total), "balls")
    cut = tiles(placed, shape, total, tile).join(placed.select("node", "ball", "copies", "embedding"), "node")
    cut = cut.select("key", "lab", "i", "j", "block", "node", "ball", "copies", "embedding").repartition("key", "lab", "i", "j").sortWithinPartitions("key", "lab", "i", "j")
    found = written(cut.mapInArrow(_verified(cosine, shape), "node bigint, links bigint, a bigint, b bigint"), "links")
    beside = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    of = components(found.filter("a <> b").select("a", "b"))
    inside = placed.groupBy("ball").agg(F.sum("copies").alias("weight"), F.min("id").alias("least"), F.count(F.lit(1)).alias("members"))
    inside = inside.join(of.withColumnRenamed("id", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    inside = written(inside, "ball-classes")
    least = inside.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    inside = lookup(inside, least, ["component"], ["component_id"], "size", max(1, inside.count()))
    nodes = lookup(placed.select("node", "ball"), inside, ["ball"], ["weight", "component_id"], "members", total)
    nodes = nodes.join(beside, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    known = distinct.select("node", "lab", "h1", "h2", "copies").join(nodes, "node")
    of_rows = rows.select("vec_id", "lab", "h1", "h2")
    linked = lookup(of_rows.filter("h1 is not null"), known, ["lab", "h1", "h2"], ["n_links", "component_id"], "copies", max(1, vectors.count()))
    alone = of_rows.filter("h1 is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
