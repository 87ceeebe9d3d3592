"""Jaccard self-join of word shingles by parity sketches, and the classes that its links form.

A token flips one bit of a document's sketch, so the Hamming distance of two sketches never exceeds
the symmetric difference of their token sets. The sketch has m blocks; a block is wide (2^64 bit
positions), so it is kept as the XOR of its tokens' 64-bit values, and two blocks are taken as equal
when these agree. Jaccard >= t allows at most d = (1-t)/(1+t) * (|A|+|B|) differing tokens, so if
either document fills more than d blocks, one filled block has no differing token and is equal in
both (pigeonhole). m is set per size band so that nearly all documents fill that many; the few that
do not also emit every token as a block of its own, which meets the same kind of document on the
other side. No link is lost. Candidates pass a folded sketch (Hamming bound), then, since a sketch of fixed
width says nothing of large sets, one as wide as the set asks for, then the exact sets. Only documents of
pairs that passed all sketches have their sets moved.

Groups. Documents with equal sets are one class at once, by aggregation. In a bucket of equal blocks
each document is paired with the bucket's first one only (inside an Arrow batch before the shuffle,
so a bucket of any size sends one row per batch). Buckets whose documents do not all end in one
component are then compared across components in tiles of bounded size, by sketch inside the task;
only pairs that the sketches allow become rows. So every link between components is tested.

Defined results. Null, empty and word-less texts have no shingles and link with nothing. A null
doc_id links with nothing and has a null component. Rows that repeat a doc_id are one document: a
link of any of them is a link of the document, and equal rows of the result are given once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import HOT_SHARE, NOT_SPACE, hash_words, lean, list_column, lookup, mix, remove, run_hashes, signed, small_batches, text_column, text_slices, written
from lotweave.llm.components import components

#: Bits of the folded sketch that candidates pass first; it tells apart sets of up to about twice as many tokens.
SKETCH_BITS = 1024
#: Sets of more tokens have a second sketch of at least 2/3 bit a token, up to ``MOST_BITS``.
NARROW = SKETCH_BITS * 3 // 2
MOST_BITS = 1 << 15
#: Tokens of all documents for each task of the key shuffle, which sorts about two thirds as many keys.
TASK_TOKENS = 3_000_000


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; a shorter text is one shingle."""
    for first, end, data, offsets in text_slices(column):
        words, counts = hash_words(data, offsets, NOT_SPACE)
        at = 0
        for n in counts:
            own = words[at:at + n]
            at += n
            yield np.unique(run_hashes(own, k if n >= k else int(n))) if n else own


class Bands:
    """Size bands and the blocks of each; ``percent`` is the least similarity."""

    def __init__(self, percent: int):
        self.t = percent / 100
        self.step = math.log(1 / self.t)
        self.gap = (1 - self.t) / (1 + self.t)

    def low(self, band: int) -> float:
        return math.exp(band * self.step)

    def of(self, n: int) -> int:
        return int(math.floor(math.log(n) / self.step + 1e-9))

    def blocks(self, band: int) -> int:
        """Enough blocks that a random text of the band's top size fills more than ``most(size)``."""
        top = self.low(band + 1)
        need = self.most(top) + 1
        m = need
        # expected filled blocks less three standard deviations
        while m * (1 - math.exp(-top / m)) - 3 * math.sqrt(m * math.exp(-top / m)) < need and m < 64 * top + 64:
            m *= 1.02 if m > 100 else 1.1
        return max(1, int(math.ceil(m)))

    def most(self, n: float) -> float:
        """Differing tokens that a document of ``n`` tokens can have with any partner, larger ones included."""
        return self.gap * (n + n / self.t)

    def roles(self, n: int) -> list[int]:
        """A document's own band, and those above that can hold a larger partner."""
        own = self.of(n)
        out, reach = [own], n / self.t + 1e-6
        while self.low(out[-1] + 1) <= reach + 1:
            out.append(out[-1] + 1)
        return out


def block_keys(tokens: np.ndarray, band: int, m: int, most: float) -> np.ndarray:
    """Keys of the filled blocks of one document for one band."""
    salt = mix(np.array([band * 2 + 1], dtype=np.uint64))[0]
    value = mix(tokens ^ salt)
    block = ((value >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(block, kind="stable")
    at = block[order]
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    parity = np.bitwise_xor.reduceat(value[order], cuts)
    keys = mix(parity ^ mix(at[cuts] + salt))
    if len(cuts) <= most:  # too few filled blocks for the pigeonhole: each token is a block
        keys = np.concatenate((keys, mix(mix(tokens + np.uint64(1)) ^ salt)))
    return keys


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits in words of 64."""
    bit = tokens >> np.uint64(54)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(tokens: np.ndarray) -> np.ndarray | None:
    """Parity bits by the lowest bits of the tokens; halves of its words fold to the next narrower one. None for small sets."""
    if len(tokens) <= NARROW:
        return None
    bits = 2 * SKETCH_BITS
    while 3 * bits < 2 * len(tokens) and bits < MOST_BITS:
        bits *= 2
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


FEATURES = "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>, wide array<bigint>"


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    return int(signed(np.bitwise_xor.reduce(tokens, keepdims=True))[0]), int(signed(np.add.reduce(mix(tokens), keepdims=True))[0])


def features(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: set size, set hash, folded sketch and the wide sketch of a large set."""
    def run(batches):
        for batch in small_batches(batches):
            rows, sketches, wide = [[] for _ in range(3)], [], []
            for tokens in shingle_sets(text_column(batch, "text"), words):
                for column, value in zip(rows, (len(tokens), *(set_hash(tokens) if len(tokens) else (0, 0))), strict=True):
                    column.append(value)
                sketches.append(sketch(tokens))
                wide.append(wide_sketch(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in rows], list_column(sketches, pa.int64()),
                                              pa.array(wide, pa.list_(pa.int64()))], names=["doc_id", "n", "h1", "h2", "sketch", "wide"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), FEATURES)


def shingles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the sorted array of its shingle hashes."""
    def run(batches):
        for batch in small_batches(batches):
            sets = [signed(s) for s in shingle_sets(text_column(batch, "text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(sets, pa.int64())], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, tokens array<bigint>")


# ---------------------------------------------------------------- buckets

ROWS = "key bigint, a bigint, b bigint"


def _runs(key: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: where runs begin, and the run's first ``a`` for every row."""
    head = np.concatenate(([True], key[1:] != key[:-1]))
    return head, a[np.flatnonzero(head)][np.cumsum(head) - 1]


def _table(key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), b], names=["key", "a", "b"])


def _spread(words: int, percent: int, hot: dict[tuple[int, int, int], int]):
    """Texts to (key, a): one row per block key and batch. The batch's other documents of a key leave
    as star pairs (key, a, b). Copies of ``hot`` sets other than their first emit nothing."""
    bands = Bands(percent)
    blocks: dict[int, int] = {}

    def run(batches):
        for batch in small_batches(batches):  # a document has some hundreds of keys
            ids, keys = batch.column(0).to_pylist(), []
            for doc_id, tokens in zip(ids, shingle_sets(text_column(batch, "text"), words), strict=True):
                n, found = len(tokens), [np.zeros(0, np.uint64)]
                if n and doc_id is not None and hot.get((*set_hash(tokens), n), doc_id) == doc_id:
                    for band in bands.roles(n):
                        m = blocks.get(band) or blocks.setdefault(band, bands.blocks(band))
                        found.append(block_keys(tokens, band, m, bands.most(n)))
                keys.append(signed(np.concatenate(found)))
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            if not len(flat):
                continue
            doc = np.repeat(np.array([i or 0 for i in ids], np.int64), [len(k) for k in keys])
            order = np.lexsort((doc, flat))
            key, doc = flat[order], doc[order]
            head, rep = _runs(key, doc)
            yield _table(key[head], doc[head], pa.nulls(int(head.sum()), pa.int64()))
            again = ~head & (doc != rep)
            if again.any():
                yield _table(key[again], rep[again], pa.array(doc[again], pa.int64()))

    return run


def _stars(batches):
    """Rows sorted by key and a, pairs among them: pairs pass, and each lone row is paired with its key's first."""
    last_key, last_rep = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        lone = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        pairs = batch.filter(pa.array(~lone))
        if pairs.num_rows:
            yield pairs
        key, a = batch.column(0).to_numpy()[lone], batch.column(1).to_numpy()[lone]
        if not len(key):
            continue
        rep = _runs(key, a)[1].copy()
        if last_key is not None and key[0] == last_key:
            rep[key == last_key] = last_rep
        last_key, last_rep = key[-1], rep[-1]
        keep = rep != a
        if keep.any():
            yield _table(key[keep], rep[keep], pa.array(a[keep], pa.int64()))


def star_pairs(docs: DataFrame, words: int, percent: int, hot: dict, tasks: int = 0) -> DataFrame:
    """(key, a, b): documents that share a key, each with one other document of it. One shuffle, of ``tasks``
    partitions where the session has fewer, so that their sorts stay in memory; pairs made before it are spread over all."""
    spread = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(_spread(words, percent, hot)), ROWS)
    home = F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("key", "b"))
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(tasks, home) if tasks > own else spread.repartition(home)
    return dealt.sortWithinPartitions("key", "a").mapInArrow(lean(_stars), ROWS)


#: Members of a bucket that one task compares with as many others.
TILE = 2048


def _tiles(percent: int):
    """Rows sorted by (key, i, j): in each tile, pairs of different components whose sizes and sketches allow the similarity."""
    def compare(x, y, same_tile):
        n, sketches = x["n"], x["s"]
        for at in range(0, len(n), 256):
            one = slice(at, at + 256)
            apart = sum(np.bitwise_count(sketches[one, None, k] ^ y["s"][None, :, k]).astype(np.int64) for k in range(SKETCH_BITS // 64))
            total = n[one, None] + y["n"][None, :]
            ok = (100 + percent) * apart <= (100 - percent) * total
            ok &= 100 * np.minimum(n[one, None], y["n"]) >= percent * np.maximum(n[one, None], y["n"])
            ok &= x["of"][one, None] != y["of"]
            if same_tile:
                ok &= x["id"][one, None] < y["id"]
            l, r = np.nonzero(ok)
            if len(l):
                yield x["id"][at + l], y["id"][r]

    def side(t, rows):
        return {"id": t["id"][rows], "of": t["of"][rows], "n": t["n"][rows], "s": t["s"][rows]}

    def tile(t, i, j):
        if i == j:
            x = side(t, slice(None))
            yield from compare(x, x, True)
        else:
            yield from compare(side(t, t["block"] == i), side(t, t["block"] == j), False)

    def run(batches):
        held = None

        def done(t):
            for a, b in tile(t, t["i"][0], t["j"][0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: batch.column(k).to_numpy() for k, c in enumerate(("key", "i", "j", "block", "id", "of", "n"))}
            t["s"] = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            new = (t["key"][1:] != t["key"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                yield from done({c: v[first:end] for c, v in t.items()})
            held = {c: v[cuts[-1]:] for c, v in t.items()}
        if held is not None:
            yield from done(held)

    return run


def across_pairs(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different components in a bucket that may be similar. A bucket is cut into
    blocks of ``TILE`` members and every pair of blocks is a tile, so no task holds a bucket. Sketches
    join once the tiles are cut and travel in the tiles' shuffle alone."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    cut = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = cut.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "of")
    tiled = tiled.join(known.withColumnRenamed("doc_id", "id"), "id").select("key", "i", "j", "block", "id", "of", "n", "sketch")
    tiled = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tiled.mapInArrow(lean(_tiles(percent)), "a bigint, b bigint").distinct()


def once(members: DataFrame) -> DataFrame:
    """Of buckets with the same members, one: the others hold no other pair."""
    marks = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in (1, 2)])
    return members.join(marks.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


# ---------------------------------------------------------------- verification

#: Ids whose set may be broadcast to pick texts; with more, texts and ids meet in a shuffled join.
MOST_BROADCAST = 1_000_000


def sketch_filter(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of distinct (a, b), those whose sizes and folded sketches allow the similarity."""
    def side(name):
        return known.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "sketch")])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    na, nb = F.col("a_n"), F.col("b_n")
    close = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))
    return both.filter(close).select("a", "b").distinct()


def wide_filter(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Of distinct (a, b), those whose wide sketches allow the similarity, folded to the narrower of both; a set without one passes."""
    def side(name):
        return wide.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "wide")])

    width = F.least(F.size("a_wide"), F.size("b_wide"))

    def folded(c):
        word = lambda i: F.aggregate(F.sequence(i, F.size(c) - 1, width), F.lit(0).cast("bigint"), lambda x, k: x.bitwiseXOR(F.get(c, k)))
        return F.when(F.size(c) == width, F.col(c)).otherwise(F.transform(F.sequence(F.lit(0), width - 1), word))

    apart = F.aggregate(F.zip_with(folded("a_wide"), folded("b_wide"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    close = F.col("a_wide").isNull() | F.col("b_wide").isNull() | ((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(close).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, wide: DataFrame, words: int, percent: int) -> DataFrame:
    """Of distinct (a, b), those whose exact shingle sets have the similarity."""
    pairs = written(wide_filter(pairs, wide, percent), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    picked = F.broadcast(ids) if 2 * pairs.count() <= MOST_BROADCAST else ids
    sets = shingles(docs.join(picked, "doc_id", "left_semi"), words)
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    total = F.size("ta") + F.size("tb") - common
    return pairs.join(one, "a").join(two, "b").filter((total > 0) & (100 * common >= percent * total)).select("a", "b").distinct()


def linked(docs: DataFrame, stars: DataFrame, known: DataFrame, wide: DataFrame, ties: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of everything that a link or one of ``ties`` connects.

    ``stars`` and ``known`` hold one document per distinct set, ``wide`` the sizes and wide sketches of all sets.
    """
    first = verified(sketch_filter(stars.select("a", "b").distinct(), known, percent), docs, wide, words, percent).unionByName(ties)
    class_of = written(components(first), "classes")
    both = F.array(F.struct("key", F.col("a").alias("id")), F.struct("key", F.col("b").alias("id")))
    members = stars.select(F.explode(both).alias("m")).select("m.*").distinct()
    # Copies of one text share most keys. Each document's smallest open key alone links most of what
    # is left; all open keys then have little to compare twice.
    for first_key_only in (True, False):
        placed = _open(members, class_of)
        if first_key_only:
            placed = placed.join(placed.groupBy("id").agg(F.min("key").alias("key")), ["key", "id"], "left_semi")
        class_of = _merged(class_of, verified(across_pairs(once(written(placed, "open")), known, percent), docs, wide, words, percent))
    return class_of


def _open(members: DataFrame, class_of: DataFrame) -> DataFrame:
    """(key, id, of) of keys whose documents are not all in one component."""
    placed = members.join(class_of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("of"))
    open_keys = placed.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("key")
    return placed.join(open_keys, "key", "left_semi")


def _merged(class_of: DataFrame, more: DataFrame) -> DataFrame:
    """Components after the links ``more``: components of the components."""
    for c in ("a", "b"):
        at = class_of.select(F.col("id").alias(c), F.col("component").alias("_in"))
        more = more.join(at, c, "left").withColumn(c, F.coalesce("_in", c)).drop("_in")
    joined = written(components(more).select(F.col("id").alias("component"), F.col("component").alias("whole")), "joined")
    inside = class_of.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    alone = joined.join(class_of.select(F.col("id").alias("component")), "component", "left_anti")
    return written(inside.unionByName(alone.select(F.col("component").alias("id"), F.col("whole").alias("component"))), "classes")


def near_classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) for every document."""
    every = written(features(docs, words), "features")
    filled = every.filter("n > 0 and doc_id is not null")
    groups = written(filled.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "sets")
    total, tokens = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("copies"), F.col("copies") * F.col("n"))]).first()
    wide = written(filled.dropDuplicates(["doc_id", "h1", "h2", "n"]).select("doc_id", "n", "wide"), "wide")
    rows = written(lookup(filled.drop("wide"), groups, ["h1", "h2", "n"], ["first_id"], "copies", total), "rows")
    known = rows.filter("doc_id = first_id").select("doc_id", "n", "sketch").dropDuplicates(["doc_id", "n"])
    # fewer than HOT_SHARE sets
    hot = {(r["h1"], r["h2"], r["n"]): r["first_id"] for r in groups.filter(F.col("copies") > max(1, total // HOT_SHARE)).collect()}
    stars = star_pairs(docs, words, percent, hot, -(-tokens // TASK_TOKENS))
    for c in ("a", "b"):
        at = rows.select(F.col("doc_id").alias(c), F.col("first_id").alias(f"{c}_first"))
        stars = stars.join(at, c)
    stars = written(stars.select("key", F.col("a_first").alias("a"), F.col("b_first").alias("b")).filter("a <> b").distinct(), "stars")
    # a repeated doc_id ties the sets of its rows together
    apart = rows.groupBy("doc_id").agg(F.min("first_id").alias("a"), F.max("first_id").alias("z")).filter("a < z")
    ties = rows.join(apart, "doc_id").select("a", F.col("first_id").alias("b"))
    of = linked(docs, stars, known, wide, ties, words, percent).select(F.col("id").alias("first_id"), F.col("component"))
    remove(stars)  # ``linked`` is written
    labelled = rows.join(of, "first_id", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                        F.coalesce("component", "first_id").alias("component_id"))
    rest = every.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return labelled.unionByName(rest)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another document of their class stands for (the smallest doc_id)."""
    classes = near_classes(docs, words, percent)
    gone = written(classes.filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    picked = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone  # texts are shuffled only beyond that
    return docs.join(picked, "doc_id", "left_anti").select(*docs.columns)
