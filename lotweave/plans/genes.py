"""Populations as arrays: mating, objectives and survivors without moving genes between tasks.

The carriers of a search are its parcels, its adjacency edges and its neighbour pairs. Each carrier
row holds the gene arrays of its own ends (one code per individual), joined once when the search
starts. A child's gene depends on its parents' genes at the same parcel, on the generation's short
mating list and on a hash of seed, generation, child and parcel, so every carrier grows its own
children: no gene row is exploded and nothing is shuffled by parcel inside a generation. Objectives
are sums over carriers, one number per individual; only these sums leave the tasks.

What happened in a generation (mating lists and survivors) is a few numbers per individual. Tasks
replay them from the last written carriers, which are written anew every ``REPLAYED`` generations.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.plans.pareto import front_ranks, numpy_crowding

#: Generations that tasks replay before the carriers are written again.
REPLAYED = 10
PARCEL, EDGE, PAIR = 0, 1, 2
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Block:
    """Carriers of one kind and scenario: codes are (rows, individuals), -1 where an end has no parcel."""

    codes: np.ndarray
    other: np.ndarray | None
    area: np.ndarray
    risk: np.ndarray
    suit: np.ndarray
    options: np.ndarray
    held: dict[int, np.ndarray] = field(default_factory=dict, compare=False)

    def with_code(self, code: int, *weights: np.ndarray) -> list[np.ndarray]:
        """Per weight (one number a row): its sums over the rows that have ``code``, one per individual.

        What has the code is marked once, so all objectives share it.
        """
        if code not in self.held:
            self.held[code] = (self.codes == code).astype(np.float64)
        mark = self.held[code]
        return [w @ mark if np.isfinite(w).all() else np.where(mark > 0, w[:, None], 0.0).sum(axis=0) for w in weights]


@dataclass(frozen=True)
class ArrayForm:
    """An objective as sums over carriers of one kind.

    ``terms`` gives (count, individuals) sums of a block; ``value`` turns the whole sums into the objective.
    """

    kind: int
    count: int
    terms: Callable[[Block], Sequence[np.ndarray]]
    value: Callable[[np.ndarray], np.ndarray]


# ---------------------------------------------------------------- draws

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(seed: int, generation: int, what: str, child: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing else than the arguments; ``child`` and ``pos`` broadcast."""
    return (_mix(_mix(np.asarray(pos).astype(np.uint64)) ^ _keys(child, _start(seed, generation, what))) >> np.uint64(11)) * 2.0 ** -53


def _start(seed: int, generation: int, what: str) -> np.uint64:
    return np.uint64((seed * 0x9E3779B97F4A7C15 + generation * 0xD1B54A32D192ED03 + zlib.crc32(what.encode())) & _MASK)


def _keys(child: np.ndarray, start: np.uint64) -> np.ndarray:
    return _mix(np.asarray(child).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + start)


def _picked(options: np.ndarray, count: np.ndarray, u: np.ndarray) -> np.ndarray:
    return options[np.arange(len(options)), np.floor(u * count).astype(np.int64)]


@dataclass(frozen=True)
class Mates:
    """Of each child: parents, first parcel of the second parent's part, and whether the parents mix."""

    a: np.ndarray
    b: np.ndarray
    split: np.ndarray
    mixed: np.ndarray


def _below(x: np.ndarray, rate: float) -> np.ndarray:
    """Where the number in [0, 1) that ``draws`` makes of mixed bits is at most ``rate``."""
    most = int(np.floor(rate * 2.0 ** 53)) if rate >= 0 else -1
    return x < np.uint64((most + 1) << 11) if most + 1 < 1 << 53 else np.ones(len(x), dtype=bool)


def _allowed(genes: np.ndarray, options: np.ndarray) -> np.ndarray:
    """Which of ``genes`` (individuals, rows) are among the options of their row."""
    found = np.zeros(genes.shape, dtype=bool)
    for column in options.T:
        found |= genes == column[None, :]
    return found


def _grown(genes: np.ndarray, a: np.ndarray, b: np.ndarray, who: np.ndarray, place, pos, options, mates: Mates, seed: int, generation: int,
           rate: float, legal: bool) -> np.ndarray:
    """The children ``who`` of parents in the rows ``a`` and ``b`` of ``genes``, an array of (individuals, rows).

    ``legal``: all genes are allowed, so no child needs repair, since mutation draws from the options.
    """
    out = np.empty((len(who), genes.shape[1]), genes.dtype)
    if not out.size:
        return out
    low, high = place.min(), place.max()
    spots, start, word = _mix(pos.astype(np.uint64)), _start(seed, generation, "rate"), np.empty(len(pos), np.uint64)
    keys, rows = _keys(who, start), []
    for i, child in enumerate(who):
        split = mates.split[child]
        if not mates.mixed[child] or split > high:
            out[i] = genes[a[i]]
        elif split <= low:
            out[i] = genes[b[i]]
        else:
            out[i] = np.where(place >= split, genes[b[i]], genes[a[i]])
        np.bitwise_xor(spots, keys[i], out=word)
        rows.append(np.flatnonzero(_below(_mix(word), rate)))
    at, row = np.repeat(np.arange(len(who)), [len(r) for r in rows]), np.concatenate(rows)
    count = (options >= 0).sum(axis=1)
    if len(row):
        own, n, now = options[row], count[row], out[at, row]
        same = own == now[:, None]
        has = same.any(axis=1)
        others = n - has
        u = draws(seed, generation, "swap", who[at], pos[row])
        to = np.floor(u * np.maximum(others, 1)).astype(np.int64)
        to += has & (to >= same.argmax(axis=1)) & (others > 0)
        out[at, row] = own[np.arange(len(row)), np.where(others > 0, to, 0)]
    if not legal:
        bad, bad_row = np.nonzero(~_allowed(out, options))
        if len(bad_row):
            out[bad, bad_row] = _picked(options[bad_row], count[bad_row], draws(seed, generation, "repair", who[bad], pos[bad_row]))
    return out


def children(genes, place, pos, options, mates: Mates, seed: int, generation: int, rate: float) -> np.ndarray:
    """One-point crossover, mutation to another allowed code, repair, for all rows and children at once.

    ``genes`` is (rows, individuals), ``options`` (rows, widest), padded with -1.
    """
    own = np.ascontiguousarray(genes.T)
    legal = bool(_allowed(own, options).all())
    return np.ascontiguousarray(_grown(own, mates.a, mates.b, np.arange(len(mates.a)), place, pos, options, mates, seed, generation, rate, legal).T)


# ---------------------------------------------------------------- objectives

def zoning_form(labels: Sequence[str]) -> ArrayForm:
    def terms(b: Block):
        allowed = [b.with_code(c, (b.options == c).any(axis=1).astype(float))[0] for c in np.unique(b.options)]
        return [len(b.codes) - sum(allowed, np.zeros(b.codes.shape[1]))]

    return ArrayForm(PARCEL, 1, terms, lambda s: s[0])


def _share(part: np.ndarray, whole: np.ndarray, empty) -> np.ndarray:
    return np.where(whole > 0, part / np.where(whole > 0, whole, 1.0), empty)


def green_form(target: float, labels: Sequence[str]) -> ArrayForm:
    if "green" not in labels:
        return ArrayForm(PARCEL, 0, lambda b: [], lambda s: np.zeros(s.shape[1]))
    green = labels.index("green")

    def terms(b: Block):
        return [*b.with_code(green, b.area), np.full(b.codes.shape[1], b.area.sum())]

    return ArrayForm(PARCEL, 2, terms, lambda s: np.where(s[1] > 0, np.abs(_share(s[0], s[1], 0.0) - target), abs(target)))


def risk_form(labels: Sequence[str]) -> ArrayForm:
    built = [i for i, u in enumerate(labels) if u in vocab.BUILT_USES] or [i for i, u in enumerate(labels) if u != "green"]

    def terms(b: Block):
        exposed = np.nan_to_num(b.risk * b.area)
        return [sum((b.with_code(c, exposed)[0] for c in built), np.zeros(b.codes.shape[1])), np.full(b.codes.shape[1], b.area.sum())]

    return ArrayForm(PARCEL, 2, terms, lambda s: _share(s[0], s[1], 0.0))


def suitability_form(labels: Sequence[str]) -> ArrayForm:
    def terms(b: Block):
        each = []
        for c in range(len(labels)):
            loss = 1.0 - np.clip(b.suit[:, c], 0.0, 1.0)
            each.append(b.with_code(c, loss * b.area, loss, np.ones(len(loss))))
        lost, plain, known = (sum(e, np.zeros(b.codes.shape[1])) for e in zip(*each, strict=True))
        return [lost, np.full(b.codes.shape[1], b.area.sum()), plain, known]

    return ArrayForm(PARCEL, 4, terms, lambda s: _share(s[0], s[1], _share(s[2], s[3], 0.0)))


def balance_form(weights: Mapping[str, float], labels: Sequence[str]) -> ArrayForm:
    total, k = sum(weights.values()), len(labels)

    def terms(b: Block):
        return [*[b.with_code(i, np.ones(len(b.codes)))[0] for i in range(k)], np.full(b.codes.shape[1], len(b.codes))]

    def value(s):
        return sum(np.abs(_share(s[i], s[k], 0.0) - weights.get(u, 0.0) / total) for i, u in enumerate(labels))

    return ArrayForm(PARCEL, k + 1, terms, value)


def fragmentation_form(labels: Sequence[str]) -> ArrayForm:
    def terms(b: Block):
        return [(b.codes != b.other).sum(axis=0), np.full(b.codes.shape[1], len(b.codes))]

    return ArrayForm(EDGE, 2, terms, lambda s: _share(s[0], s[1], 0.0))


def compatibility_form(weight, labels: Sequence[str]) -> ArrayForm:
    known = {u: u for u in (*vocab.LAND_USES, "unknown")} | vocab.COMPATIBILITY_ALIASES
    names = [known.get(u.strip().lower().replace(" ", "_"), "unknown") for u in labels] + ["unknown"]  # the last is a missing end (-1)
    table = np.array([[vocab.COMPATIBILITY_PAIRS.get((x, y), vocab.COMPATIBILITY_PAIRS.get((y, x), 0.0)) for y in names] for x in names])
    try:
        w = max(float(weight), 0.0)
    except (TypeError, ValueError):
        w = 0.15

    def either(b: Block, *uses: str) -> np.ndarray:
        which = np.array([n in uses for n in names])
        return which[b.codes] | which[b.other]

    def terms(b: Block):
        elevated, severe = (b.risk >= 0.6)[:, None], (b.risk >= 0.8)[:, None]
        score = table[b.codes, b.other] + 0.75 * (either(b, "green") & elevated) - 0.4 * (either(b, "industrial") & elevated)
        score = score - either(b, "residential", "commercial") * np.where(severe, 0.25, np.where(elevated, 0.15, 0.0))
        return [score.sum(axis=0), np.full(score.shape[1], len(score))]

    def value(s):
        mean = _share(s[0], s[1], 0.0)
        score = np.floor(np.clip((mean + 5.0) / 9.0, 0.0, 1.0) * 1e4 + 0.5) / 1e4
        return np.where((s[1] == 0) | (w <= 0), 0.0, (1.0 - score) * w)

    return ArrayForm(PAIR, 2, terms, value)


# ---------------------------------------------------------------- carriers

FIELDS = ("kind", "a_place", "a_pos", "a_options", "a_genes", "b_place", "b_pos", "b_options", "b_genes", "area", "risk", "suit")


def carriers(population: DataFrame, labels: Sequence[str], edges: DataFrame | None, pairs: DataFrame | None, risks: DataFrame | None) -> DataFrame:
    """One row per parcel, per edge inside a scenario, and per neighbour pair, with the genes of its ends (two bytes each).

    ``population`` has scenario_id, place, pos, parcel_id, area_m2, risk, suit, options and genes. A pair
    without ``scenario_id`` counts in every scenario; an end that has no parcel there is unknown.
    """
    small = "array<smallint>"
    code = lambda c: F.lpad(F.hex(F.pmod(F.coalesce(c.cast("int"), F.lit(-1)), F.lit(1 << 16))), 4, "0")
    # two bytes a gene in one binary value: rows of arrays cost the JVM far more on their way to Python, in every generation
    packed = F.unhex(F.array_join(F.transform("genes", code), "")).alias("genes")
    own = population.select(
        "scenario_id", "parcel_id", "pos", F.struct("place", "pos", F.array_distinct("options").cast(small).alias("options"), packed).alias("p"),
        F.greatest(F.coalesce("area_m2", F.lit(0.0)), F.lit(0.0)).alias("area"), F.col("risk").cast("double").alias("risk"),
        F.array(*[F.coalesce(F.col("suit")[u].cast("double"), F.lit(0.0)) for u in labels]).alias("suit"))

    def row(kind, a, b, area, risk, suit):
        end = lambda p, s: [F.col(f"{p}.{c}").alias(f"{s}_{c}") if p else F.lit(None).cast(t).alias(f"{s}_{c}")
                            for c, t in (("place", "bigint"), ("pos", "bigint"), ("options", small), ("genes", "binary"))]
        return ["scenario_id", F.lit(kind).cast("int").alias("kind"), *end(a, "a"), *end(b, "b"), area.cast("double").alias("area"), risk.cast("double").alias("risk"), suit.alias("suit")]

    none, no_suit = F.lit(None), F.array().cast("array<double>")
    out = own.select(*row(PARCEL, "p", None, F.col("area"), F.col("risk"), F.col("suit")))
    ends = own.select("scenario_id", "parcel_id", F.col("pos").alias("a"), F.col("p").alias("pa"))
    others = own.select("scenario_id", "parcel_id", F.col("pos").alias("b"), F.col("p").alias("pb"))
    if edges is not None:
        met = edges.select("a", "b").join(ends.drop("parcel_id"), "a").join(others.drop("parcel_id"), ["scenario_id", "b"])
        out = out.unionByName(met.select(*row(EDGE, "pa", "pb", none, none, no_suit)))
    if pairs is not None:
        if "scenario_id" not in pairs.columns:
            pairs = pairs.join(population.select("scenario_id").distinct())
        keys = ["scenario_id"] if risks is not None and "scenario_id" in risks.columns else []
        near = pairs.select("scenario_id", "left_id", "right_id")
        for side, name in (("left_id", "_l"), ("right_id", "_r")):
            if risks is None:
                near = near.withColumn(name, F.lit(0.0))
            else:
                near = near.join(risks.select(*keys, F.col("parcel_id").alias(side), F.col("risk").alias(name)), [*keys, side], "left")
        met = (near.join(ends.drop("a").withColumnRenamed("parcel_id", "left_id"), ["scenario_id", "left_id"], "left")
               .join(others.drop("b").withColumnRenamed("parcel_id", "right_id"), ["scenario_id", "right_id"], "left"))
        worst = F.greatest(F.coalesce("_l", F.lit(0.0)), F.coalesce("_r", F.lit(0.0)))
        out = out.unionByName(met.select(*row(PAIR, "pa", "pb", none, worst, no_suit)))
    return out


# ---------------------------------------------------------------- replay

@dataclass
class History:
    """What a scenario's individuals went through since the carriers were written: mating lists, and
    which of parents and children stayed. ``first`` is the generation of the first mating list."""

    first: int
    mates: list[Mates]
    kept: list[np.ndarray]


@dataclass(frozen=True)
class Step:
    """A generation of a replay, cut down to what later ones need.

    ``before``: individuals that are held when it begins; ``who``: children to grow, ``a`` and ``b`` the places of their
    parents among the held; ``after``: places, among the held and then the children, of what is held for the next step.
    """

    before: np.ndarray
    who: np.ndarray
    a: np.ndarray
    b: np.ndarray
    after: np.ndarray


def _step(mates: Mates, who: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The individuals that children ``who`` and survivors ``old`` come from, and the places of the children's parents."""
    first = mates.a[who]
    second = np.where(mates.mixed[who], mates.b[who], first)
    before = np.unique(np.concatenate((old, first, second)))
    return before, np.searchsorted(before, first), np.searchsorted(before, second)


def lineage(history: History, n: int, pending: bool) -> tuple[list[Step], Step]:
    """The steps of the finished generations and the last one, whose children are grown when it is ``pending``.

    Children that did not stay, or left no descendant, are never grown.
    """
    none = np.zeros(0, np.int64)
    if pending and len(history.mates) > len(history.kept):
        who = np.arange(len(history.mates[-1].a))
        before, a, b = _step(history.mates[-1], who, none)
        last = Step(before, who, a, b, none)
    else:
        last = Step(np.arange(n), none, none, none, none)
    steps, need = [], last.before
    for mates, kept in zip(history.mates[:len(history.kept)][::-1], history.kept[::-1], strict=True):
        origin = kept[need]
        who = np.unique(origin[origin >= n] - n)
        before, a, b = _step(mates, who, origin[origin < n])
        after = np.where(origin < n, np.searchsorted(before, origin), len(before) + np.searchsorted(who, origin - n))
        steps.append(Step(before, who, a, b, after))
        need = before
    return steps[::-1], last


def _lists(column: pa.Array, rows: np.ndarray, width: int | None = None) -> np.ndarray:
    """(rows, width) of a list column, short and null lists padded with -1."""
    part = column.take(pa.array(rows))
    sizes = np.diff(part.offsets.to_numpy())
    flat = part.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), 1) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).copy()
    out = np.full((len(sizes), width), -1, flat.dtype if len(flat) else np.int16)
    at = np.arange(width)[None, :] < sizes[:, None]
    out[at] = flat
    return out


def _codes(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) of packed genes, short and null ones padded with -1."""
    part = column.take(pa.array(rows)).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
    data = part.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(">i2") if data is not None else np.zeros(0, np.int16)
    sizes = np.diff(offsets) // 2
    if (sizes == width).all():
        return flat.reshape(len(part), width).astype(np.int16)
    out = np.full((len(part), width), -1, np.int16)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _packed(genes: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Rows of genes as binary values, null where ``missing``."""
    offsets = np.arange(len(genes) + 1, dtype=np.int32) * (2 * genes.shape[1])
    whole = pa.Array.from_buffers(pa.binary(), len(genes), [None, pa.py_buffer(offsets), pa.py_buffer(genes.astype(">i2").tobytes())])
    return pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), whole)


def unpacked(state: DataFrame, individuals: int) -> DataFrame:
    """(scenario_id, place, genes): the codes of the parcels among the carriers as arrays."""
    def run(batches):
        for batch in batches:
            codes = _codes(batch.column(2), np.arange(batch.num_rows), individuals).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * individuals), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["scenario_id", "place", "genes"])

    rows = state.filter(F.col("kind") == PARCEL).select("scenario_id", F.col("a_place").alias("place"), "a_genes")
    return rows.mapInArrow(run, f"scenario_id {state.schema['scenario_id'].dataType.simpleString()}, place bigint, genes array<int>")


class Replay:
    """Grows the genes of carrier rows through a scenario's history."""

    def __init__(self, seed: int, rate: float, individuals: int):
        self.seed, self.rate, self.n = seed, rate, individuals

    def ends(self, batch: pa.RecordBatch, rows: np.ndarray, side: str, history: History | None, pending: bool) -> tuple[np.ndarray, np.ndarray]:
        """(codes, options) of one end. With ``pending``, of the children that the last mating list makes."""
        get = lambda c: batch.column(batch.schema.get_field_index(f"{side}_{c}"))
        genes, options = _codes(get("genes"), rows, self.n), _lists(get("options"), rows)
        here = options[:, 0] >= 0
        if history is None or not history.mates or not here.any():
            return genes, options
        place = get("place").take(pa.array(rows[here])).to_numpy(zero_copy_only=False).astype(np.int64)
        pos = get("pos").take(pa.array(rows[here])).to_numpy(zero_copy_only=False).astype(np.int64)
        now, own = np.ascontiguousarray(genes[here].T), options[here]
        legal = bool(_allowed(now, own).all())
        steps, last = lineage(history, self.n, pending)
        now = now[steps[0].before if steps else last.before]
        grow = lambda step, k: _grown(now, step.a, step.b, step.who, place, pos, own, history.mates[k], self.seed, history.first + k, self.rate, legal)
        for k, step in enumerate(steps):
            now = np.concatenate((now, grow(step, k)))[step.after]
        if len(last.who):
            now = grow(last, len(steps))
        genes[here] = now.T
        return genes, options


def _scenarios(batch: pa.RecordBatch):
    """(scenario, kind, row numbers) of a batch."""
    codes = batch.column(0).dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    kind = batch.column(1).to_numpy()
    for s, name in enumerate(codes.dictionary.to_pylist()):
        for k in (PARCEL, EDGE, PAIR):
            rows = np.flatnonzero((at == s) & (kind == k))
            if len(rows):
                yield name, k, rows


def sums(state: DataFrame, forms: Sequence[ArrayForm], replay: Replay, log: Mapping[object, History]) -> DataFrame:
    """(scenario_id, plan, parcels, t0, t1, ...): every form's terms, summed over all carriers."""
    width = sum(f.count for f in forms)

    def run(batches):
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            number = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: B023, E731
            area, risk = number("area"), number("risk")
            for name, kind, rows in _scenarios(batch):
                codes, options = replay.ends(batch, rows, "a", log.get(name), True)
                other = None if kind == PARCEL else replay.ends(batch, rows, "b", log.get(name), True)[0]
                block = Block(codes, other, area[rows], risk[rows], _lists(batch.column(batch.schema.get_field_index("suit")), rows), options)
                mine = total.setdefault(name, np.zeros((width + 1, replay.n)))
                at = 1
                mine[0] += len(rows) if kind == PARCEL else 0
                for f in forms:
                    if f.kind == kind and f.count:
                        mine[at:at + f.count] += np.stack([np.asarray(t, np.float64) for t in f.terms(block)])
                    at += f.count
        for name, mine in total.items():
            ids = pa.array([name] * replay.n, state_type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(replay.n, dtype=np.int32)), *[pa.array(t) for t in mine]],
                                             names=["scenario_id", "plan", "parcels", *[f"t{k}" for k in range(width)]])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = state.schema["scenario_id"].dataType
    state_type = to_arrow_type(kind)
    names = ["parcels", *[f"t{k}" for k in range(width)]]
    parts = state.mapInArrow(run, f"scenario_id {kind.simpleString()}, plan int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("scenario_id", "plan").agg(*[F.sum(c).alias(c) for c in names])


def values(pdf: pd.DataFrame, forms: Sequence[ArrayForm]) -> np.ndarray:
    """(individuals, objectives) from a scenario's summed terms, in the order of the individuals."""
    pdf = pdf.sort_values("plan")
    table = pdf[[c for c in pdf.columns if c not in ("scenario_id", "plan", "parcels")]].to_numpy(dtype=float).T
    out, at = [], 0
    for f in forms:
        out.append(np.asarray(f.value(table[at:at + f.count] if f.count else np.zeros((0, len(pdf))) ), dtype=float))
        at += f.count
    return np.stack(out, axis=1)


def evolved(state: DataFrame, replay: Replay, log: Mapping[object, History], pending: bool) -> DataFrame:
    """The carriers with their genes after the history, or with the children of its last mating list."""
    def run(batches):
        for batch in batches:
            grown = {side: np.full((batch.num_rows, replay.n), -1, np.int16) for side in "ab"}
            for name, kind, rows in _scenarios(batch):
                for side in "a" if kind == PARCEL else "ab":
                    grown[side][rows] = replay.ends(batch, rows, side, log.get(name), pending)[0]
            out = batch
            for side, genes in grown.items():
                at = batch.schema.get_field_index(f"{side}_genes")
                missing = batch.column(at).is_null().to_numpy(zero_copy_only=False)
                out = out.set_column(at, f"{side}_genes", _packed(genes, missing))
            yield out

    return state.mapInArrow(run, state.schema)


# ---------------------------------------------------------------- decisions

def _dice(seed: int, generation: int, scenario: object) -> np.random.Generator:
    return np.random.default_rng([seed, generation, zlib.crc32(str(scenario).encode())])


def _ranked(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and crowding; values to twelve places, so sums added in another order rank the same."""
    rank = front_ranks(table)
    return rank, numpy_crowding(table, rank)


def decide(scenario: object, young: np.ndarray, old: np.ndarray | None, parcels: int, config, generation: int) -> dict[str, np.ndarray]:
    """Who of ``old`` and ``young`` stays, their values, ranks and crowding, and the next mating list."""
    n = config.population_size
    table = np.round(young if old is None else np.concatenate((old, young)), 12)
    rank, crowd = _ranked(table)
    kept = np.sort(np.lexsort((np.arange(len(table)), -crowd, rank))[:n])
    table = table[kept]
    rank, crowd = _ranked(table)
    dice = _dice(config.random_seed, generation, scenario)
    seats = n + n % 2
    drawn = dice.integers(0, n, (seats, config.tournament_size))
    coin = dice.random(drawn.shape)
    best = np.lexsort((coin, -crowd[drawn], rank[drawn]), axis=1)[:, 0]
    parents = drawn[np.arange(seats), best].reshape(-1, 2)
    mixed = (dice.random(len(parents)) <= config.crossover_rate) & (parcels >= 2)
    split = np.floor(dice.random(len(parents)) * max(parcels - 1, 1)).astype(np.int64) + 1
    twice = lambda v: np.repeat(v, 2)[:n]
    return {"values": table.ravel(), "rank": rank, "crowding": crowd, "kept": kept, "a": parents.ravel()[:n], "b": parents[:, ::-1].ravel()[:n],
            "split": twice(split), "mixed": twice(mixed)}


DECIDED = "values array<double>, rank array<int>, crowding array<double>, kept array<int>, a array<int>, b array<int>, split array<bigint>, mixed array<boolean>"


def decisions(found: DataFrame, forms: Sequence[ArrayForm], extra: Sequence[str], old: Mapping[object, np.ndarray], config, generation: int) -> list:
    """One row of ``decide`` per scenario. ``found`` has the summed terms and a column per ``extra`` objective."""
    def run(key, pdf):
        pdf = pdf.sort_values("plan")
        more = pdf[list(extra)].fillna(0.0).to_numpy(dtype=float)
        table = np.concatenate((values(pdf.drop(columns=list(extra)), forms), more), axis=1) if forms else more
        got = decide(key[0], table, old.get(key[0]), int(pdf["parcels"].iloc[0]), config, generation)
        return pd.DataFrame({"scenario_id": [key[0]], **{c: [v] for c, v in got.items()}})

    schema = f"scenario_id {found.schema['scenario_id'].dataType.simpleString()}, {DECIDED}"
    return found.groupBy("scenario_id").applyInPandas(run, schema).collect()
