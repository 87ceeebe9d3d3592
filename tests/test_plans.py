"""Objectives, fronts, crowding, search properties and planning jobs."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.operators import badges, compat
from lotweave.plans import genes as gene_arrays
from lotweave.plans import jobs, objectives, pareto, search
from lotweave.plans.objectives import Context


def parcels(spark, areas=(100.0, 110.0, 90.0), allowed=((0, 3), (1, 2, 3), (0, 1, 2, 3))):
    suit = [{"residential": 0.8, "commercial": 0.4, "industrial": 0.2, "green": 0.6}, {"residential": 0.1, "commercial": 0.5, "industrial": 0.9, "green": 0.3},
            {"residential": 0.5, "commercial": 0.7, "industrial": 0.1, "green": 0.2}]
    rows = [(i, f"p{i}", a, r, s, list(c)) for i, (a, r, s, c) in enumerate(zip(areas, (0.2, 0.8, 0.5), suit, allowed))]
    return spark.createDataFrame(rows, "pos bigint, parcel_id string, area_m2 double, risk double, suit map<string,double>, allowed array<int>")


def genes(spark, **plans):
    rows = [(p, pos, c) for p, codes in plans.items() for pos, c in enumerate(codes)]
    return spark.createDataFrame(rows, "plan string, pos bigint, use_code int")


def test_objective_values(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    rows = genes(spark, a=(0, 2, 1), b=(3, 3, 3), c=(1, 0, 0)).join(parcels(spark), "pos")
    got = {r.plan: r for r in objectives.evaluate(rows, objectives.default_objectives(target_mix={"green": 1, "residential": 1}), Context(edges=edges)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert a.zoning_violation_penalty == 0 and c.zoning_violation_penalty == 2 and b.zoning_violation_penalty == 0
    assert a.environmental_risk_exposure == pytest.approx((0.2 * 100 + 0.8 * 110 + 0.5 * 90) / 300)
    assert a.green_area_deviation == pytest.approx(0.3) and b.green_area_deviation == pytest.approx(0.7)
    assert (a.fragmentation_penalty, b.fragmentation_penalty, c.fragmentation_penalty) == (1.0, 0.0, 0.5)
    assert a.mean_suitability_loss == pytest.approx((0.2 * 100 + 0.1 * 110 + 0.3 * 90) / 300)
    assert b.land_use_balance_penalty == pytest.approx(1.0)


def test_objective_edge_cases(spark):
    rows = genes(spark, a=(0, 2, 1)).join(parcels(spark, areas=(0.0, 0.0, 0.0)), "pos")
    got = objectives.evaluate(rows, objectives.default_objectives(), Context()).first()
    assert got.green_area_deviation == 0.3 and got.environmental_risk_exposure == 0.0 and got.fragmentation_penalty == 0.0
    assert got.mean_suitability_loss == pytest.approx((0.2 + 0.1 + 0.3) / 3)
    with pytest.raises(ValueError):
        objectives.balance({"green": 0})


def brute_ranks(v):
    left, rank, out = set(range(len(v))), 0, {}
    while left:
        front = [i for i in left if not any((v[j] <= v[i]).all() and (v[j] < v[i]).any() for j in left)]
        for i in front:
            out[i] = rank
        left -= set(front)
        rank += 1
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_fronts_match_brute_force(spark, block):
    rnd = random.Random(3)
    data = [(i, "hot" if i % 4 else "cold", float(rnd.randint(0, 12)), float(rnd.randint(0, 12)), float(rnd.randint(0, 3))) for i in range(260)]
    df = spark.createDataFrame(data, "id int, run string, x double, y double, z double")
    got = {r.id: r["rank"] for r in pareto.pareto_ranks(df, "run", ["x", "y", "z"], block).collect()}
    for run in ("hot", "cold"):
        ids = [d[0] for d in data if d[1] == run]
        want = brute_ranks(np.array([d[2:] for d in data if d[1] == run]))
        assert {i: got[i] for i in ids} == {ids[k]: r for k, r in want.items()}


def test_fronts_of_chains_null_and_empty(spark):
    # one chain as long as the table: the rank of each row comes through every block before it
    data = [(i, "r", float(i), float(i // 2)) for i in range(60)] + [(60, "r", None, 1.0), (61, None, 1.0, 1.0), (62, "r", 3.0, 1.0)]
    df = spark.createDataFrame(data, "id int, run string, x double, y double")
    got = {r.id: r["rank"] for r in pareto.pareto_ranks(df, "run", ["x", "y"], 16).collect()}
    assert got == {**{i: i for i in range(60)}, 62: 3}
    assert pareto.pareto_ranks(df.limit(0), "run", ["x", "y"]).count() == 0
    assert {r.id: r["rank"] for r in pareto.pareto_ranks(df.filter("id < 9"), "run", ["x"], 4).collect()} == {i: i for i in range(9)}


def test_skyline_with_many_blocks(spark):
    # an anti-chain: nothing dominates anything, so every row stays through the block comparison
    pts = [("r", float(i), float(200 - i), 0.0) for i in range(200)] + [("r", float(i) + 0.5, float(201 - i), 1.0) for i in range(200)]
    df = spark.createDataFrame(pts, "run string, x double, y double, z double")
    got = pareto.skyline(df, "run", ["x", "y", "z"], block_rows=16)
    assert got.count() == 200 and got.filter("z = 1").count() == 0


def test_crowding_matches_single_task_version(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice(["a", "b"]), rnd.randint(0, 2), float(rnd.randint(0, 6)), float(rnd.randint(0, 6)), rnd.random()) for i in range(150)] + [(900, "c", 0, 1.0, 2.0, 3.0), (901, "c", 0, 2.0, 1.0, 3.0)]
    df = spark.createDataFrame(data, "id int, run string, rank int, x double, y double, z double")
    got = {r.id: r.crowding for r in pareto.crowding(df, ["run", "rank"], "id", ["x", "y", "z"]).collect()}
    for run in "abc":
        rows = [d for d in data if d[1] == run]
        want = pareto.numpy_crowding(np.array([d[3:] for d in rows]), np.array([d[2] for d in rows]))
        assert [got[d[0]] for d in rows] == pytest.approx(list(want))


def scenario(spark, n=12):
    rows = [(s, 100 * s + i, f"s{s}p{i}", 100.0 + i, (i % 7) / 7, {"residential": 0.5, "green": 0.9}, [[0, 3], [1, 2], [3], []][i % 4]) for s in (0, 1) for i in range(n)]
    return spark.createDataFrame(rows, "scenario_id int, pos bigint, parcel_id string, area_m2 double, risk double, suit map<string,double>, allowed array<int>")


def test_search_keeps_its_promises(spark):
    config = search.SearchConfig(population_size=12, generations=3, num_output_plans=3)
    seen = []
    population, ranked = search.evolve(scenario(spark), config, progress=lambda e: (seen.append(e["stage"]), 1 / 0))
    ranks = ranked.collect()
    assert len(ranks) == 24 and {r.scenario_id for r in ranks if r["rank"] == 0} == {0, 1}
    rows = search.gene_rows(population).collect()
    assert len(rows) == 24 * 12 and all(not r.allowed or r.use_code in r.allowed for r in rows)
    assert seen == ["initialized"] + ["generation"] * 3
    again = search.evolve(scenario(spark), config)[1].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, ranks))
    # values in the table are those of the genes
    ctx = Context(("scenario_id", "plan"))
    fresh = {(r.scenario_id, r.plan): r for r in objectives.evaluate(search.gene_rows(population), objectives.default_objectives(), ctx).collect()}
    assert all(fresh[(r.scenario_id, r.plan)].mean_suitability_loss == pytest.approx(r.mean_suitability_loss) for r in ranks)


def test_array_objectives_equal_gene_rows(spark):
    parcels = search._with_places(scenario(spark))
    pop = search.random_population(parcels, search.SearchConfig(population_size=7))
    edges = spark.createDataFrame([(100 * s + i, 100 * s + j) for s in (0, 1) for i in range(12) for j in range(i + 1, 12) if (i * j) % 3 == 1] + [(0, 101)], "a bigint, b bigint")
    pairs = spark.createDataFrame([(s, f"s{s}p{i}", f"s{s}p{i + k}", 10.0) for s in (0, 1) for i in range(9) for k in (1, 2, 3)], "scenario_id int, left_id string, right_id string, distance_m double")
    ctx = Context(("scenario_id", "plan"), edges=edges, pairs=pairs, risks=parcels.select("scenario_id", "parcel_id", "risk"))
    chosen = objectives.default_objectives(target_mix={"green": 1, "residential": 2}, compatibility_weight=0.3)
    rows = {(r.scenario_id, r.plan): r for r in objectives.evaluate(search.gene_rows(pop), chosen, ctx).collect()}
    arrays = search.evaluate_population(pop, chosen, ctx).collect()
    assert len(arrays) == len(rows) == 14
    for r in arrays:
        for o in chosen:
            assert r[o.name] == pytest.approx(rows[(r.scenario_id, r.plan)][o.name]), o.name


def test_search_with_edges_and_own_objective(spark, monkeypatch):
    edges = spark.createDataFrame([(100 * s + i, 100 * s + i + 1) for s in (0, 1) for i in range(11)], "a bigint, b bigint")
    share = objectives.Objective("industrial", aggregate=lambda ctx: F.avg((F.col("use_code") == 2).cast("double")))
    chosen = [*objectives.default_objectives(), share]
    config = search.SearchConfig(population_size=6, generations=5)
    runs = []
    for replayed, seats in ((10, 50_000), (2, 50_000), (10, 6)):  # neither the writing of carriers nor waves change the result
        monkeypatch.setattr(gene_arrays, "REPLAYED", replayed)
        monkeypatch.setattr(search, "SEATS", seats)
        population, ranked = search.evolve(scenario(spark), config, chosen, Context(edges=edges))
        runs.append(sorted(map(tuple, ranked.collect())))
        ctx = Context(("scenario_id", "plan"), edges=edges)
        fresh = {(r.scenario_id, r.plan): r for r in objectives.evaluate(search.gene_rows(population), chosen, ctx).collect()}
        for r in ranked.collect():
            assert all(fresh[(r.scenario_id, r.plan)][o.name] == pytest.approx(r[o.name]) for o in chosen)
    assert runs[0] == runs[1] == runs[2]


def test_best_never_gets_worse(spark):
    small = search.SearchConfig(population_size=10, generations=1)
    longer = search.SearchConfig(population_size=10, generations=4)
    low = lambda c: search.evolve(scenario(spark), c)[1].agg(F.min("environmental_risk_exposure")).first()[0]
    assert low(longer) <= low(small) + 1e-12


def test_carriers_are_columns_and_replaced_ones_are_deleted(spark, monkeypatch):
    """At most two tables of carriers lie in the shared folder at a time, none after the search; no carrier is checkpointed."""
    monkeypatch.setattr(gene_arrays, "REPLAYED", 3)
    folders, lying, cut = [], [], []

    def stored(df, name, real=search.stored):
        table = real(df, name)
        folders.append(table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))
        lying.append(sum(map(os.path.isdir, folders)))
        return table

    def cut_lineage(df, real=search.cut_lineage):
        cut.extend(df.columns)
        return real(df)

    monkeypatch.setattr(search, "stored", stored)
    monkeypatch.setattr(search, "cut_lineage", cut_lineage)
    population, ranked = search.evolve(scenario(spark), search.SearchConfig(population_size=6, generations=10))
    assert lying == [1, 2, 2, 2] and not any(map(os.path.exists, folders)) and "genes" in cut and "a_genes" not in cut
    assert ranked.count() == 12 and {len(r["genes"]) for r in population.collect()} == {6}


def test_replay_grows_only_ancestors_and_matches_every_generation(monkeypatch):
    n, rng = 10, np.random.default_rng(4)
    options = np.array([[0, 3, -1], [1, 2, -1], [3, -1, -1], [0, 1, 2]] * 6, np.int16)
    start = np.stack([options[np.arange(24), k % (options >= 0).sum(axis=1)] for k in range(n)], axis=1).astype(np.int16)
    start[3, 2] = 9  # not allowed: its children are repaired
    place = np.arange(24)
    mates = [gene_arrays.Mates(rng.integers(0, n, n), rng.integers(0, n, n), rng.integers(1, 24, n), rng.random(n) < 0.8) for _ in range(4)]
    kept = [np.sort(rng.permutation(2 * n)[:n]) for _ in range(3)]
    history, now = gene_arrays.History(5, mates, kept), start
    for k in range(4):
        young = gene_arrays.children(now, place, place, options, mates[k], 7, 5 + k, 0.2)
        now = np.concatenate((now, young), axis=1)[:, kept[k]] if k < 3 else now
    lists = [[int(c) for c in row if c >= 0] for row in options]
    batch = pa.RecordBatch.from_arrays([pa.array(place), pa.array(place), pa.array(lists, pa.list_(pa.int16())), gene_arrays._packed(start, np.zeros(24, bool))],
                                       names=["a_place", "a_pos", "a_options", "a_genes"])
    grown, plain = [], gene_arrays._grown
    monkeypatch.setattr(gene_arrays, "_grown", lambda g, a, b, who, *rest: (grown.append(len(who)), plain(g, a, b, who, *rest))[1])
    replay = gene_arrays.Replay(7, 0.2, n)
    assert (replay.ends(batch, np.arange(24), "a", history, True)[0] == young).all()
    assert len(grown) == 4 and sum(grown[:3]) < sum((k >= n).sum() for k in kept) + 1 and grown[3] == n
    assert (replay.ends(batch, np.arange(24), "a", history, False)[0] == now).all()


def test_packed_genes_come_back():
    codes = np.array([[0, 3, -1], [300, 2, 1]], np.int16)
    column = gene_arrays._packed(np.concatenate((codes, codes[:1])), np.array([False, False, True]))
    assert column.null_count == 1 and (gene_arrays._codes(column, np.array([1, 0]), 3) == codes[::-1]).all()
    assert (gene_arrays._codes(column, np.array([2, 1]), 3) == [[-1] * 3, [300, 2, 1]]).all() and (gene_arrays._codes(column, np.array([0]), 4) == [[0, 3, -1, -1]]).all()


def test_crossover_mutation_and_tournaments(spark):
    options = np.array([[0, 3, -1], [1, 2, -1], [3, -1, -1], [0, 1, 2]] * 5)
    start = np.stack([options[np.arange(20), k % (options >= 0).sum(axis=1)] for k in range(4)], axis=1)
    place = np.arange(20)
    mates = gene_arrays.Mates(np.array([0, 1, 2]), np.array([1, 0, 3]), np.array([5, 5, 9]), np.array([True, True, False]))
    out = gene_arrays.children(start, place, place, options, mates, 1, 1, -1.0)
    late = place >= 5
    assert (out[:, 0] == np.where(late, start[:, 1], start[:, 0])).all() and (out[:, 1] == np.where(late, start[:, 0], start[:, 1])).all()
    assert (out[:, 2] == start[:, 2]).all()
    every = gene_arrays.children(start, place, place, options, mates, 1, 1, 1.0)  # each gene with a choice changes, to an allowed code
    assert ((every != out) == ((options >= 0).sum(axis=1) > 1)[:, None]).all()
    assert (options[:, :, None] == every[:, None, :]).any(axis=1).all()
    assert (every[7:9] == gene_arrays.children(start[7:9], place[7:9], place[7:9], options[7:9], mates, 1, 1, 1.0)).all()  # rows do not depend on each other
    wrong = gene_arrays.children(np.full((20, 4), 9), place, place, options, mates, 1, 1, -1.0)
    assert (options[:, :, None] == wrong[:, None, :]).any(axis=1).all()
    ranked = spark.createDataFrame([(0, i, i % 3, float(i)) for i in range(9)], "scenario_id int, plan int, rank int, crowding double")
    wins = search.tournaments(ranked, search.SearchConfig(population_size=9, tournament_size=9), 1).collect()
    assert len(wins) == 10 and all(w.winner % 3 == min(w.winner % 3, 2) for w in wins)
    with pytest.raises(ValueError):
        search.SearchConfig(tournament_size=1)


def features(spark):
    def box(i):
        x0, x1, y0, y1 = (-117000 + i) / 1000, (-116999 + i) / 1000, 32.8, 32.801
        return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]

    rows = [(i, f"f{i}", {"APN": f"A{i}", "environmental_risk": str(r)}, "Polygon", box(i)) for i, r in enumerate((0.1, 0.7, 0.9))]
    return spark.createDataFrame(rows, f"pos bigint, feature_id string, props map<string,string>, geom_type string, geom {g.GEOM_TYPE}")


def test_optimise_job_end_to_end(spark):
    request = jobs.OptimizeRequest(population_size=10, generations=2, num_output_plans=2, use_spatial_compatibility=True)
    result = jobs.optimize(features(spark), request)
    plans = result.plans.collect()
    assert 1 <= len(plans) <= 2 and all(p["rank"] == 0 for p in plans)
    assert result.assignments.count() == 3 * len(plans) and result.edges.count() == 2
    assert result.objective_names[-1] == "spatial_compatibility_penalty"
    assert {r.neighbor_pairs_evaluated for r in result.compatibility.collect()} == {3}
    assert result.metrics.first().total_parcels == 3


@pytest.mark.parametrize("bad", [{"population_size": 5}, {"generations": 0}, {"num_output_plans": 21}, {"adjacency_predicate": "near"},
                                 {"spatial_neighbor_radius_m": 0}, {"land_use_labels": ("green", "Green ")}])
def test_request_checks(bad):
    with pytest.raises(ValueError):
        jobs.OptimizeRequest(**bad)
    with pytest.raises(ValueError):
        jobs.positive("cell_size", "x")


def test_compatibility_scores_by_hand(spark):
    pairs = spark.createDataFrame([("a", "b", 10.0), ("b", "c", 20.0)], "left_id string, right_id string, distance_m double")
    risks = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.2)], "parcel_id string, risk double")
    uses = spark.createDataFrame([(0, "a", "industrial"), (0, "b", "residential"), (0, "c", "green"), (1, "a", "green")], "plan int, parcel_id string, use string")
    got = {r.plan: r for r in compat.plan_scores(pairs, uses, risks).collect()}
    # a-b: -4 - .4 - .25, b-c: 1 + .75 - .25
    assert got[0].raw_score == pytest.approx(-3.15) and got[0].score == pytest.approx(round((-3.15 / 2 + 5) / 9, 4))
    assert (got[0].industrial_residential_conflicts, got[0].green_buffer_pairs, got[0].conflict_pairs, got[0].compatible_pairs) == (1, 1, 1, 1)
    assert got[1].raw_score == pytest.approx(0.75)
    text = {r.plan: r.notes for r in compat.notes(compat.plan_scores(pairs, uses, risks)).collect()}
    assert text[0] == "1 industrial-residential proximity conflict was detected. 1 green-buffer relationship support environmental protection."
    none = compat.plan_scores(pairs.limit(0), uses, risks)
    assert {r.score for r in none.collect()} == {0.0} and {r.penalty for r in compat.objective(none).collect()} == {0.0}
    local = {(r.plan, r.parcel_id): r for r in compat.local_context(pairs, uses, risks).collect()}
    assert local[(0, "b")].neighbor_pairs_evaluated == 2 and local[(0, "b")].closest.startswith("a:10.0:-4.4")
    assert "close to green" not in " ".join(local[(0, "a")].warnings) and local[(0, "a")].near_residential == 1


def test_badges_need_spread(spark):
    plans = spark.createDataFrame([(1, 0, 0.5, 1.0, None, 0.2, 0.8), (1, 1, 0.5, 3.0, None, 0.6, 0.4)], "run int, plan int, risk_x double, zoning_x double, deviation double, green_share double, built_share double")
    got = {r.plan: r.badges for r in badges.plan_badges(plans, ["risk_x", "zoning_x"]).collect()}
    assert got[0] == ["Best Overall Tradeoff", "Best Zoning Compliance", "Most Development-Friendly"] and got[1] == ["Greenest Plan"]


def test_fingerprint_ignores_order_but_not_content(spark):
    f = features(spark)
    key = lambda df, s: jobs.fingerprint(df, s).first()[0]
    base = key(f, {"a": 1, "b": 2})
    assert base == key(f.orderBy(F.desc("pos")).repartition(3), {"b": 2, "a": 1})
    assert base != key(f, {"a": 1, "b": 3}) and base != key(f.unionAll(f.limit(1)), {"a": 1, "b": 2})
