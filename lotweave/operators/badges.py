"""Plan badges and the overall trade-off score. Runs hold a handful of plans; many runs work side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import kept
from lotweave.functions.landuse import badge_fold

SPREAD = 1e-9


def objective_index(names: Sequence[str], tokens: Sequence[str]) -> int:
    """Position of the first name holding any token, else -1."""
    return next((i for i, n in enumerate(names) if any(t in str(n or "").lower() for t in tokens)), -1)


def use_shares(assignments: DataFrame, use: str = "use_label") -> DataFrame:
    """(run, plan, label, share): labels folded; blank labels stay in the denominator."""
    label = badge_fold(F.col(use))
    counts = assignments.withColumn("label", label).groupBy("run", "plan", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run", "plan")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).filter("label <> ''").drop("n")


def share_facts(assignments: DataFrame, target: Mapping[str, float] | None, use: str = "use_label") -> DataFrame:
    """Per plan: deviation from the target over all labels, green share, built share."""
    shares = use_shares(assignments, use)
    entries = {k: float(v) for k, v in (target or {}).items() if float(v) >= 0}
    total = sum(entries.values())
    wanted = {k.strip().lower().replace(" ", "_").replace("-", "_"): v / total for k, v in entries.items()} if total > 0 else {}
    goal = F.lit(0.0)
    for k, v in wanted.items():
        goal = F.when(F.col("label") == k, F.lit(v)).otherwise(goal)
    in_goal = F.col("label").isin(*wanted) if wanted else F.lit(False)
    # labels of the target that the plan never uses add their full goal
    deviation = F.sum(F.abs(F.col("share") - goal)) + F.lit(sum(wanted.values())) - F.sum(F.when(in_goal, goal).otherwise(0.0))
    share_of = lambda uses: F.sum(F.when(F.col("label").isin(*uses), F.col("share")).otherwise(0.0))
    return shares.groupBy("run", "plan").agg(
        (deviation if wanted else F.lit(None).cast("double")).alias("deviation"),
        share_of(vocab.BADGE_GREEN_USES).alias("green_share"), share_of(vocab.BADGE_BUILT_USES).alias("built_share"))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def overall_scores(plans: DataFrame, objectives: Sequence[str], deviation: str = "deviation") -> DataFrame:
    """Mean of the min-max scaled objectives that spread within the run, target deviation included."""
    run = Window.partitionBy("run")
    terms = []
    for name in (*objectives, deviation):
        v = _finite(F.col(name))
        lo, hi = F.min(v).over(run), F.max(v).over(run)
        terms.append(F.when(hi - lo > SPREAD, (v - lo) / (hi - lo)))
    present = kept(*terms)
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    return plans.withColumn("overall", F.when(F.size(present) > 0, mean))


def _winner(value: Column, lowest: bool, ties: bool = True) -> Column:
    run = Window.partitionBy("run")
    v = _finite(value)
    lo, hi = F.min(v).over(run), F.max(v).over(run)
    best = lo if lowest else hi
    slack = F.greatest(F.abs(best) * 0.02, F.lit(SPREAD)) if ties else F.lit(SPREAD)
    near = (v <= best + slack) if lowest else (v >= best - slack)
    return F.coalesce((hi - lo > SPREAD) & near, F.lit(False))


def plan_badges(plans: DataFrame, names: Sequence[str], shown: int = 3) -> DataFrame:
    """(run, plan, badges): at most three labels by priority.

    ``plans`` has one column per objective of ``names`` and the columns of :func:`share_facts`.
    """
    scored = overall_scores(plans, names)
    at = {k: objective_index(names, t) for k, t in vocab.OBJECTIVE_TOKENS.items()}
    series = lambda k: F.col(names[at[k]]) if at[k] >= 0 else F.lit(None).cast("double")
    wins = {
        "overall": _winner(F.col("overall"), True, ties=False),
        "risk": _winner(series("risk"), True),
        "target_mix": _winner(F.col("deviation"), True),
        "zoning": _winner(series("zoning"), True),
        "compact": _winner(series("compact"), True),
        "green": _winner(F.col("green_share"), False),
        "development": _winner(F.col("built_share"), False) & ~_winner(series("risk"), False),
    }
    flagged = scored.select("run", "plan", *[c.alias(f"w_{k}") for k, c in wins.items()])
    labels = kept(*[F.when(F.col(f"w_{k}"), F.lit(label)) for k, label, _ in vocab.BADGES])
    return flagged.select("run", "plan", F.slice(labels, 1, shown).alias("badges"))
