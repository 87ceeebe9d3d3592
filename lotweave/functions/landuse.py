"""Land-use label normalisers, allowed-use inference and target mixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, blank_to_null, contains_any, when_in_order
from lotweave.functions.geometry import let


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def compatibility_use(value: Column) -> Column:
    text = F.replace(F.lower(F.trim(value.cast("string"))), F.lit(" "), F.lit("_"))
    known = {u: u for u in (*vocab.LAND_USES, "unknown")} | vocab.COMPATIBILITY_ALIASES
    return F.coalesce(_literal_map(known)[text], F.lit("unknown"))


def pair_score(left: Column, right: Column) -> Column:
    """Score of two normalised uses; the 25-entry table is a literal of fixed size."""
    entries = {}
    for (a, b), score in vocab.COMPATIBILITY_PAIRS.items():
        entries[f"{a}|{b}"] = score
        entries[f"{b}|{a}"] = score
    return F.coalesce(_literal_map(entries)[F.concat_ws("|", left, right)], F.lit(0.0))


def proximity_use(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    cases = [(contains_any(text, words), F.lit(use)) for use, words in vocab.PROXIMITY_USE_WORDS]
    return F.coalesce(when_in_order(cases), F.lit("unknown"))


def fold(value: Column) -> Column:
    """Lower case, ``&`` spelled out, spaces and hyphens to ``_``, other punctuation dropped."""
    text = F.replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(text, r"[\s-]+", "_"), r"[^a-z0-9_]", "")


def badge_fold(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.regexp_replace(text, r"[\s-]+", "_")


def comparison_use(value: Column) -> Column:
    """Green words win, then built words; other text passes through; empty stays empty."""
    text = fold(value)
    cases = [(contains_any(text, words), F.lit(use)) for use, words in vocab.COMPARISON_USE_WORDS.items()]
    return when_in_order(cases, text)


def map_use(value: Column) -> Column:
    """Residential words win; short forms accepted; unknown text is null."""
    text = fold(value)
    cases = []
    for use in vocab.LAND_USES:
        hit = contains_any(text, vocab.COMPARISON_USE_WORDS[use])
        if use in vocab.MAP_USE_EXACT:
            hit = hit | (text == vocab.MAP_USE_EXACT[use])
        cases.append((hit, F.lit(use)))
    return when_in_order(cases)


def map_use_code(value: Column) -> Column:
    code = value.try_cast("double")
    return when_in_order([(code == i, F.lit(u)) for i, u in enumerate(vocab.LAND_USES)])


def use_label(code: Column, labels: Sequence[str] = vocab.LAND_USES) -> Column:
    return when_in_order([(code == i, F.lit(u)) for i, u in enumerate(labels)])


def use_code(label: Column, labels: Sequence[str] = vocab.LAND_USES) -> Column:
    return when_in_order([(label == u, F.lit(i)) for i, u in enumerate(labels)])


def readable_use(value: Column) -> Column:
    text = fold(value)
    return (F.when(text == "green", "Green").when(text == "mixed_use", "Mixed Use")
            .otherwise(F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))))


def _keep(flags: dict[str, Column], labels: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(flags[u], F.lit(u)) for u in labels]))


def _nullif_empty(items: Column) -> Column:
    return let(items, lambda found: F.when(F.size(found) > 0, found))


def planner_allowed_uses(fields: Fields, labels: Sequence[str] = vocab.LAND_USES) -> Column:
    """Explicit list (commas or a JSON list), else zoning keywords by substring, else every label; label order kept.

    The keywords over-match (``i-`` hits "multi-family"); results depend on that.
    """
    explicit_text = F.coalesce(fields.get("allowed_uses"), F.lit(""))
    listed = F.when(F.trim(explicit_text).startswith("["), F.from_json(F.lower(explicit_text), "array<string>")).otherwise(F.split(F.lower(explicit_text), ","))
    words = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda t: F.trim(t))
    explicit = let(words, lambda tokens: _keep({u: F.array_contains(tokens, u) for u in labels}, labels))
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(fields.get(f), F.lit("")) for f in vocab.PLANNER_ZONING_FIELDS]))
    mixed = blob.contains("mixed")
    flags = {}
    for use in labels:
        hit = contains_any(blob, vocab.PLANNER_ZONING_KEYWORDS[use]) if use in vocab.PLANNER_ZONING_KEYWORDS else F.lit(False)
        flags[use] = (hit | mixed) if use in ("residential", "commercial") else hit
    inferred = _keep(flags, labels)
    everything = F.array(*[F.lit(u) for u in labels])
    return F.coalesce(_nullif_empty(explicit), _nullif_empty(inferred), everything)


def _split_items(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[,;|]")


def _any_item(items: Column, test) -> Column:
    return F.exists(items, test)


def comparison_allowed_uses(fields: Fields) -> Column:
    """Explicit lists, else zoning text; null means unknown, not "all"."""
    def parse(items: Column, also_mixed: Column) -> Column:
        mixed = _any_item(items, lambda i: i.contains("mixed")) | also_mixed
        flags = {u: F.array_contains(items, u) for u in vocab.LAND_USES}
        flags["residential"] = flags["residential"] | mixed
        flags["commercial"] = flags["commercial"] | mixed
        return _keep(flags, vocab.LAND_USES)

    def uses(text: Column, also_mixed: Column) -> Column:
        return _nullif_empty(let(F.transform(_split_items(text), comparison_use), lambda items: parse(items, also_mixed)))

    explicit = [uses(fields.get(k), F.lit(False)) for k in ("allowed_uses", "ALLOWED_USES")]
    mixed_word = r"\bmixed\b|\bmixed_use\b|\bmixed-use\b"
    return F.coalesce(*explicit, let(_zoning_blob(fields), lambda blob: uses(blob, blob.rlike(mixed_word))))


def _zoning_blob(fields: Fields) -> Column:
    parts = [F.coalesce(fields.get(k), F.lit("")) for k in vocab.COMPARISON_ZONING_FIELDS]
    return F.lower(F.concat_ws(" ", *parts))


def report_allowed_uses(fields: Fields) -> Column:
    """Report variant: short codes and word-boundary zoning patterns as well."""
    def flagged(items: Column) -> dict[str, Column]:
        mixed = _any_item(items, lambda i: i.contains("mixed"))
        return {
            "residential": mixed | _any_item(items, lambda i: i.contains("residential") | (i == "r") | i.startswith("rs")),
            "commercial": mixed | _any_item(items, lambda i: i.contains("commercial") | (i == "c")),
            "industrial": _any_item(items, lambda i: i.contains("industrial") | (i == "i")),
            "green": _any_item(items, lambda i: contains_any(i, ("green", "open_space", "park", "conservation"))),
        }

    def uses(text: Column, merged=lambda flags: flags) -> Column:
        items = F.transform(_split_items(text), fold)
        return _nullif_empty(let(items, lambda i: _keep(merged(flagged(i)), vocab.LAND_USES)))

    patterns = {
        "residential": r"\brs\b|\brm\b|\br-\b|residential",
        "commercial": r"\bcc\b|\bcn\b|\bc-\b|commercial|retail|office",
        "industrial": r"\bil\b|\bih\b|\bi-\b|industrial|manufacturing|warehouse",
        "green": r"open space|open_space|\bos\b|park|conservation|green|agri",
    }

    def zoned(blob: Column) -> Column:
        def merged(flags: dict[str, Column]) -> dict[str, Column]:
            out = {u: flags[u] | blob.rlike(p) for u, p in patterns.items()}
            return out | {u: out[u] | blob.contains("mixed") for u in ("residential", "commercial")}
        return uses(blob, merged)

    explicit = [uses(fields.get(k)) for k in ("allowed_uses", "ALLOWED_USES", "permitted_uses", "zoning_allowed_uses")]
    return F.coalesce(*explicit, let(_zoning_blob(fields), zoned))


def change_class(before: Column, after: Column) -> Column:
    built_before, built_after = before.isin(*vocab.BUILT_USES), after.isin(*vocab.BUILT_USES)
    return (F.when(before.isNull() | after.isNull(), "missing")
            .when(before == after, "unchanged")
            .when(built_before & (after == "green"), "built_to_green")
            .when((before == "green") & built_after, "green_to_built")
            .when(built_before & built_after, "built_to_built")
            .otherwise("other_change"))


def mix_from_text(text: Column) -> dict[str, Column]:
    """Shares named in free text; the rest is spread over unnamed uses by the default shares."""
    lowered = F.lower(text)
    named = {}
    for use in vocab.LAND_USES:
        hits = F.regexp_extract_all(lowered, F.lit(rf"(\d+)\s*%\s*{use}"), F.lit(1))
        last = F.try_element_at(hits, F.lit(-1)).cast("double") / 100
        named[use] = F.when(last.isNotNull(), F.least(last, F.lit(1.0)))
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in named.values()])
    left = F.greatest(F.lit(0.0), F.lit(1.0) - total)
    open_share = reduce(lambda a, b: a + b, [
        F.when(named[u].isNull(), F.lit(vocab.TEXT_MIX_DEFAULTS[u])).otherwise(0.0) for u in vocab.LAND_USES])
    none_named = reduce(lambda a, b: a & b, [c.isNull() for c in named.values()])
    return {
        u: F.when(none_named, F.lit(vocab.TEXT_MIX_DEFAULTS[u])).otherwise(
            F.coalesce(named[u], left * (F.lit(vocab.TEXT_MIX_DEFAULTS[u]) / open_share)))
        for u in vocab.LAND_USES
    }


def objective_meaning(name: Column) -> tuple[Column, Column]:
    """(label, explanation) of an objective name."""
    text = F.lower(name)
    labels, texts = [], []
    for mode, tokens, label, explanation in vocab.OBJECTIVE_MEANINGS:
        tests = [text.contains(t) for t in tokens]
        hit = reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests)
        labels.append((hit, F.lit(label)))
        texts.append((hit, F.lit(explanation)))
    plain = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    return when_in_order(labels, plain), when_in_order(texts, F.lit(vocab.OBJECTIVE_DEFAULT_TEXT))


def first_text(fields: Fields, names: Sequence[str]) -> Column:
    return F.coalesce(*[blank_to_null(fields.get(n)) for n in names])
