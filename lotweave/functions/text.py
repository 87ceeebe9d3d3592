"""Regulation text rules and display formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import contains_any, kept, when_in_order


def zone_category(code: Column) -> Column:
    cases = [(code.rlike(p), F.lit(name)) for name, p in vocab.ZONE_PATTERNS]
    return F.coalesce(when_in_order(cases), F.lit("Unknown"))


def zone_categories(text: Column) -> Column:
    """Comma list of every category found, in table order."""
    return F.concat_ws(",", *[F.when(text.rlike(p), F.lit(name)) for name, p in vocab.ZONE_PATTERNS])


def section_number(text: Column) -> Column:
    return F.coalesce(*[
        F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in vocab.SECTION_PATTERNS])


def markers_found(text: Column, markers, over=lambda found: found) -> Column:
    """How many of the markers the text holds; ``over`` may be an aggregate that looks at many texts."""
    return reduce(lambda a, b: a + b, [F.coalesce(over(F.lower(text).contains(m).cast("int")), F.lit(0)) for m in markers])


def document_jurisdiction(file_name: Column, sample: Column) -> Column:
    """File name decides first, then the markers found in the text; a tie is Unknown."""
    return marked_jurisdiction(file_name, markers_found(sample, vocab.COUNTY_MARKERS), markers_found(sample, vocab.CITY_MARKERS))


def marked_jurisdiction(file_name: Column, county: Column, city: Column) -> Column:
    name = F.lower(file_name)
    return (F.when(contains_any(name, ("county", "unincorporated")), vocab.COUNTY)
            .when(contains_any(name, ("municipal", "city", "chapter")), vocab.CITY)
            .when(county > city, vocab.COUNTY).when(city > county, vocab.CITY).otherwise("Unknown"))


def jurisdiction_filter(jurisdiction: Column) -> Column:
    text = F.upper(jurisdiction)
    return (F.when(text.contains("COUNTY"), vocab.COUNTY)
            .when(text.contains("CITY") | text.contains("SAN DIEGO"), vocab.CITY))


def zone_filter(code: Column) -> Column:
    category = zone_category(F.coalesce(code, F.lit("")))
    return F.when(category != "Unknown", category)


def retrieval_query(question: Column, jurisdiction: Column, code: Column, plan_use: Column) -> Column:
    j, z, g = (F.coalesce(c, F.lit("")) for c in (jurisdiction, code, plan_use))
    upper = F.upper(j)
    category = zone_category(z)
    hints = kept(
        F.when(upper.contains("COUNTY"), F.lit("county zoning ordinance"))
        .when(upper.contains("CITY") | upper.contains("SAN DIEGO"), F.lit("municipal code"))
        .when(j != "", F.concat(F.lit("jurisdiction: "), j)),
        F.when(z != "", F.concat(z, F.lit(" zone"))),
        F.when(category != "Unknown", F.concat(F.lower(category), F.lit(" use"))),
        F.when(g != "", F.concat(F.lit("general plan: "), g)))
    return F.when(F.size(hints) > 0, F.concat(question, F.lit(" ("), F.array_join(hints, ", "), F.lit(")"))).otherwise(question)


def routes(query: Column) -> Column:
    """Ordered tool list named by the words of a question."""
    text = F.lower(query)
    hits = kept(*[F.when(contains_any(text, words), F.lit(tool)) for tool, words in vocab.ROUTE_WORDS])
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("analyze_environment")))


def clean_answer(raw: Column) -> Column:
    """Drop question and notice lines, strip bold citation marks, trim."""
    lines = F.filter(
        F.split(raw, "\n"),
        lambda line: ~F.trim(line).rlike(r"^\*?\*?Question:") & ~line.contains(vocab.NOTICE_TEXT)
        & ~F.trim(line).startswith("*("))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(joined, r"\*\*\[.*?\]\*\*\s*", ""), r"^\s+|\s+$", "")


def citation(jurisdiction: Column, section: Column, source: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """``[jurisdiction §section, source p.a-b]``; the page part only when pages are given."""
    pieces = [F.lit("["), jurisdiction, F.when(section != "", F.concat(F.lit(" §"), section)).otherwise(""), F.lit(", "), source]
    if start is not None:
        pieces += [F.lit(" p."), start.cast("string"), F.lit("-"), end.cast("string")]
    return F.concat(*pieces, F.lit("]"))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_area(value: Column) -> Column:
    """km2 from a million up, hectares from ten thousand up, else whole m2; a dash when not positive."""
    return (F.when(value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf")), "—")
            .when(value >= 1_000_000, F.concat(_trim_zeros(F.format_number(value / 1_000_000, 2)), F.lit(" km²")))
            .when(value >= 10_000, F.concat(_trim_zeros(F.format_number(value / 10_000, 2)), F.lit(" ha")))
            .otherwise(F.concat(F.format_number(value, 0), F.lit(" m²"))))


def format_percent(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(
        F.concat(_trim_zeros(F.format_number(value * 100, 1)), F.lit("%")))


def preview_ids(ids: Column, shown: int = 3) -> Column:
    more = F.size(ids) - shown
    text = F.array_join(F.slice(ids, 1, shown), ", ")
    return F.when(F.size(ids) == 0, "—").when(more > 0, F.concat(text, F.lit(" +"), more.cast("string"))).otherwise(text)
