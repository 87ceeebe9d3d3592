"""Language of texts by fusing evidence in log space.

Text: a naive Bayes model over hashed byte triples, trained on labelled documents (at most about
``SAMPLE`` of each language), its sum scaled to ``WORTH`` triples at most, since neighbouring triples
are not independent. Markup: the declared language is right with probability ``TRUST``. Address: a
country suffix speaks for its language. Host: a prior smoothed from host to domain to all, from sums
of text posteriors by grouped aggregation; a row's own share is taken out. A host with any share of
the rows is aggregated before the shuffle and met again without a shuffle (see ``common.lookup``).

Defined results. A null or empty text has no text evidence; a missing declaration, suffix or host
adds none. A row with no evidence gets the overall prior's best language. Ties go to the language
first in order. An empty table gives no rows; without labelled documents the language is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import lookup, text_column, text_slices, written

SAMPLE, WORTH, TRUST, SUFFIX_TRUST, STRENGTH = 1_000, 60.0, 0.9, 0.7, 20.0
BINS = 1 << 16
#: Country suffixes that speak for a language (fixed values).
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def _bins(data: np.ndarray) -> np.ndarray:
    low = data.astype(np.uint32)
    low[(low >= 65) & (low < 91)] += 32
    mixed = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    return (mixed >> np.uint32(16)).astype(np.int32)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probability of each bin in each language, from (lang, text)."""
    known = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((BINS, 0), np.float32)
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, min(1.0, SAMPLE / counts[name])).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches):
        total = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                if len(raw) > 2:
                    total[lang] = total.get(lang, 0) + np.bincount(_bins(raw), minlength=BINS)
        for lang, seen in total.items():
            hit = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(seen[hit])], names=["lang", "bin", "n"])

    rows = drawn.select("lang", "text").mapInArrow(run, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BINS, len(names)), 0.5)  # at most BINS rows a language
    for j, name in enumerate(names):
        own = rows[rows["lang"] == name]
        table[own["bin"].to_numpy(), j] += own["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_scores(items: DataFrame, table: np.ndarray) -> DataFrame:
    """``items`` without the text, with ``scores``: scaled log likelihood in each language."""
    rest = [f for f in items.schema.fields if f.name != "text"]
    n_lang = table.shape[1]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "scores array<double>"])

    def run(batches):
        for batch in batches:
            parts = []
            for first, end, data, offsets in text_slices(text_column(batch, "text"), 1 << 18):
                sums, count = np.zeros((end - first, n_lang)), np.maximum(np.diff(offsets) - 2, 0)
                if len(data) > 2:
                    scores = table[_bins(data)]
                    whole = np.concatenate([np.zeros((1, n_lang)), np.cumsum(scores, axis=0, dtype=np.float64)])
                    at = np.minimum(offsets[:-1], len(whole) - 1)
                    sums = whole[np.minimum(at + count, len(whole) - 1)] - whole[at]
                parts.append(sums * (np.minimum(WORTH, count) / np.maximum(count, 1))[:, None])
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_lang), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in rest], rows], names=[*[f.name for f in rest], "scores"])

    return items.mapInArrow(run, schema)


def posterior(scores: Column) -> Column:
    """Probabilities out of log scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def markup_language(html: Column) -> Column:
    """Two or three letters of the ``lang`` of the html element, lower case; null without one."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(F.length(found) > 0, found)


def plain_text(html: Column) -> Column:
    """Page text without tags, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<[^>]*+>|&#?\w{1,9};", " ")


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(F.length(found) > 0, found)


def fuse(items: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``items`` (text, declared, suffix, host, domain and any ids) with ``lang`` and ``probability`` in place of the evidence."""
    ids = [c for c in items.columns if c not in ("text", "declared", "suffix", "host", "domain")]
    if not names:
        return items.select(*ids, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    n = len(names)
    scored = written(text_scores(items, table).withColumn("post", posterior(F.col("scores"))), "language-scores")

    def sums(keys):
        return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col("post")[i]).alias(f"p{i}") for i in range(n)])

    total = sums([]).first()
    rows = total["size"]
    if not rows:
        return scored.select(*ids, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    overall = F.array(*[F.lit((total[f"p{i}"] + 1) / (rows + n)) for i in range(n)])
    out = scored
    for level in ("domain", "host"):
        groups = written(sums([level]).select(level, "size", F.array(*[f"p{i}" for i in range(n)]).alias(f"{level}_sums")), f"{level}-sums")
        out = lookup(out, groups, [level], [f"{level}_sums"], "size", rows)

    def smoothed(level, base):  # the row's own share is taken out; no key, no evidence
        own = F.zip_with(F.col(f"{level}_sums"), "post", lambda s, p: F.greatest(s - p, F.lit(0.0)))
        mass = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col(level).isNull(), base).otherwise(F.zip_with(own, base, lambda s, b: (s + STRENGTH * b) / (mass + STRENGTH)))

    prior = smoothed("host", smoothed("domain", overall))
    code = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    spoken = code[F.col("suffix")]

    def speaks(value, name, trust):
        return F.when(value.isNull() | ~value.isin(names), 0.0).when(value == name, float(np.log(trust))).otherwise(float(np.log((1 - trust) / max(1, n - 1))))

    evidence = F.array(*[F.col("scores")[i] + F.log(F.col("prior")[i]) + speaks(F.col("declared"), names[i], TRUST) + speaks(spoken, names[i], SUFFIX_TRUST) for i in range(n)])
    fused = out.withColumn("prior", prior).withColumn("post", posterior(evidence))
    best = F.array_max("post")
    return fused.select(*ids, F.array(*map(F.lit, names))[F.array_position("post", best).cast("int") - 1].alias("lang"), best.alias("probability"))
