"""Benchmark decontamination by winnowing.

Of every 6 consecutive 5-gram hashes of a text the smallest is kept as a fingerprint. Two texts that
share 10 consecutive words share 6 consecutive 5-grams, so they share a kept one: no span of 10 words
can be missed. Items shorter than that are one window of their own length, found through the hash of
each run of that length. Document fingerprints meet the benchmark's in a join; each hit is extended to
the windows of 10 words around it, whose hashes meet the benchmark's windows in a second join.

The benchmark's fingerprints are counted and broadcast up to ``MOST_BROADCAST`` rows; beyond that both
joins are ordinary ones. Texts are tokenised in Arrow batches; only documents with a hit are read twice.

Defined results. Null and word-less texts have no words and no hits; an empty benchmark hits nothing.
Rows that repeat both doc_id and text give one result row. Repeated items count once per item_id; a
null item_id is not counted as an item, but its words hit. Extra columns are ignored by ``scan`` and
carried by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import ALNUM, hash_words, lean, run_hashes, signed, text_column, text_slices, written

WINDOW, GRAM = 10, 5
GUARD = WINDOW - GRAM + 1
MOST_BROADCAST = 1_000_000


def word_lists(column: pa.Array):
    """Per text the hashes of its words."""
    for _, _, data, offsets in text_slices(column):
        words, counts = hash_words(data, offsets, ALNUM)
        at = 0
        for n in counts:
            yield words[at:at + n]
            at += n


def winnow(grams: np.ndarray, guard: int = GUARD) -> np.ndarray:
    """Positions that are the smallest (the last of equals) of some ``guard`` consecutive hashes."""
    if len(grams) < guard:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, guard)
    best = guard - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(len(views)) + best)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, span (10, or the length of a shorter item), window hash, and the fingerprints inside it as rows."""
    def run(batches):
        for batch in batches:
            item, span, window, print_ = [], [], [], []
            for i, words in zip(batch.column(0).to_pylist(), word_lists(text_column(batch, "text")), strict=True):
                n = min(len(words), WINDOW)
                if not n:
                    continue
                hashes = signed(run_hashes(words, n))
                if n == WINDOW:
                    grams = run_hashes(words, GRAM)
                    chosen = signed(grams[winnow(grams)])
                else:
                    chosen = hashes
                for values, rows in ((hashes, (window, print_)), (chosen, (print_, window))):
                    rows[0].extend(values.tolist())
                    rows[1].extend([None] * len(values))
                    item.extend([i] * len(values))
                    span.extend([n] * len(values))
            yield _batch({"item_id": pa.array(item, pa.string()), "span": pa.array(span, pa.int32()),
                          "window": pa.array(window, pa.int64()), "print": pa.array(print_, pa.int64())})

    texts = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(lean(run), "item_id string, span int, window bigint, print bigint")


def _fingerprints(docs: DataFrame, short: list[int]) -> DataFrame:
    """Rows (doc_id, text_key, n_words, pos, span, print); one row per document has a null pos."""
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            counts, rows, spots, spans, prints = [], [], [], [], []
            for i, words in enumerate(word_lists(text_column(batch, "text"))):
                counts.append(len(words))
                grams = run_hashes(words, GRAM)
                found = [(WINDOW, at, grams[at])] if len(at := winnow(grams)) else []
                found += [(n, np.arange(len(h)), h) for n in short if len(h := run_hashes(words, n))]
                for n, at, h in found:
                    rows.append(np.full(len(at), i, np.int32))
                    spots.append(at.astype(np.int32))
                    spans.append(np.full(len(at), n, np.int32))
                    prints.append(signed(h))
            none = np.zeros(0, np.int32)
            counts = np.array(counts, np.int32)
            head = pa.nulls(len(counts), pa.int32())
            # a head row's print only spreads it over the join's tasks
            yield _batch({"doc_id": ids, "text_key": batch.column(1), "n_words": pa.array(counts, pa.int32()), "pos": head, "span": head,
                          "print": pa.array(keys ^ np.arange(len(keys)), pa.int64())})
            rows = np.concatenate([none, *rows])
            yield _batch({"doc_id": ids.take(pa.array(rows)), "text_key": pa.array(keys[rows], pa.int64()), "n_words": pa.array(counts[rows], pa.int32()),
                          "pos": pa.array(np.concatenate([none, *spots])), "span": pa.array(np.concatenate([none, *spans])),
                          "print": pa.array(np.concatenate([np.zeros(0, np.int64), *prints]), pa.int64())})

    schema = "doc_id bigint, text_key bigint, n_words int, pos int, span int, print bigint"
    return docs.mapInArrow(lean(run), schema)


def _extend(batches):
    """(doc_id, text_key, text, spots) to the hashed windows around every spot."""
    for batch in batches:
        ids, keys, starts, spans, hashes = [], [], [], [], []
        spots = batch.column(3).to_pylist()
        doc_ids, text_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, words in enumerate(word_lists(text_column(batch, "text"))):
            by_span: dict[int, list[int]] = {}
            for spot in spots[i]:
                by_span.setdefault(spot["span"], []).append(spot["pos"])
            for span, at in by_span.items():
                every = run_hashes(words, span)
                at = np.array(at)
                if span == WINDOW:
                    at = (at[:, None] - np.arange(GUARD)[None, :]).ravel()
                at = np.unique(at[(at >= 0) & (at < len(every))])
                ids += [doc_ids[i]] * len(at)
                keys += [text_keys[i]] * len(at)
                starts += at.tolist()
                spans += [span] * len(at)
                hashes += signed(every[at]).tolist()
        yield _batch({"doc_id": pa.array(ids, pa.int64()), "text_key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int32()),
                      "span": pa.array(spans, pa.int32()), "window": pa.array(hashes, pa.int64())})


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted (start, span)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, s):
        stop = s["start"] + s["span"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], stop).alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"].cast("long"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, spans (start, span of the hit windows) and item_ids per document."""
    bench = written(benchmark_windows(benchmark), "benchmark")
    prints = bench.filter("print is not null").select("print", "span").distinct()
    windows = bench.filter("window is not null").select("window", "span", "item_id").distinct()
    few = bench.count() <= MOST_BROADCAST
    if few:
        prints, windows = F.broadcast(prints), F.broadcast(windows)
    short = sorted(r[0] for r in bench.filter(F.col("span") < WINDOW).select("span").distinct().collect())  # nine values at most

    texts = docs.select(F.col("doc_id").cast("bigint"), _text_key(F.col("text")).alias("text_key"), F.col("text").cast("string"))
    marks = _fingerprints(texts, short)
    found = marks.join(prints.withColumn("known", F.lit(True)), ["print", "span"], "left").filter("pos is null or known")
    spot = F.when(F.col("pos").isNotNull(), F.struct("pos", "span"))
    spots = written(found.groupBy("doc_id", "text_key").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(spot).alias("spots")), "spots")
    hit = spots.filter(F.size("spots") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spots")
    near = texts.join(hit, texts["doc_id"].eqNullSafe(hit["_id"]) & (texts["text_key"] == hit["_key"]))
    near = near.select("doc_id", "text_key", "text", "spots").mapInArrow(lean(_extend), "doc_id bigint, text_key bigint, start int, span int, window bigint")
    hits = near.join(windows, ["window", "span"]).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.sort_array(F.collect_set(F.struct("start", "span"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    all_ = spots.join(hits, spots["doc_id"].eqNullSafe(hits["_id"]) & (spots["text_key"] == hits["_key"]), "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return all_.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    hit = scan(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    # the row travels in one struct, so that no column of the documents meets a name used here
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(F.col("text")).alias("text_key"))
    return keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["_id"]) & (keyed["text_key"] == hit["_key"]), "left_anti").select("row.*")
