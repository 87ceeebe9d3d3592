"""Regulation text: section split, chunking, metadata, vector retrieval and answers.

Chunking is a fold over a document's paragraphs, yet a document may hold most of the corpus,
so it is not folded in one task. A chunk closes at the first paragraph whose running length
reaches 1200 characters past the previous close (1500 minus the 300 kept as overlap). Where a
block of text is entered only matters through its first close, and only the paragraphs in the
first 1200 characters of a block can be that one - two dozen at most. Each block therefore
reports, for each possible first close, its last close; chaining these few rows per block
tells where every block is really entered, and then all blocks finish on their own. A task takes
the blocks in sorted order and many at a time, so small blocks cost no more than large ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import text as tx
from lotweave.functions import vocab
from lotweave.functions.coerce import kept
from lotweave.operators.prefix import running_sum
from lotweave.operators.ranking import top_k
from lotweave.session import cut_lineage

CHUNK_CHARS = 1500
OVERLAP = 300
MIN_PARAGRAPH = 50
MIN_TAIL = 100
JOINT = "\n\n"
BLOCK_CHARS = 1 << 26
MOST_BROADCAST = 10_000  # documents whose few facts are sent to all tasks


def split_sections(text: Column) -> Column:
    """Pieces of a page: each section marker stays with the text before it; no marker = blank lines."""
    marked = F.regexp_replace(text, vocab.SECTION_MARK, "$1\u0001")
    return F.when(text.rlike(vocab.SECTION_MARK), F.split(marked, "\u0001")).otherwise(F.split(text, JOINT))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(source, page_num, para_no, para, width): trimmed pieces of at least 50 characters."""
    pieces = pages.select("source", "page_num", F.posexplode(split_sections(F.col("text"))).alias("para_no", "raw"))
    trimmed = pieces.select("source", "page_num", "para_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("para"))
    return trimmed.filter(F.length("para") >= MIN_PARAGRAPH).withColumn("width", (F.length("para") + len(JOINT)).cast("bigint"))


def _whole_runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by ``keys`` in frames that hold whole runs of equal keys, and where each run begins."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            at = pdf[k].to_numpy()
            new[1:] |= at[1:] != at[:-1]
        first = np.concatenate([[0], np.flatnonzero(new)])
        held = pdf.iloc[first[-1]:]
        if len(first) > 1:
            yield pdf.iloc[:first[-1]], first[:-1]
    if held is not None and len(held):
        yield held, np.zeros(1, dtype=int)


def _next_closes(pdf: pd.DataFrame, first: np.ndarray, step: int, block_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of whole blocks: its block's run, the run's end, and the row that closes next after it (from that end on: none).

    Blocks lie behind each other on one line, ``block_chars + step`` apart, so one search serves all.
    """
    run = np.repeat(np.arange(len(first)), np.diff(first, append=len(pdf)))
    line = run * (block_chars + step + 1) + (pdf["s"].to_numpy() - pdf["block"].to_numpy() * block_chars)
    return run, np.append(first[1:], len(pdf))[run], np.searchsorted(line, line + step)


def _block_exits(step: int, origin: int, block_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, first in _whole_runs(batches, ("source", "block")):
            s, start = pdf["s"].to_numpy(), pdf["block"].to_numpy() * block_chars
            _, end, follow = _next_closes(pdf, first, step, block_chars)
            last = np.where(follow < end, follow, np.arange(len(s)))
            while True:  # each round doubles how far a row sees
                beyond = last[last]
                if (beyond == last).all():
                    break
                last = beyond
            before = np.concatenate([[0], s[:-1]])
            before[first] = start[first] - 1
            entry = np.flatnonzero(before < start + step + origin)
            yield pd.DataFrame({"source": pdf["source"].to_numpy()[entry], "block": pdf["block"].to_numpy()[entry],
                                "first_close": s[entry], "last_close": s[last[entry]]})
    return run


def _chain(step: int, origin: int):
    """Walk the blocks of each document in order over their few entry rows; only one position is carried on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, at = None, origin
        for pdf, first in _whole_runs(batches, ("source", "block")):
            sources, firsts, lasts = pdf["source"].to_numpy()[first].tolist(), pdf["first_close"].tolist(), pdf["last_close"].tolist()
            opened = []
            for name, begin, end in zip(sources, first.tolist(), [*first[1:].tolist(), len(pdf)], strict=True):
                source, at = (source, at) if name == source else (name, origin)
                opened.append(at)
                hit = bisect_left(firsts, at + step, begin, end)
                at = lasts[hit] if hit < end else at
            yield pd.DataFrame({"source": sources, "block": pdf["block"].to_numpy()[first], "entered": opened})
    return run


def _assign(step: int, block_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, first in _whole_runs(batches, ("source", "block")):
            s, entered = pdf["s"].to_numpy(), pdf["entered"].to_numpy()
            run, end, follow = _next_closes(pdf, first, step, block_chars)
            reached = s >= entered + step
            head = reached.copy()  # the first close of each block, then all of them in step
            head[1:] &= ~(reached[:-1] & (run[1:] == run[:-1]))
            at, closed = np.flatnonzero(head), np.full(len(s), -1)
            while len(at):
                closed[at] = at
                at = follow[at[follow[at] < end[at]]]
            before = np.concatenate([[-1], np.maximum.accumulate(closed)[:-1]])
            opened = np.where(before >= first[run], s[before], entered)
            yield pd.DataFrame({"source": pdf["source"].to_numpy(), "s": s, "opened": opened})
    return run


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key in one task, sorted by ``order``.

    Dealt by a hash of the keys: a dealing by the keys of a join before it would be dropped, and the
    join may turn into a broadcast while the query runs, which leaves rows of a key in several tasks.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*order)


def _beside_texts(rows: DataFrame) -> DataFrame:
    """A row per document to be joined to texts: sent to all tasks when counted and few, so that the texts stay where they are."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def chunk_texts(pages: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(source, start_page, end_page, text): the chunks of every document.

    Paragraphs are joined by a blank line until ``chunk_chars`` is reached; the last ``overlap``
    characters open the next chunk; the rest of a document is kept from 100 characters on, even
    when it is only overlap.
    """
    step = chunk_chars - overlap
    origin = overlap + len(JOINT)  # the first chunk has no overlap before it
    # a paragraph is known by its place and its digest until its chunk is; texts move twice, to their chunk's number and to their chunk
    known = ["source", "page_num", "para_no", "_own"]
    para = paragraphs(pages).withColumn("_own", F.xxhash64("source", "page_num", "para_no", "para", "width"))
    places = running_sum(para.select(*known, "width"), ["source"], "page_num", "width", "s", tiebreak=["para_no", "_own"])
    # positions only, a few bytes per paragraph: kept once instead of splitting the texts for every step
    placed = cut_lineage(places.select(*known, "s", F.floor(F.col("s") / block_chars).alias("block")))
    marks = placed.select("source", "s", "block")
    exits = _in_order(marks, ["source", "block"], ["source", "block", "s"]).mapInPandas(
        _block_exits(step, origin, block_chars), "source string, block bigint, first_close bigint, last_close bigint")
    entered = _in_order(exits, ["source"], ["source", "block", "first_close"]).mapInPandas(
        _chain(step, origin), "source string, block bigint, entered bigint")
    opened = _in_order(marks.join(entered, ["source", "block"]), ["source", "block"], ["source", "block", "s"]).mapInPandas(
        _assign(step, block_chars), "source string, s bigint, opened bigint")
    # a set: equal paragraphs of equal pages meet each other's positions, and each position counts once
    body = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("s", "para"))), lambda p: p["para"]), JOINT)
    # no position is null, but saying so here makes the plans of both readers of the chunks equal, and the texts move once for both
    chosen = cut_lineage(placed.drop("block").join(opened, ["source", "s"])).filter(F.col("source").isNotNull() & F.col("opened").isNotNull())
    parts = para.select(*known, "para").join(chosen, known).groupBy("source", "opened").agg(
        body.alias("body"), F.max("s").alias("close"), F.max_by("page_num", "s").alias("last_page"))
    ends = _beside_texts(pages.groupBy("source").agg(F.max("page_num").alias("doc_last")))
    done = F.col("close") - F.col("opened") >= step
    before = parts.filter(done).select("source", F.col("close").alias("opened"), F.substring("body", -overlap, overlap).alias("lead"),
                                       F.col("last_page").alias("start_page"))
    follow = parts.join(before, ["source", "opened"], "left").join(ends, "source").select(
        "source", F.coalesce("start_page", F.lit(1)).alias("start_page"),
        F.when(done, F.col("last_page")).otherwise(F.col("doc_last")).alias("end_page"),
        F.when(F.col("lead").isNotNull(), F.concat("lead", F.lit(JOINT), "body")).otherwise(F.col("body")).alias("text"),
        done.alias("full"))
    only_lead = before.join(parts.select("source", "opened"), ["source", "opened"], "left_anti").join(ends, "source").select(
        "source", "start_page", F.col("doc_last").alias("end_page"), F.col("lead").alias("text"), F.lit(False).alias("full"))
    return follow.unionByName(only_lead).filter(F.col("full") | (F.length("text") >= MIN_TAIL)).drop("full")


def chunk_id(stem: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(stem, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def jurisdictions(pages: DataFrame) -> DataFrame:
    """(source, jurisdiction): from the file name, else from the markers on any of its pages."""
    found = pages.groupBy("source").agg(*[tx.markers_found(F.col("text"), markers, F.max).alias(name)
                                          for name, markers in (("county", vocab.COUNTY_MARKERS), ("city", vocab.CITY_MARKERS))])
    return found.select("source", tx.marked_jurisdiction(F.col("source"), F.col("county"), F.col("city")).alias("jurisdiction"))


def chunks(pages: DataFrame, ingested=None, **sizes) -> DataFrame:
    """Chunk table with ids and metadata."""
    made = chunk_texts(pages, **sizes).join(_beside_texts(jurisdictions(pages)), "source", "left")
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    text = F.col("text")
    return made.select(
        chunk_id(stem, F.col("start_page"), F.col("end_page"), text).alias("chunk_id"), "text", "source", "jurisdiction",
        tx.zone_categories(text).alias("zone_categories"), F.coalesce(tx.section_number(text), F.lit("")).alias("section"),
        "start_page", "end_page", (F.current_timestamp() if ingested is None else F.lit(ingested).cast("timestamp")).alias("ingested_ts"))


def ingest(pages: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Chunks to append; an already stored id is skipped."""
    from lotweave.operators.zoning import append_new

    fresh = chunks(pages)
    return fresh if stored is None else append_new(stored, fresh)


# ---- retrieval ---------------------------------------------------------------------------

PIVOTS = 64  # most chunk vectors that others are measured against; they and the rings bound what a question carries
RINGS = 16  # most equal widths of distance around a pivot
BLOCK_ROWS = 8192  # chunks of one ring compared in one piece
QUERY_BLOCK = 2048  # questions compared with a block in one piece


def _placed(v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in the space where the triangle inequality holds (the unit sphere for cosine), and which of them have a place."""
    if metric != "cosine":
        return v, np.ones(len(v), dtype=bool)
    size = np.sqrt((v * v).sum(axis=1))
    return v / np.where(size > 0, size, 1.0)[:, None], size > 0


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def pivot_index(store: DataFrame, metric: str = "l2") -> tuple[DataFrame, np.ndarray]:
    """(chunk_id, embedding, jurisdiction, bucket, ring, sub, dist) and the pivots.

    A chunk lies in the bucket of its nearest pivot, in the ring of its distance, and in one of as many
    blocks of the ring as its count asks for. There are no more pivots and rings than full blocks to tell apart. Zero vectors have no direction: bucket -1 for cosine.
    """
    rows = cut_lineage(store.select("chunk_id", "embedding", "jurisdiction").filter(F.col("embedding").isNotNull()))
    pieces = -(-rows.count() // BLOCK_ROWS)
    first = rows.select("embedding", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(min(PIVOTS, max(1, pieces))).collect()
    if not first:
        return rows.selectExpr("*", "0 AS bucket", "0 AS ring", "0L AS sub", "0D AS dist"), np.zeros((0, 0))
    pivots, usable = _placed(np.array([r["embedding"] for r in first], dtype=float), metric)
    pivots = pivots[usable] if usable.any() else pivots

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, there = _placed(_vectors(pdf["embedding"]), metric)
                bucket = ((pivots * pivots).sum(axis=1)[None, :] - 2.0 * (v @ pivots.T)).argmin(axis=1)
                dist = np.linalg.norm(v - pivots[bucket], axis=1)
                yield pdf.assign(bucket=np.where(there, bucket, -1), dist=np.where(there, dist, 0.0))

    near = cut_lineage(rows.mapInPandas(nearest, _schema_of(rows) + ", bucket int, dist double"))
    span = near.groupBy("bucket").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"),
                                      F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(RINGS)).alias("rings"))  # a row per pivot
    width = (F.col("hi") - F.col("lo")) / F.col("rings")
    ring = F.when(width > 0, F.least(F.floor((F.col("dist") - F.col("lo")) / width), F.col("rings") - 1)).otherwise(0).cast("int")
    ringed = near.join(F.broadcast(span), "bucket").withColumn("ring", ring).drop("lo", "hi", "rings")
    blocks = ringed.groupBy("bucket", "ring").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))  # a row per ring
    cut = ringed.join(F.broadcast(blocks), ["bucket", "ring"]).withColumn("sub", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")))
    return cut.drop("blocks"), pivots


def _schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def needed_rings(questions: DataFrame, index: DataFrame, pivots: np.ndarray, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, embedding, jurisdiction, bucket, ring): rings that may hold one of the k nearest chunks of a question.

    Rings in order of their farthest possible chunk reach k chunks at some distance; a ring whose nearest
    possible chunk is farther cannot matter. Counts and radii are those of the jurisdiction that is asked for.
    """
    rings = index.groupBy("jurisdiction", "bucket", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    one = F.collect_list(F.struct("bucket", "ring", "n", "least", "most")).alias("rings")  # at most (PIVOTS + 1) * RINGS entries
    every = rings.groupBy("bucket", "ring").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    asked = questions.select("query_id", "embedding", "jurisdiction").filter(F.col("embedding").isNotNull())
    known = asked.join(rings.filter("jurisdiction is not null").groupBy("jurisdiction").agg(one), "jurisdiction").select("query_id", "embedding", "jurisdiction", "rings")
    free = asked.filter("jurisdiction is null").crossJoin(F.broadcast(every.agg(one)))  # one row

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            if len(pdf):
                q, there = _placed(_vectors(pdf["embedding"]), metric)
                far = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (q @ pivots.T), 0.0))
                slack = 1e-6 * (1.0 + np.abs(q).max(axis=1) + np.abs(pivots).max()) * np.sqrt(q.shape[1])
                for i, rings in enumerate(pdf["rings"]):
                    bucket, n = np.array([r["bucket"] for r in rings]), np.array([r["n"] for r in rings])
                    least, most = np.array([r["least"] for r in rings]), np.array([r["most"] for r in rings])
                    placeless = bucket < 0
                    to_pivot = np.where(placeless, 0.0, far[i, bucket])
                    lower = np.where(placeless, 0.0, np.maximum(to_pivot - most, least - to_pivot))
                    upper = np.where(placeless, 2.0, to_pivot + most)
                    order = np.argsort(upper)
                    reach = int(np.searchsorted(np.cumsum(n[order]), k))
                    bound = upper[order[reach]] + slack[i] if there[i] and reach < len(order) else np.inf
                    out.extend((i, rings[j]["bucket"], rings[j]["ring"]) for j in np.flatnonzero(lower <= bound))
            if out:
                at, buckets, found = zip(*out, strict=True)
                yield pdf[["query_id", "embedding", "jurisdiction"]].iloc[list(at)].assign(bucket=buckets, ring=found)

    return known.unionByName(free).mapInPandas(choose, _schema_of(asked) + ", bucket int, ring int")


def _nearest_in_block(k: int, metric: str):
    def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "chunk_id": block["chunk_id"].iloc[:0], "distance": np.zeros(0)})
        if asked.empty or block.empty:
            return none
        q, v = _vectors(asked["embedding"]), _vectors(block["embedding"])
        q_norm, v_norm, dots = (q * q).sum(axis=1), (v * v).sum(axis=1), q @ v.T
        if metric == "cosine":
            d = 1.0 - dots / (np.sqrt(q_norm)[:, None] * np.sqrt(v_norm)[None, :] + 1e-12)
        else:
            d = np.maximum(q_norm[:, None] + v_norm[None, :] - 2.0 * dots, 0.0)
        place, ids, parts = block["jurisdiction"].to_numpy(dtype=object), block["chunk_id"].to_numpy(), [none]
        for i, (query, wanted) in enumerate(zip(asked["query_id"], asked["jurisdiction"], strict=True)):
            usable = np.nonzero(place == wanted)[0] if isinstance(wanted, str) else np.arange(len(ids))
            row = d[i, usable]
            keep = np.arange(len(row)) if len(row) <= k else np.nonzero(row <= np.partition(row, k - 1)[k - 1])[0]
            parts.append(pd.DataFrame({"query_id": query, "chunk_id": ids[usable[keep]], "distance": row[keep]}))
        return pd.concat(parts[1:] or parts, ignore_index=True)
    return run


def nearest_chunks(questions: DataFrame, store: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, chunk_id, distance, rank): the k nearest per question, squared L2 by default.

    An exact search over a pivot index: a question meets only the rings that the triangle inequality
    leaves, in one pass for any number of questions. Blocks of chunks and slots of questions are of counted
    size, and each keeps its own k nearest per question (ties at the edge included), so no
    question-chunk product is ever written. Ties are settled by chunk id. Null vectors find and are
    found by nothing; empty tables give no rows.
    """
    index, pivots = pivot_index(store, metric)
    kinds = f"query_id {_type(questions, 'query_id')}, chunk_id {_type(store, 'chunk_id')}, distance double"
    if not len(pivots):
        return questions.sparkSession.createDataFrame([], kinds + ", rank int")
    needed = cut_lineage(needed_rings(questions, index, pivots, k, metric))
    slots = needed.groupBy("bucket", "ring").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("slots"))  # a row per ring
    key = ["bucket", "ring", "sub", "slot"]
    subs = index.groupBy("bucket", "ring").agg(F.max("sub").alias("last"))
    asked = needed.join(F.broadcast(slots), ["bucket", "ring"]).withColumn("slot", F.pmod(F.xxhash64("query_id"), F.col("slots"))).drop("slots")
    asked = asked.join(F.broadcast(subs), ["bucket", "ring"]).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).drop("last")
    blocks = index.join(F.broadcast(slots), ["bucket", "ring"]).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)))
    found = asked.groupBy(*key).cogroup(blocks.select(*key, "chunk_id", "embedding", "jurisdiction").groupBy(*key)).applyInPandas(_nearest_in_block(k, metric), kinds)
    return top_k(found, ["query_id"], ["distance", "chunk_id"], k)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def retrieve_candidates(questions: DataFrame, store: DataFrame, top: int = 4, metric: str = "l2") -> DataFrame:
    """Over-fetched hits max(3 top, 12) with score 1 - distance."""
    hits = nearest_chunks(questions, store, max(3 * top, 12), metric)
    return hits.withColumn("score", F.lit(1.0) - F.col("distance"))


def prefer_zone(hits: DataFrame, zone: str = "zone_filter") -> DataFrame:
    """Per question: hits whose category text holds the zone; all hits when none does or no zone is asked."""
    match = F.coalesce(F.col("zone_categories").contains(F.col(zone)), F.lit(False))
    any_match = hits.groupBy("query_id").agg(F.bool_or(match).alias("_any"))
    return hits.join(any_match, "query_id").filter(match | ~F.col("_any")).drop("_any")


def _diverse(top: int, trade: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        if len(pdf) <= top:
            order, score = list(range(len(pdf))), (1.0 - pdf["distance"]).to_numpy()
        else:
            score = 1.0 - np.clip(pdf["distance"].to_numpy(), 0.0, 1.0)
            v = np.stack(pdf["embedding"].to_numpy()).astype(float)
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
            order = pick_diverse(score, v @ v.T, top, trade)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "place": range(1, len(order) + 1),
                             "chunk_id": pdf["chunk_id"].to_numpy()[order], "score": score[order]})
    return run


def pick_diverse(relevance: np.ndarray, similarity: np.ndarray, top: int, trade: float) -> list[int]:
    """First the most relevant, then repeatedly the best of trade x relevance - (1 - trade) x closeness to a pick."""
    picked = [int(np.argmax(relevance))]
    while len(picked) < min(top, len(relevance)):
        gain = trade * relevance - (1 - trade) * similarity[:, picked].max(axis=1)
        gain[picked] = -np.inf
        picked.append(int(np.argmax(gain)))
    return picked


def rerank(hits: DataFrame, top: int = 4, trade: float = 0.4) -> DataFrame:
    """Diversity rerank per question. A group is one question's over-fetched hits, at most max(3 top, 12) rows."""
    q, c = _type(hits, "query_id"), _type(hits, "chunk_id")
    return hits.groupBy("query_id").applyInPandas(
        _diverse(top, trade), f"query_id {q}, place int, chunk_id {c}, score double")


def retrieve(questions: DataFrame, store: DataFrame, top: int = 4, metric: str = "l2", trade: float = 0.4) -> DataFrame:
    """Full retrieval: nearest, zone preference, rerank; chunk columns joined back by id."""
    hits = retrieve_candidates(questions, store, top, metric)
    rows = hits.join(store.select("chunk_id", "embedding", "zone_categories"), "chunk_id").join(
        questions.select("query_id", "zone_filter"), "query_id")
    return rerank(prefer_zone(rows), top, trade).join(store.drop("embedding"), "chunk_id")


def plain_answers(hits: DataFrame, shown: int = 4, size: int = 300) -> DataFrame:
    """Per question: the first cited excerpts cut to 300 characters."""
    cite = tx.citation(F.coalesce("jurisdiction", F.lit("Unknown")), F.col("section"), F.col("source"))
    part = F.concat(cite, F.lit("\n"), F.substring("text", 1, size))
    rows = hits.filter(F.col("place") <= shown).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", part.alias("part")))).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["part"]), "\n\n").alias("answer"))


def context_text(hits: DataFrame, parcels: DataFrame, shown: int = 6) -> DataFrame:
    """Per question: known parcel fields, then up to six cited excerpts, and the citation list."""
    cite = tx.citation(F.coalesce("jurisdiction", F.lit("")), F.col("section"), F.col("source"), F.col("start_page"), F.col("end_page"))
    rows = hits.filter(F.col("place") <= shown).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat(cite, F.lit("\n"), "text", F.lit("\n")).alias("part"),
                                             F.concat_ws(":", "source", F.col("start_page").cast("string"), F.col("end_page").cast("string")).alias("cited")))).alias("rows"))
    names = ["APN", "JURISDICTION", "ZONING_CODE", "GP_LAND_USE", "MAX_HEIGHT", "MIN_LOT_SIZE", "MAX_FAR"]
    known = kept(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"- {n}: "), F.col(n).cast("string"))) for n in names if n in parcels.columns])
    head = parcels.select("query_id", F.concat(F.array(F.lit("**Parcel Context:**")), known).alias("head"))
    joined = rows.join(head, "query_id", "left")
    parts = F.concat(F.coalesce("head", F.array().cast("array<string>")), F.array(F.lit("\n**Relevant Zoning Regulations:**")),
                     F.transform("rows", lambda r: r["part"]))
    return joined.select("query_id", F.array_join(parts, "\n").alias("context"),
                         F.array_join(F.transform("rows", lambda r: r["cited"]), ";").alias("citations"))
