"""Packing documents into training sequences by cutting-stock column generation.

A document's ids (with the end id) are cut into full sequences and one remainder. The remainders'
lengths form a histogram of classes, named after their greatest length: one token wide up to 64 tokens,
then wider in proportion, so that rounding a length up to its class costs about one part in a hundred.
A linear program over patterns of classes, solved by column generation on the driver, says how often
each pattern is used. Its size depends on the sequence length only, never on the data. Documents are
ranked inside their class (counts per block, then numbers inside blocks, so a class may hold any share
of the rows) and rank decides the sequence. What rounding leaves, and what only patterns with over one
part in fifty of padding would hold (texts of 1,100 tokens alone, say), is strung together in counted
blocks and cut to fill sequences without padding; the last one is cut at powers of two.

Ids are made once, in Arrow batches, and written to the shared folder; placing pieces reads lengths only.

Defined results. A null or empty text is one piece of the end id. Rows that repeat a doc_id are packed
like any others, once per row. A null doc_id is carried. Extra columns are ignored. An empty table
gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lotweave.llm.common import lean, small_batches, written
from lotweave.llm.cutting_stock import rounded
from lotweave.llm.tokens import WordTokenizer, default_path

LENGTH, END_ID = 2048, 1
#: Lengths up to FINE are classes of their own; beyond it each doubling is cut into as many classes as FINE halves to.
FINE = 64
#: A pattern that fills less of a sequence is not used; its pieces are strung together instead.
LEAST_FILL = 0.98
#: Texts whose words are encoded together.
TOGETHER = 256
#: Documents whose pieces leave a task together.
TOGETHER_OUT = 1_000
#: Pieces that one ranking block holds, about.
BLOCK_ROWS = 5_000
#: Words whose ids a task remembers.
MEMO_WORDS = 500_000
#: Strung pieces (16 bytes each) that are broadcast; more of them meet their ids in a shuffled join.
MOST_BROADCAST = 200_000
PIECES = "key bigint, doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Full pieces and the remainder of every document; ``key`` is unique, ``ids`` little-endian."""
    def run(batches):
        tokenizer, serial = WordTokenizer(path, memo_words), TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, TOGETHER_OUT):
            rows = {c: [] for c in ("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, len(texts), TOGETHER):
                found = tokenizer.encode(texts.slice(first, TOGETHER).to_pylist())
                for doc_id, ids in zip(doc_ids[first:first + TOGETHER], found, strict=True):
                    ids = np.append(ids, np.array([end_id], tokenizer.kind))
                    for at in range(0, len(ids), length):
                        own = ids[at:at + length]
                        for c, v in zip(rows, (serial, doc_id, at, len(own), _crc(own), len(ids), own.tobytes()), strict=True):
                            rows[c].append(v)
                        serial += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def _ranked(rest: DataFrame, count: int) -> DataFrame:
    """0, 1, 2, ... inside each class."""
    blocks = max(1, count // BLOCK_ROWS)
    cut = rest.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("class", "block").agg(F.count(F.lit(1)).alias("n")).select("class", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("class", "block").orderBy("key")
    return cut.join(base, ["class", "block"]).withColumn("rank", F.col("base") + F.row_number().over(inner) - 1).drop("block", "base")


def class_of(length: Column, most: int, fine: int = FINE) -> Column:
    """The greatest length of a length's class; ``fine`` is a power of two."""
    found, top, step = F.when(length <= fine, length), fine, 2
    while top < most:
        top *= 2
        found = found.when(length <= top, F.ceil(length / step) * step)
        step *= 2
    return F.least(found, F.lit(most)).cast("int")


def _strung(rest: DataFrame) -> DataFrame:
    """``rest`` with ``base``, the tokens before each piece; blocks are counted first, so no window holds all pieces."""
    blocks = max(1, rest.count() // BLOCK_ROWS)
    cut = rest.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    line = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK_ROWS pieces
    before = cut.groupBy("block").agg(F.sum("length").alias("n")).select("block", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    inner = Window.partitionBy("block").orderBy(F.col("class").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("before") + F.coalesce(F.sum("length").over(inner), F.lit(0))
    return cut.join(before, "block").select("key", "length", base.cast("bigint").alias("base"))


def _plan(spark, demand: np.ndarray, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """Places of ranks (class, from_rank, to_rank, per, sequence, slot), the ranks placed per class, and the sequences used."""
    uses, _ = rounded(demand, capacity, LEAST_FILL)
    filled, places, sequence = np.zeros(len(demand), np.int64), [], 0
    for pattern, n in uses:
        slot = 0
        for size, per in sorted(pattern.items(), reverse=True):
            places.append((size, int(filled[size - 1]), int(filled[size - 1]) + n * per, per, sequence, slot))
            filled[size - 1] += n * per
            slot += per
        sequence += n
    kinds = "class int, from_rank bigint, to_rank bigint, per int, sequence bigint, slot int"
    limits = [(i + 1, int(f)) for i, f in enumerate(filled)]
    return spark.createDataFrame(places, kinds), spark.createDataFrame(limits, "class int, placed bigint"), sequence


def _cut_rest(rest: DataFrame, total: int, first: int, length: int) -> DataFrame:
    """Pieces strung together by ``base`` and cut at sequence ends; the last part at powers of two."""
    full = total // length
    ends, at = [], full * length
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    schema = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                width = len(r["ids"]) // max(1, r["length"])
                ids, at = np.frombuffer(r["ids"], f"<u{width}"), 0
                while at < len(ids):
                    place = r["base"] + at
                    n = place // length
                    if n < full:
                        begin, end = n * length, (n + 1) * length
                    else:
                        k = int(np.searchsorted(ends, place, side="right"))
                        n, begin, end = full + k, ends[k - 1] if k else full * length, ends[k]
                    own = ids[at:at + end - place]
                    out.append({"doc_id": r["doc_id"], "start": r["start"] + at, "length": len(own), "ids_crc32": _crc(own), "doc_tokens": r["doc_tokens"],
                                "sequence_id": 2 * (first + n), "offset": place - begin, "ids": own.tobytes()})
                    at += len(own)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]))

    return rest.select("doc_id", "start", "length", "doc_tokens", "base", "ids").mapInArrow(lean(run), schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False,
         memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` (little-endian) on request.

    A task remembers the ids of at most ``memo_words`` words, about 200 bytes each.
    """
    spark = docs.sparkSession
    every = written(pieces(docs, path or default_path(), length, end_id, memo_words), "pieces")
    bare = every.drop("ids")
    rest = bare.filter(F.col("length") < length).withColumn("class", class_of(F.col("length"), length))
    histogram = rest.groupBy("class").count().collect()  # one row per class
    demand = np.zeros(length, np.int64)
    for r in histogram:
        demand[r["class"] - 1] = r["count"]
    places, limits, sequences = _plan(spark, demand, length)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = bare.filter(F.col("length") == length).select("key", *columns[:5], (2 * F.col("key") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    ranked = written(_ranked(rest, int(demand.sum())), "ranked")
    # both tables are bounded by the classes and patterns of the program
    fits = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = ranked.join(F.broadcast(places.withColumnRenamed("class", "_class")), (F.col("class") == F.col("_class")) & fits)
    turn = F.col("rank") - F.col("from_rank")
    placed = placed.select("key", *columns[:5], (2 * (F.col("sequence") + F.floor(turn / F.col("per")))).alias("sequence_id"), (F.col("slot") + turn % F.col("per")).alias("slot"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has 2048 pieces at most
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")).drop("slot")

    over = ranked.join(F.broadcast(limits), "class").filter("rank >= placed")
    over = written(_strung(over), "rest")
    strung, total = over.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    base = over.select("key", "base")
    cut = _cut_rest(every.join(F.broadcast(base) if strung <= MOST_BROADCAST else base, "key"), total, sequences, length)
    if not with_ids:
        return whole.unionByName(placed).select(*columns).unionByName(cut.select(*columns)).withColumn("length", F.col("length").cast("bigint"))
    ids = every.select("key", "ids")
    return whole.unionByName(placed).join(ids, "key").select(*columns, "ids").unionByName(cut).withColumn("length", F.col("length").cast("bigint"))
