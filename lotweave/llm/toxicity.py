"""Toxicity of documents by a subsequence-kernel support vector machine.

Labels are per document, insults are single words, so training is on words of labelled sentences
(multiple-instance learning). Over a sample of labelled documents, bounded by ``SAMPLE`` rows, each
sentence's words give triple counts per label; the words with the most telling triples, some of each
document, become examples; the machine is trained, then again on the highest-scoring word of each
toxic document and the highest-scoring words of clean ones, ``ROUNDS`` times. A document scores by its
most insulting word, through a logistic curve fitted to the sample. Whole texts are scored.

Runs of single letters between spaces count as one word as well, so spaced-out insults are seen.

Defined results. Null and empty texts have no words and get the lowest margin (the bias alone). Rows
that repeat a doc_id are scored each. Without a label of either class every score is 0. Labels of
null doc_id or null class are not used; of repeated labels the larger counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.common import lean
from lotweave.llm.string_kernel import SYMBOLS, Machine, fold, nystroem, plain, train, triples, windows

#: Most labelled documents of each class in a fit, about (chosen by a hash of doc_id).
SAMPLE = {1: 2_000, 0: 4_000}
#: Examples kept per toxic and clean document, landmarks, and rounds of training.
EXAMPLES, LANDMARKS, ROUNDS = 6, 200, 3
#: Share of clean sampled documents whose best word an extra toxic example must beat.
CLEAN_QUANTILE = 0.99
MEMO = 300_000
THRESHOLD = 0.3

_SENTENCE = re.compile(r"[.!?\n]+\s*")
_SPACED = re.compile(rb"(?:(?<!\S)[a-zA-Z0-9@$!]\s){2,}[a-zA-Z0-9@$!](?!\S)")


def spans(text: str | None) -> set[bytes]:
    """Distinct raw words of a text; spaced-out single letters also as one word."""
    if not text:
        return set()
    raw = text.encode("utf-8", "replace").lower()
    found = set(raw.split())
    found.update(b"".join(m.group().split()) for m in _SPACED.finditer(raw))
    return found


def forms(raw: bytes) -> list[str]:
    return [w for w in windows(plain(raw.decode("utf-8", "replace"))) if len(w) >= 3]


class Scorer:
    """Highest margin over a text's words, with a bounded memo of words."""

    def __init__(self, machine: Machine, most: int = MEMO):
        self.machine, self.most, self.memo = machine, most, {}

    def _learn(self, words: list[bytes]) -> None:
        parts, owner = [], []
        for i, word in enumerate(words):
            for form in forms(word):
                parts.append(form)
                owner.append(i)
        best = np.full(len(words), self.machine.bias)
        if parts:
            np.maximum.at(best, np.array(owner), self.machine.margins(parts))
        self.memo.update(zip(words, best.tolist(), strict=True))

    def best(self, texts: list[str | None]) -> np.ndarray:
        every = [spans(t) for t in texts]
        new = set().union(*every).difference(self.memo) if every else set()
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = set().union(*every)
        self._learn(list(new))
        memo = self.memo
        return np.array([max(map(memo.__getitem__, words), default=self.machine.bias) for words in every])


def _margins(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` columns but the text, and ``margin``."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "margin double"])

    def run(batches):
        scorer = Scorer(machine)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [scorer.best(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
            margin = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in rest], pa.array(margin)],
                                             names=[*[f.name for f in rest], "margin"])

    return docs.mapInArrow(lean(run), schema)


@dataclass
class Model:
    machine: Machine
    slope: float
    shift: float


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of at most about ``SAMPLE`` labelled training rows of each class."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"))))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    line = F.lit(0.0)
    for label, most in SAMPLE.items():
        line = F.when(F.col("toxic") == label, F.lit(min(1.0, most / max(1, counts.get(label, 0))))).otherwise(line)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.filter(draw < line)
    # bounded by SAMPLE rows of sixteen bytes
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def _triple_counts(rows: DataFrame) -> np.ndarray:
    """Documents of each class that hold a triple, as a (64^3, 2) table; its size is fixed."""
    def run(batches):
        seen = np.zeros((SYMBOLS ** 3, 2), np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for sentence in _SENTENCE.split(text or ""):
                    words = [f for raw in spans(sentence) for f in forms(raw)]
                    if words:
                        seen[np.unique(triples(words)), toxic] += 1
        hit = np.flatnonzero(seen.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[hit, 0]), pa.array(seen[hit, 1])], names=["t", "clean", "toxic"])

    parts = rows.mapInArrow(lean(run), "t bigint, clean bigint, toxic bigint").groupBy("t").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    out = np.zeros((SYMBOLS ** 3, 2))
    out[parts["t"].to_numpy(), 0], out[parts["t"].to_numpy(), 1] = parts["clean"], parts["toxic"]
    return out


def _examples(rows: DataFrame, machine: Machine) -> tuple[list[tuple[int, int]], list[str], np.ndarray]:
    """The ``EXAMPLES`` best words of each sampled document under ``machine``: owners, words, margins."""
    def run(batches):
        for batch in batches:
            ids, labels, words, scores = [], [], [], []
            for doc_id, toxic, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts = sorted({f for raw in spans(text) for f in forms(raw)})
                if parts:
                    margin = machine.margins(parts)
                    for i in np.argsort(-margin, kind="stable")[:EXAMPLES]:
                        ids.append(doc_id)
                        labels.append(toxic)
                        words.append(parts[i])
                        scores.append(float(margin[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(words, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "toxic", "word", "score"])

    found = rows.mapInArrow(lean(run), "doc_id bigint, toxic int, word string, score double").toPandas().sort_values(["doc_id", "score", "word"])
    return list(zip(found["doc_id"], found["toxic"], strict=True)), found["word"].tolist(), found["score"].to_numpy()


def _landmarks(words: list[str], label: np.ndarray) -> list[str]:
    """Frequent toxic examples and frequent clean ones, spread over first letters by count alone."""
    out: list[str] = []
    for value, share in ((1, 0.7), (0, 0.3)):
        seen: dict[str, int] = {}
        for w, y in zip(words, label, strict=True):
            if y == value:
                seen[w] = seen.get(w, 0) + 1
        order = sorted(seen, key=lambda w: (-seen[w], w))
        out += order[:int(LANDMARKS * share)]
    return sorted(set(out))


def _trained(spark: SparkSession, words: list[str], label: np.ndarray) -> Machine:
    """The machine for a bounded set of examples; the algebra runs in a task, with a task's one thread."""
    def run(batches):
        for _ in batches:
            landmarks = _landmarks(words, label)
            features, root = nystroem(words, landmarks)
            machine = fold(landmarks, root, train(features, label))
            yield pa.RecordBatch.from_arrays([pa.array([machine.table.tobytes()], pa.binary()), pa.array([machine.bias])], names=["weights", "bias"])

    row = spark.range(0, 1, 1, 1).mapInArrow(lean(run), "weights binary, bias double").first()
    return Machine(np.frombuffer(row["weights"], np.float32), row["bias"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on labelled rows that are not held out; None without both classes."""
    rows = sample(docs, labels).persist()
    try:
        n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if not n.get(0) or not n.get(1):
            return None
        counts = _triple_counts(rows)
        rate = (counts[:, 1] + 0.5) / (counts[:, 1].sum() + 1) / ((counts[:, 0] + 0.5) / (counts[:, 0].sum() + 1))
        table = np.where(counts[:, 1] >= 2, np.log(rate), np.minimum(np.log(rate), 0)).astype(np.float32)
        table[0] = 0
        machine = Machine(table, 0.0)
        for _ in range(ROUNDS):
            owners, words, scores = _examples(rows, machine)
            best: dict[tuple[int, int], float] = {}
            for owner, s in zip(owners, scores, strict=True):
                best[owner] = max(best.get(owner, -np.inf), s)
            # a toxic document's best word is toxic, and so are others that few clean documents reach
            line = np.quantile([s for (_, toxic), s in best.items() if not toxic], CLEAN_QUANTILE)
            use, label = [], []
            for i, (owner, s) in enumerate(zip(owners, scores, strict=True)):
                if not owner[1] or s >= best[owner] or s > line:
                    use.append(i)
                    label.append(owner[1])
            machine = _trained(docs.sparkSession, [words[i] for i in use], np.array(label))
        pairs = _margins(rows.select("toxic", "text"), machine).toPandas()
        slope, shift = _logistic(pairs["margin"].to_numpy(), pairs["toxic"].to_numpy())
        return Model(machine, slope, shift)
    finally:
        rows.unpersist()


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with smoothed targets."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) in place of the text."""
    if model is None:
        return docs.drop("text").withColumn("score", F.lit(0.0))
    found = _margins(docs, model.machine)
    return found.withColumn("score", 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.shift)))).drop("margin")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; no shuffle."""
    model = fit(docs, labels)
    if model is None:
        return docs
    marked = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("text").cast("string").alias("text"))
    kept = score(marked, model).filter(F.col("score") < THRESHOLD)
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
