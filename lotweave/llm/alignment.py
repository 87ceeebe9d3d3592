"""Links between the tokens of two tokenizers over the same text, and how common each pair of ids is.

Both tokenizers read a space and the text. A token owns a run of bytes, so each tokenizer gives a
token-byte incidence matrix; its product with the other's transpose holds the overlapping tokens and
by how many bytes they overlap. Offsets where tokens of both end cut the text into groups; the
product of the two token-group matrices holds the pairs that share a group.

Neither tokenizer has a token that reaches from a character outside ``BLANKS`` into one of them, so
a text falls into segments (blanks, then what follows up to the next blank) that are encoded and
multiplied apart, once for each distinct segment that a task meets; a text's links are its segments'
together. The memo of segments is emptied when full. Texts that hold any other white space are one
segment, so the result never depends on the cut. ``Aligner`` checks the claim on the vocabulary and
takes whole texts where it does not hold.

Pair counts are one aggregation over all documents. Reading them back, the pairs that hold more than
1 / ``HOT_PAIRS`` of all (document, pair) rows, fewer than ``HOT_PAIRS`` by that definition, are
broadcast; the others meet their documents in a shuffled join in which no key is larger than that.

Defined results. Null and empty texts, and texts that a tokenizer does not give back byte by byte,
have no tokens: zeros, and '' for the groups. Rows that repeat a doc_id or a whole row are documents
of their own, null doc_ids too. A text of any length is read whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm import csr
from lotweave.llm.common import list_column, text_slices, written

#: Characters before which a text may be cut, if no token reaches into one from outside.
BLANKS = " \n\t"
_SEGMENT = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: Other white space and separators; a text with any of them is one segment.
_ODD = re.compile("[%s]" % "".join(map(chr, (*range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C),
                                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))))
#: New segments are encoded in runs of about so many bytes.
RUN_BYTES = 1 << 14
#: What a remembered segment costs beside its characters, in characters.
SEGMENT_WEIGHT = 80
#: Pairs with more than 1 / HOT_PAIRS of all rows are broadcast: at most 200,000 rows of three numbers.
HOT_PAIRS = 200_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Encodes segments by tokenizers A (byte-level) and B (pieces) and keeps their products."""

    def __init__(self, path_a: str, path_b: str, most: int = 32_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        crosses = re.compile(rb"[^ \n\t][ \n\t]")
        self.whole = any(crosses.search(x) and not _ODD.search(x.decode("utf-8", "ignore")) for x in (*self.bytes_a, *self.bytes_b))
        self.most = most  # weight of the memo: characters, and SEGMENT_WEIGHT a segment
        self.clear()

    def clear(self) -> None:
        self.weight = 0
        self.memo: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: Per segment: tokens of A and of B, groups, links, overlaps, and whether both give it back.
        self.facts = np.zeros((0, 6), np.int64)
        self.ptr, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def segments(self, text: str) -> list[str]:
        spaced = " " + text
        return [spaced] if self.whole or _ODD.search(text) else _SEGMENT.findall(spaced)

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, tokens of A and of B per segment, whether both give the segment back)."""
        parts, raw = [], [s.encode() for s in segments]
        first = 0
        while first < len(segments):  # segments that end in no blank may be read as one text
            end, size = first, 0
            while end < len(segments) and (end == first or size < RUN_BYTES):
                size += len(raw[end])
                end += 1
                if segments[end - 1][-1] in BLANKS or segments[end - 1].isspace():
                    break
            parts.append((first, end))
            first = end
        joined = ["".join(segments[a:b]) for a, b in parts]
        ids_a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(joined, add_special_tokens=False)]
        # B puts a space before what it reads, so a run's own first space stays out; else a letter takes the space
        spaced = [len(t) > 1 and t[0] == " " for t in joined]
        ids_b = [np.array(x if own else x[1:], np.int64)
                 for x, own in zip(self.b.encode([t[1:] if own else "x" + t for t, own in zip(joined, spaced, strict=True)], num_threads=1), spaced, strict=True)]
        good = np.ones(len(segments), bool)
        for k, (a, b) in enumerate(parts):
            whole = b"".join(raw[a:b])
            if b"".join([self.bytes_a[i] for i in ids_a[k].tolist()]) == whole == b"".join([self.bytes_b[i] for i in ids_b[k].tolist()]):
                continue
            if b - a == 1:
                good[a], ids_a[k], ids_b[k] = False, ids_a[k][:0], ids_b[k][:0]
            else:  # find the segments that are not given back
                inner = [self._encode([s]) for s in segments[a:b]]
                good[a:b] = [bool(x[4][0]) for x in inner]
                ids_a[k], ids_b[k] = np.concatenate([x[0] for x in inner]), np.concatenate([x[1] for x in inner])
        flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends = np.concatenate(([0], np.cumsum(np.where(good, [len(x) for x in raw], 0))))
        counts = [np.diff(np.concatenate(([0], np.searchsorted(np.cumsum(size[flat]), ends[1:], side="right"))))
                  for size, flat in ((self.len_a, flat_a), (self.len_b, flat_b))]
        return flat_a, flat_b, *counts, good

    def learn(self, segments: list[str]) -> None:
        """Append the products of ``segments``, all of them as one block-diagonal matrix a side."""
        flat_a, flat_b, count_a, count_b, good = self._encode(segments)
        n = len(segments)
        seg_a = np.repeat(np.arange(n), count_a)
        size = int(self.len_a[flat_a].sum())
        a_bytes, b_bytes = csr.from_lengths(self.len_a[flat_a], size), csr.from_lengths(self.len_b[flat_b], size)
        over_row, _, _ = csr.multiply(a_bytes, csr.transpose(b_bytes))
        end_a, end_b = a_bytes.ptr[1:], b_bytes.ptr[1:]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        row, col, _ = csr.multiply(csr.from_column(group_a, len(cuts)), csr.transpose(csr.from_column(group_b, len(cuts))))
        links = np.bincount(seg_a[row], minlength=n)
        # no group reaches over the end of a segment, so a group is its first token's segment's
        first_a = np.searchsorted(group_a, np.arange(len(cuts)))
        of = seg_a[first_a]
        facts = np.stack([count_a, count_b, np.bincount(of, minlength=n), links, np.bincount(seg_a[over_row], minlength=n), good.astype(np.int64)], axis=1)
        at = len(self.groups)
        self.memo.update(zip(segments, range(at, at + n), strict=True))
        self.groups.extend(_names(flat_a, flat_b, group_a, group_b, of, n))
        self.facts = np.concatenate((self.facts, facts))
        self.ptr = np.concatenate((self.ptr, self.ptr[-1] + np.cumsum(links)))
        self.pairs = np.concatenate((self.pairs, (flat_a[row] << 32) | flat_b[col]))

    def align(self, texts: list[str]):
        """Per text: facts, hash of the groups, distinct id pairs (A << 32 | B) and how often each is linked."""
        split = [self.segments(t) if t else [] for t in texts]
        known = set().union(*split) if split else set()
        new = known.difference(self.memo)
        if self.weight + _weight(new) > self.most:
            self.clear()
            new = known
        if new:
            self.weight += _weight(new)
            self.learn(list(new))
        at = [np.fromiter(map(self.memo.__getitem__, s), np.int64, len(s)) for s in split]
        out = []
        for own in at:
            facts = self.facts[own]
            if not len(own) or not facts[:, 5].all():
                out.append((np.zeros(5, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            sizes = self.ptr[own + 1] - self.ptr[own]
            ends = np.cumsum(sizes)
            pairs = self.pairs[np.arange(int(ends[-1])) + np.repeat(self.ptr[own] - (ends - sizes), sizes)]
            code, times = np.unique(pairs, return_counts=True)
            digest = hashlib.sha256(b";".join([self.groups[k] for k in own.tolist()])).hexdigest()
            out.append((facts[:, :5].sum(axis=0), digest, code, times))
        return out


def _names(flat_a, flat_b, group_a, group_b, of, n) -> list[bytes]:
    """Each segment's groups as ``a1,a2|b1;a3|b2,b3``: numbers and the marks behind them, in order."""
    token = np.concatenate((flat_a, flat_b))
    group = np.concatenate((group_a, group_b))
    side = np.concatenate((np.zeros(len(flat_a), np.int8), np.ones(len(flat_b), np.int8)))
    order = np.lexsort((side, group))  # stable: tokens keep their order
    group, side = group[order], side[order]
    last, turn = np.ones(len(group), bool), np.ones(len(group), bool)
    last[:-1], turn[:-1] = group[1:] != group[:-1], side[1:] != side[:-1]
    mark = np.where(last, ";", np.where(turn, "|", ","))
    text = "".join([f"{t}{m}" for t, m in zip(token[order].tolist(), mark.tolist(), strict=True)])
    digits = np.searchsorted(10 ** np.arange(1, 19), token[order], side="right") + 1
    ends = np.cumsum(np.bincount(of[group], weights=digits + 1, minlength=n)).astype(np.int64).tolist()
    raw = text.encode()
    return [raw[a:b - 1] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker, so its memo serves the worker's later tasks."""
    return Aligner(path_a, path_b)


def _weight(segments) -> int:
    return sum(map(len, segments)) + SEGMENT_WEIGHT * len(segments)


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
ALIGNED = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, pairs array<bigint>, times array<int>"


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document its token, group, link and overlap counts, the hash of its groups, and the distinct
    linked id pairs (A's id << 32 | B's id) with their occurrences."""
    path_a, path_b = path_a or paths()[0], path_b or paths()[1]

    def run(batches):
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for first, end, data, offsets in text_slices(texts, 2 << 20):
                raw = data.tobytes()
                cut = [raw[offsets[k]:offsets[k + 1]] for k in range(end - first)]
                found = aligner.align([_decoded(t) for t in cut])
                facts = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
                columns = [pa.array(facts[:, k]) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), *columns, pa.array([f[1] for f in found]),
                     list_column([f[2] for f in found], pa.int64()), list_column([f[3] for f in found], pa.int32())],
                    names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def _decoded(raw: bytes) -> str:
    """The text; bytes that are no UTF-8 cannot be given back, so such a text counts as empty."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs, best): how many documents hold each id pair linked, and whether that is the most of its A id."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = written(counts, "pair-counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))  # one row per id of A's vocabulary
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: doc_id, the counts, n_best (links whose pair is its A id's commonest), count_sum
    (documents that hold the pair, summed over links) and groups_sha256."""
    found = written(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(found), "pairs")
    rows = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    line = max(1, rows // hot_pairs)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    hot = F.broadcast(counts.filter(F.col("docs") > line))
    first = links.join(hot, "pair", "left")
    met = first.filter("docs is not null")
    rest = first.filter("docs is null").select("row", "pair", "times").join(counts.filter(F.col("docs") <= line), "pair")
    both = met.select("row", "times", "docs", "best").unionByName(rest.select("row", "times", "docs", "best"))
    sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"),
                                   F.sum(F.col("times") * F.col("docs")).cast("bigint").alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", *COUNTS, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
