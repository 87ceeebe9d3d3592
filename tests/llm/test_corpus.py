import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.llm import cutting_stock, packing, string_kernel, toxicity, winnowing
from lotweave.llm.tokens import WordTokenizer, default_path


def test_tokenizer_gives_the_ids_of_whole_texts():
    texts = ["It's, a Test. don't?! <|endoftext|> x<|ENDOFTEXT|>y, 12.5, ...", "", None, "École, ñandú. ΑΣ Σς ﬁn\x1cx  y", "a.,b. C'. 's,.'", "z" * 3000]
    own = WordTokenizer(default_path(), most=7)
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_tokenizer_gives_the_ids_of_whole_texts_over_slices():
    slices = [["<|im_start|>user Hello<|im_end|>", "plain words"], ["<|im_start|> World IJsberg, ÉCOLE. Straße", "more Plain"], ["World \u0130stanbul D\u0130Z", "\u0130"],
              ["J\u030cI T\u0308 H\u0331 W\u030a Y\u030a E\u0301 T\u0344", "world"], [chr(c) + "a" + chr(c) for c in range(0x21, 0x250)], ["<|endoftext|> World <|ENDOFTEXT|> Again", "Again"]]
    own = WordTokenizer(default_path())
    for texts in slices:
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, placed):
    own = WordTokenizer(default_path())
    ids = {i: np.append(own.encode([t])[0], 1) for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in placed:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(piece.astype("<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == len(ids[i]) and len({s for s, _ in pieces}) == len(pieces)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return set(by_doc), padding / max(1, sum(map(len, ids.values())))


def test_packing_places_every_id_once(spark, make_docs):
    rows = [(i, "tall word " * (1 + i * 37 % 1500)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "x " * 9000)]
    found, padding = check_packing(rows, packing.pack(make_docs(rows)).collect())
    assert found == {i for i, _ in rows} and padding < 0.03
    with_ids = packing.pack(make_docs(rows[:40]), with_ids=True).collect()
    assert all(zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in with_ids)


@pytest.mark.parametrize("words", [
    lambda i: 1 + i * 7 % 19, lambda i: 1099, lambda i: (1 + i * 7 % 12) if i % 3 else 200 + i * 31 % 2500])
def test_packing_pads_little(spark, make_docs, words):
    rows = [(i, "tall " * words(i)) for i in range(1500)]
    found, padding = check_packing(rows, packing.pack(make_docs(rows)).collect())
    assert found == {i for i, _ in rows} and padding < 0.03


def test_strung_pieces_meet_their_ids_in_a_shuffled_join(spark, make_docs, monkeypatch):
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    rows = [(i, "tall " * 1099) for i in range(100)]
    found, padding = check_packing(rows, packing.pack(make_docs(rows)).collect())
    assert found == set(range(100)) and padding < 0.01


def test_classes_hold_their_lengths(spark):
    got = {r[0]: r[1] for r in spark.range(1, 2049).select("id", packing.class_of(F.col("id"), 2048)).collect()}
    assert all(got[n] == n for n in range(1, 65)) and all(0 <= c - n < n / 32 for n, c in got.items())
    assert len(set(got.values())) == 224 and got[65] == 66 and got[129] == 132 and got[2047] == 2048


def test_packing_odd_rows(spark, odd_docs, make_docs):
    rows = packing.pack(odd_docs).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) >= 1
    assert packing.pack(make_docs([])).count() == 0


def test_patterns_meet_demand_and_fit():
    rng = np.random.default_rng(1)
    for m, most in ((40, 4000), (128, 300), (5, 3)):
        demand = rng.integers(0, most, m)
        uses, left = cutting_stock.rounded(demand, 128)
        met = left.copy()
        for pattern, n in uses:
            assert n > 0 and sum(s * k for s, k in pattern.items()) <= 128
            for s, k in pattern.items():
                met[s - 1] += n * k
        assert (met == demand).all() and (left >= 0).all()
    assert cutting_stock.rounded(np.zeros(4, int), 8)[0] == []


def words_of(text):
    out, word = [], ""
    for c in ((text or "").translate({i: i + 32 for i in range(65, 91)})) + " ":
        if ord(c) >= 128 or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_decontamination_matches_brute_force(spark, make_docs):
    rng = np.random.default_rng(2)
    item = [" ".join(f"v{rng.integers(0, 30)}" for _ in range(n)) for n in (25, 10, 9, 3, 1, 0)]
    docs = []
    for i in range(60):
        words = [f"v{rng.integers(0, 30)}" for _ in range(rng.integers(0, 80))]
        if i % 3 == 0:
            span = item[0].split()[(a := rng.integers(0, 10)):a + rng.integers(8, 14)]
            words[5:5] = span
        docs.append((i, ", ".join(words).upper()))
    docs.append((99, None))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(7, None)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in winnowing.scan(make_docs(docs), bench).collect()}
    for i, text in docs:
        words, hit, items = words_of(text), set(), set()
        for k, t in enumerate(item):
            own = words_of(t)
            span = min(10, len(own))
            windows = {tuple(own[p:p + span]) for p in range(len(own) - span + 1)} if span else set()
            for p in range(len(words) - span + 1) if span else ():
                if tuple(words[p:p + span]) in windows:
                    hit.update(range(p, p + span))
                    items.add(str(k))
        assert got[i] == (len(words), len(hit), sorted(items)), i


def test_decontamination_odd_rows(spark, odd_docs, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r["n_hit"] == 0 for r in winnowing.scan(odd_docs, none).collect())
    bench = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "one")], "item_id bigint, text string")
    kept = winnowing.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "6", "None"]
    assert winnowing.scan(make_docs([]), bench).count() == 0


def test_decontamination_carries_columns_named_like_its_own(spark):
    names = ["_text_key", "text_key", "_id", "_key", "row", "n_hit", "spots"]
    docs = spark.createDataFrame([(1, "two words", *names), (2, "clean text", *names)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = winnowing.clean(docs, spark.createDataFrame([(1, "two words")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", *names)]


def test_kernel_counts_gapped_triples():
    def brute(a, b):
        def phi(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + 5)):
                        out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + 0.5 ** (k - i - 2)
            return out
        x, y = phi(a), phi(b)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(v * y.get(t, 0) for t, v in x.items()) / norm
    words = ["idiot", "idxiot", "banana", "idiotic", "aaaa"]
    got = string_kernel.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(brute(a, b), abs=1e-5)
    assert got[0, 1] > 0.4 > got[0, 2]


@pytest.fixture(scope="module")
def trained(spark, make_docs):
    rng = np.random.default_rng(4)
    clean = lambda n: [f"{a}{b}{c}" for a, b, c in rng.choice(["ta", "ren", "sol", "mi", "ved", "or", "lu", "en"], (n, 3))]
    rows, labels = [], []
    for i in range(240):
        words, toxic = clean(60), i % 4 == 0
        if toxic:
            words[7], words[20] = rng.choice(["grumphead", "blockwit", "zilchbrain"], 2)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    return model, rows, labels


def test_toxicity_separates_held_out_rows(spark, make_docs, trained):
    model, rows, labels = trained
    got = {r["doc_id"]: (r["score"], r["held"]) for r in toxicity.score(make_docs(rows).select("doc_id", "text"), model).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).collect()}
    held = [i for i in got if got[i][1]]
    assert held == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i in held] and len(held) > 30
    wrong = [i for i in held if (got[i][0] >= toxicity.THRESHOLD) != bool(labels[i][2])]
    assert len(wrong) <= 0.05 * len(held)


def test_toxicity_sees_gapped_insults(trained):
    machine = trained[0].machine
    scorer = toxicity.Scorer(machine, most=3)
    plain, gapped, spaced, leet, harmless = scorer.best(["you grumphead", "you grum-ph.head", "you g r u m p h e a d", "gru3mphead", "tarensol mivedor"])
    assert min(plain, gapped, spaced, leet) > harmless


def test_toxicity_odd_rows(spark, odd_docs, make_docs, trained):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.classify(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    assert toxicity.clean(odd_docs, none).columns == odd_docs.columns
    scored = toxicity.score(odd_docs.select("doc_id", "text"), trained[0]).collect()
    empty = [r["score"] for r in scored if r["doc_id"] in (1, 2, 3)]
    assert len(set(empty)) == 1 and 0 <= empty[0] <= 1
    assert toxicity.score(make_docs([]).select("doc_id", "text"), trained[0]).count() == 0
