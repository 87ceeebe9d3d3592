import random
import time

import pyarrow as pa

from lotweave.llm import common, exact_dedup, near_join
from lotweave.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute_classes(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common, total = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and total and sets[a] and sets[b] and 100 * common >= percent * total:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed, n, longest):
    """Random texts with edited copies around the threshold, of all sizes from one word on."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, longest]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 20 + 1)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_classes_match_brute_force(spark, make_docs):
    for k, percent, seed in ((3, 90, 1), (5, 80, 2)):
        rows = near_rows(seed, 160, 200)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.near_classes(make_docs(rows), k, percent).collect()}
        assert got == brute_classes(rows, k, percent)


def test_near_classes_of_a_large_group_of_edited_copies(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_join, "TILE", 16)  # several tiles per bucket
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(90)] = rng.choice(WORDS)
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.near_classes(make_docs(rows), 3, 90).collect()}
    assert got == brute_classes(rows, 3, 90)


def test_blocks_never_miss_an_allowed_difference():
    import numpy as np

    bands, rng = near_join.Bands(80), np.random.default_rng(3)
    for n in (1, 2, 5, 9, 40, 300):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int(bands.gap * 2 * n)
            b = a[rng.permutation(n)[:max(1, n - drop)]]
            if 100 * len(b) < 80 * n:
                continue
            keys = [np.concatenate([near_join.block_keys(x, band, bands.blocks(band), bands.most(len(x))) for band in bands.roles(len(x))]) for x in (a, b)]
            assert len(np.intersect1d(*keys))


def test_near_join_odd_rows(spark, odd_docs, make_docs):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_join.near_classes(odd_docs, 3, 90).collect()]
    assert sorted(r for r in rows if r[0] is not None and r[0] < 4) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert (None, 2, None) in rows and rows.count((4, 1, 4)) == 2 and (6, 1, 6) in rows
    kept = near_join.keep_one(make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and "block" in kept.columns
    assert near_join.near_classes(make_docs([]), 3, 90).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 400)} == {100} and 500 not in got


def test_exact_dedup_rules(spark, odd_docs, make_docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(odd_docs).collect()}
    assert (3, 3, 3, True) in got and (1, 3, 3, False) in got and (4, 4, 2, True) in got and (None, None, 1, True) in got
    kept = exact_dedup.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert exact_dedup.decide(make_docs([])).count() == 0


def test_index_keeps_earlier_rows_and_ignores_a_batch_sent_twice(spark, make_docs):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", buckets=2)
    try:
        first = exact_dedup.digests(make_docs([(5, "a b"), (6, "c")]))
        index.add(first)
        index.add(first)
        index.add(exact_dedup.digests(make_docs([(1, "ab"), (2, "new"), (3, "n e w")])))
        assert sorted((r["keep_id"], r["group_size"]) for r in index.rows().collect()) == [(3, 2), (5, 1), (6, 1)]
    finally:
        index.drop()


def test_dedup_carries_columns_named_like_its_own(spark):
    names = ["_digest", "_keep", "_points", "digest", "keep", "points", "row", "keep_id", "group_size"]
    docs = spark.createDataFrame([(1, "a b", *names), (2, "ab", *names), (3, None, *names)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect() if r["text"]) == [(1, "a b", *names)] and kept.count() == 2


def test_spread_emits_small_batches_and_gives_memory_back(monkeypatch):
    """Keys of at most PIECE_ROWS documents are held together; freed memory leaves the reused worker at the task's end."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=60)) for _ in range(700)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(702), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    out = list(common.lean(near_join._spread(5, 80, {}))(iter([batch])))
    per_document = sum(b.num_rows for b in out) / 700
    assert max(b.num_rows for b in out) <= 1.2 * common.PIECE_ROWS * per_document and calls == [1]
    assert {i for b in out for i in b.column(1).to_pylist()} == set(range(700))


def test_a_long_text_is_hashed_whole_in_any_slice(monkeypatch):
    texts = pa.array([" ".join(f"x{i}" for i in range(60_000)), "a b c", None, "d"], pa.large_string()).fill_null("")
    whole = [s.tolist() for s in near_join.shingle_sets(texts, 3)]
    monkeypatch.setattr(near_join, "text_slices", lambda c: common.text_slices(c, 1 << 24))
    assert whole == [s.tolist() for s in near_join.shingle_sets(texts, 3)] and len(whole[0]) == 59_998


def large_rows():
    """Texts of 2,400 to 5,000 words that share a passage, one of them with edited copies on both sides of a sketch width."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(10 ** 6)}"
    passage = [word() for _ in range(400)]
    texts = [passage + [word() for _ in range(n - 400)] for n in (2400, 2500, 2600, 2700, 2800, 2900, 3050, 3100, 3300, 4900) * 3]
    copies = []
    for extra, edits in ((0, 20), (150, 30), (300, 10)):  # 3,072 tokens are the most of 2,048 bits
        own = [*texts[6], *[word() for _ in range(extra)]]
        for _ in range(edits):
            own[rng.randrange(len(own))] = word()
        copies.append(own)
    return [(i, " ".join(t)) for i, t in enumerate(texts + copies)]


def test_sets_of_large_unlike_texts_are_not_moved(spark, make_docs, monkeypatch):
    """A passage makes large texts candidates; the sketch of 1,024 bits lets all of them pass, the wide one their copies alone."""
    rows, moved, sets_of = large_rows(), set(), near_join.shingles

    def shingles(docs, words):
        moved.update(r["doc_id"] for r in docs.select("doc_id").collect())
        return sets_of(docs, words)

    monkeypatch.setattr(near_join, "shingles", shingles)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.near_classes(make_docs(rows), 5, 80).collect()}
    assert got == brute_classes(rows, 5, 80) and [got[i][1] for i in (30, 31, 32)] == [6, 6, 6]
    assert moved == {6, 30, 31, 32}


def test_wide_sketches_lose_no_pair(spark, make_docs):
    rows = large_rows() + [(40, "a b c d e f g"), (41, None)]
    sets = {i: shingle_set(t, 5) for i, t in rows}
    wide = near_join.features(make_docs(rows), 5).select("doc_id", "n", "wide")
    bits = {r["doc_id"]: 64 * len(r["wide"]) if r["wide"] else 0 for r in wide.collect()}
    assert {bits[i] for i in (6, 30)} == {2048} and {bits[9], bits[31], bits[32]} == {4096} and bits[40] == bits[41] == 0
    pairs = [(a, b) for a in sets for b in sets if a < b]
    for percent in (80, 30):
        kept = {tuple(r) for r in near_join.wide_filter(spark.createDataFrame(pairs, "a bigint, b bigint"), wide, percent).collect()}
        alike = {(a, b) for a, b in pairs if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert alike <= kept and {p for p in pairs if 40 in p or 41 in p} <= kept
    big = near_join.np.arange(10 ** 6, dtype=near_join.np.uint64)
    assert 64 * len(near_join.wide_sketch(near_join.mix(big))) == near_join.MOST_BITS and near_join.wide_sketch(big[:near_join.NARROW]) is None


def test_keys_of_much_text_are_sorted_in_more_tasks(make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f g")])
    plan = lambda tasks: near_join.star_pairs(docs, 3, 80, {}, tasks)._jdf.queryExecution().executedPlan().toString()
    assert ", 999), REPARTITION_BY_NUM" in plan(999) and "REPARTITION_BY_COL" in plan(1)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_deleted(spark):
    before = shuffle_files(spark)
    table = common.written(spark.range(1000).repartition(5, "id").groupBy("id").count(), "few")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
