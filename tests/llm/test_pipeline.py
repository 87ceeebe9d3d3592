import random

import corpus_pipeline
import pytest
from lotweave.llm import exact_dedup, toxicity
from tests.llm.test_corpus import check_packing, words_of
from tests.llm.test_dedup import brute_classes

INSULTS = ("grumphead", "blockwit", "zilchbrain")


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    rng = random.Random(11)
    words = [a + b + c for a in ("ta", "ren", "sol", "mi", "or") for b in ("ved", "lu", "en", "ka") for c in ("", "s", "in", "os")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, "two only")]
    rows = [(i, text(rng.randrange(20, 120))) for i in range(160)]
    toxic = set()
    for i in range(0, 160, 4):
        own = rows[i][1].split()
        own[3:3] = [rng.choice(INSULTS), rng.choice(INSULTS)]
        rows[i] = (i, " ".join(own))
        toxic.add(i)
    clean = [r for r in rows if r[0] not in toxic]
    rows += [(200 + k, clean[k][1].replace(" ", "  ") + "\n") for k in range(6)]
    for k in range(8):
        own = clean[20 + k][1].split()
        own[len(own) // 2] = "edited"
        rows.append((300 + k, " ".join(own)))
    rows += [(400 + k, clean[40 + k][1] + " " + " ".join(items[0][1].split()[k:k + 11])) for k in range(5)]
    rows += [(500, None), (501, ""), (502, "word"), (503, "Two, ONLY")]
    labels = [(i, 1, int(i in toxic)) for i in range(160)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, items


def test_stages_match_brute_force(spark, make_docs, corpus):
    folder, rows, toxic, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = {i: t for i, t in rows if i not in toxic}
    steps = dict(corpus_pipeline.STAGES)
    docs = steps["toxicity"](spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} == set(expected) and len(docs.columns) == 8

    groups = {}
    for i, t in expected.items():
        groups.setdefault((t or "").translate({ord(c): None for c in exact_dedup.SPACE}), []).append((-len(t or ""), i))
    expected = {i: expected[i] for i in (min(g)[1] for g in groups.values())}
    docs = steps["exact dedup"](spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} == set(expected)

    classes = brute_classes(list(expected.items()), 5, 80)
    expected = {i: t for i, t in expected.items() if classes[i][1] == i}
    docs = steps["n-gram Jaccard join"](spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} == set(expected)

    def leaks(text):
        own = words_of(text)
        for _, t in items:
            item = words_of(t)
            n = min(10, len(item))
            windows = {tuple(item[p:p + n]) for p in range(len(item) - n + 1)}
            if any(tuple(own[p:p + n]) in windows for p in range(len(own) - n + 1)):
                return True
        return False

    expected = {i: t for i, t in expected.items() if not leaks(t)}
    docs = steps["benchmark decontamination"](spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} == set(expected)
    found, _ = check_packing(list(expected.items()), steps["packing"](spark, docs, folder).collect())
    assert found == set(expected)


def test_run_applies_all_stages(spark, corpus):
    folder, rows, toxic, _ = corpus
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert kept and not kept & toxic and kept < {i for i, _ in rows}


def test_stages_take_an_empty_table(spark, corpus):
    folder = corpus[0]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
        assert stage(spark, docs, folder).count() == 0, name
    assert toxicity.THRESHOLD == 0.3
