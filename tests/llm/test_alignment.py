"""Token links against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotweave.llm import alignment, csr

ALIGNER = alignment.Aligner(*alignment.paths())
PIECES = [*" \n\t" * 5, *"abcEnth.,;'é漢🙂", "the", " is", "\r\n", "\xa0", "<|endoftext|>", "</s>", "<s>", "▁", "123", "\x00", "\x1c", "ing", "  ", "don't", "<0x0A>"]


def brute(text):
    """(n_a, n_b, n_groups, n_links), groups, links by pair."""
    whole = (" " + (text or "")).encode()
    a = ALIGNER.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = ALIGNER.b.encode(text) if text else []
    bytes_a, bytes_b = [ALIGNER.bytes_a[i] for i in a], [ALIGNER.bytes_b[i] for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return (0, 0, 0, 0), "", Counter()
    groups, links, p, q, at, bt = [], Counter(), 0, 0, len(bytes_a[0]), len(bytes_b[0])
    one, two = [a[0]], [b[0]]
    while True:
        if at < bt:
            p += 1
            at += len(bytes_a[p])
            one.append(a[p])
        elif bt < at:
            q += 1
            bt += len(bytes_b[q])
            two.append(b[q])
        else:
            groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
            links.update((x, y) for x in one for y in two)
            if at == len(whole):
                break
            p, q = p + 1, q + 1
            at, bt, one, two = at + len(bytes_a[p]), bt + len(bytes_b[q]), [a[p]], [b[q]]
    return (len(a), len(b), len(groups), sum(links.values())), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def answers(texts):
    facts = [brute(t) for t in texts]
    docs = Counter(pair for f in facts for pair in f[2])
    best = Counter()
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [(*f[0], sum(n for p, n in f[2].items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in f[2].items()), f[1]) for f in facts]


def test_align_equals_loops(spark, make_docs):
    r = random.Random(4)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", " ", "a", "a", "the same\n  text. " * 20000]
    docs = make_docs([(k if k % 7 else None, t) for k, t in enumerate(texts)])
    want = Counter((k if k % 7 else None, *a) for k, a in enumerate(answers(texts)))
    for hot_pairs in (alignment.HOT_PAIRS, 1):
        got = alignment.align(docs.repartition(3), hot_pairs=hot_pairs)
        assert Counter((g.doc_id, g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) for g in got.collect()) == want
    assert alignment.align(make_docs([])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(codec="utf-8")), max_size=40).map("".join))
def test_segments_do_not_change_tokens(text):
    (facts, digest, code, times), = ALIGNER.align([text])
    counts, groups, links = brute(text)
    assert (tuple(facts[:4].tolist()), digest) == (counts, groups)
    assert {(c >> 32, c & 0xFFFFFFFF): n for c, n in zip(code.tolist(), times.tolist(), strict=True)} == links


def test_memo_is_emptied():
    small = alignment.Aligner(*alignment.paths(), most=500)
    for k in range(30):
        text = " ".join(f"w{k}x{j}" for j in range(12))
        assert small.align([text])[0][1] == brute(text)[1]
        assert small.weight <= 2000


def test_product_equals_dense():
    r = np.random.default_rng(1)
    a, b = r.random((7, 9)) < 0.3, r.random((9, 5)) < 0.4

    def sparse(m):
        return csr.Csr(np.concatenate(([0], np.cumsum(m.sum(axis=1)))), np.nonzero(m)[1], m.shape[1])

    row, col, value = csr.multiply(sparse(a), sparse(b))
    dense = np.zeros((7, 5), int)
    dense[row, col] = value
    assert (dense == a.astype(int) @ b.astype(int)).all()
    turned = csr.transpose(sparse(a))
    assert (turned.ptr == sparse(a.T).ptr).all() and (turned.col == sparse(a.T).col).all()
