"""The near-dedup stage: exact on what it looks at, whole on families, linear in their size."""

import random

import numpy as np
import pytest

from tests.llm.conftest import ODD, prose
from tests.llm.test_operators import brute_copies, family, jaccard, near_copies
from tickerloom.llm import nearcopies


def kept(docs, texts):
    return {r.doc_id for r in nearcopies.keep_one(docs(list(enumerate(texts)))).collect()}


def edits(words, n, seed, step=6):
    own, r = list(words), random.Random(seed)
    for at in r.sample(range(0, len(words), step), n):
        own[at] = f"w{r.getrandbits(32)}"
    return own


def test_one_of_each_group_stays(docs):
    texts = near_copies(3, 600, 6) + near_copies(4, 120, 2)
    half = texts[0].split()
    texts += [" ".join(half[:450]) + " " + prose(77, 150)]  # similarity 0.6: no copy
    data = [*((10 + k, t) for k, t in enumerate(texts)), (4, prose(9, 80)), (4, prose(9, 80)), (9, prose(9, 80)), (None, None), (2, "")]
    got = nearcopies.keep_one(docs(data, clash=True))
    assert sorted((r.doc_id for r in got.collect()), key=repr) == [10, 16, 18, 2, 4]
    assert got.dtypes == docs([], clash=True).dtypes
    assert nearcopies.keep_one(docs([])).count() == 0
    assert nearcopies.keep_one(docs(ODD)).count() == len({t or "" if (t or "").strip() else "" for _, t in ODD})


@pytest.mark.parametrize("edited", [4, 6])  # about 0.77 and 0.67 similar, with copies hidden among them
def test_families_are_cut_as_by_brute_force(docs, edited, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 64)  # block against block
    template = prose(edited, 300).split()
    texts = [edits(template, edited, k) for k in range(150)]
    texts += [edits(t, 2 + k % 3, 1000 + k) for k, t in enumerate(texts[:50])]
    texts = [" ".join(t) for t in texts]
    assert kept(docs, texts) == set(brute_copies(texts))


def test_small_texts_are_compared_exactly(docs):
    texts = []
    for k in range(60):
        words = prose(k, 6 + k).split()
        texts += [" ".join(words), " ".join(words + ["more"] * (1 + k % 4)), " ".join(edits(words, 1, k, 1))]
    want = set(brute_copies(texts))
    assert len(want) < len(texts) and kept(docs, texts) == want


def test_pairs_just_above_the_similarity_are_found(docs):
    texts, near = [], []
    for k in range(400):
        words = prose(5000 + k, 90 + k % 250).split()
        other = edits(words, max(1, len(words) // 45), k)
        near.append(jaccard(" ".join(words), " ".join(other)) >= 0.8)
        texts += [" ".join(words), " ".join(other)]
    found = kept(docs, texts)
    at = [2 * k + 1 for k, ok in enumerate(near) if ok]
    assert len(at) > 250 and {k for k in range(0, 800, 2)} <= found
    assert sum(k not in found for k in at) >= 0.98 * len(at)


@pytest.mark.parametrize("edited", [2, 5])  # about 0.88 and 0.72 similar
def test_links_go_with_the_members_of_a_family(docs, spark, edited, monkeypatch):
    made, settled = [], nearcopies.base.settled

    def counted(df, name):
        out = settled(df, name)
        if name in ("links", "similar"):
            made.append(out.count())
        return out

    monkeypatch.setattr(nearcopies.base, "settled", counted)
    monkeypatch.setattr(nearcopies, "FEW", 8)
    rows = []
    for members in (100, 300):
        template = prose(edited, 300).split()
        made.clear()
        kept(docs, [" ".join(edits(template, edited, k)) for k in range(members)])
        rows.append(sum(made))
    assert rows[1] <= 3.5 * rows[0] + 100


def test_connected_joins_all_that_is_near():
    r = np.random.default_rng(1)
    f = r.integers(0, 1 << 16, (300, 1), dtype=np.uint64)
    a, b = nearcopies.connected(f, 3)
    assert len(a) < len(f)
    root = np.arange(len(f))
    for x, y in zip(a, b):
        root[root == root[y]] = root[x]
    near = np.bitwise_count(f ^ f.T) <= 3
    assert (root[:, None] == root[None])[near].all()


def test_sketches_keep_to_their_bound():
    r = random.Random(1)
    bits, pieces = nearcopies.pieces_for(10**5, 0.8)
    words, met, total = -(-bits * pieces // 64), 0, 1500
    most = nearcopies.bound(256, 0.8, 6), nearcopies.bound(64 * words, 0.8)
    for _ in range(total):
        n = r.randint(80, 400)
        both, m = [r.getrandbits(64) for _ in range(n)], round(n / 8)  # similarity 0.8: n of n + 2 * n / 8
        sets = [np.array(sorted(both + [r.getrandbits(64) for _ in range(m)]), np.uint64) for _ in range(2)]
        a, b = (nearcopies.sketch(x, words) for x in sets)
        assert np.bitwise_count(a[:4] ^ b[:4]).sum() <= most[0] and np.bitwise_count(a ^ b).sum() <= most[1]
        keys = [set(nearcopies.keys_of(x, y, bits, pieces, 0.8).tolist()) for x, y in zip(sets, (a, b))]
        met += bool(keys[0] & keys[1])
    assert met >= 0.98 * total
    assert nearcopies.pieces_for(10**9, 0.8)[0] > bits and nearcopies.pieces_for(1, 0.8) == (bits, pieces)


def test_deletion_variants_alone_find_what_is_within_their_bits(docs, spark, monkeypatch):
    none = spark.createDataFrame([], "u bigint, v bigint, ru bigint, rv bigint")
    monkeypatch.setattr(nearcopies, "_met", lambda *_: none)
    texts = near_copies(5, 900, 6)
    prints = [nearcopies.sketch(np.unique(nearcopies.shingle_hashes(t.encode(), 5)), 1) for t in texts]
    parts = list(range(len(texts)))
    for k, f in enumerate(prints):
        for j in range(k):
            if np.bitwise_count(f ^ prints[j])[0] <= 4 and jaccard(texts[j], texts[k]) >= 0.8:
                parts = [parts[j] if x == parts[k] else x for x in parts]
    assert len(set(parts)) < len(texts)
    assert len(kept(docs, texts)) == len(set(parts))
