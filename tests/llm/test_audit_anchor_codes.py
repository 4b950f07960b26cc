"""Source divergence, fixed-block anchors and vector codes against brute-force versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ODD, prose
from tickerloom.llm import anchors, base, divergence, vectorcodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- 11: source divergence ------------------------------------------------------------------------


def brute_audit(data, least=3, top=200):
    """data: (text, lang, source) -> rows of the audit."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(la or "", so or "", TERM.findall(lower(t or ""))) for t, la, so in data]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for la, so, terms in docs:
            if la == lang:
                df.update(set(terms))
                counts[so].update(terms)
        kept = sorted(t for t, n in df.items() if n >= least)
        total = {so: sum(c[t] for t in kept) for so, c in counts.items()}
        shares = lambda c, n: [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]
        p = {so: shares(c, total[so]) for so, c in counts.items()}
        q = shares(sum(counts.values(), Counter()), sum(total.values()))
        gap = lambda a, b: (a - b) ** 2 // b
        for so in counts:
            near = [(-sum(map(gap, p[so], p[o])), o) for o in counts if o != so]
            more = [(-gap(a, b), t) for t, a, b in zip(kept, p[so], q) if counts[so][t] and a > b]
            for part, found in (("pair", near), ("term", more)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                found = found if part == "pair" else found[:top]
                out += [(lang, so, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


@pytest.fixture
def audited(spark):
    def make(data, clash=False):
        df = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], "doc_id bigint, text string, lang string, source string")
        if clash:
            df = df.selectExpr("*", "0 AS t0", "'x' AS terms", "0 AS n", "'x' AS lang_no", "0 AS index", "'x' AS part", "0 AS p")
        return df.repartition(3) if data else df

    return make


def audit_data():
    data = [(f"{prose(k % 7, 40)} Straße ZÜRICH {k % 5} x{chr(97 + k % 9)}", ("en", "de", None)[k % 3], f"s{k % 4}") for k in range(60)]
    return data + [(None, "en", None), ("", "fr", "a"), ("rare words only", "fr", "b"), ("solo", "it", "x"), (data[0])] * 2


def test_audit_equals_brute_force(audited, monkeypatch):
    data = audit_data()
    want = brute_audit(data)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in want)
    assert rows(divergence.audit(audited(data, clash=True)), *AUDIT) == want
    monkeypatch.setattr(divergence, "VOCABULARY", 90)  # many vectorizers, shared ones too, tiles and tasks
    monkeypatch.setattr(divergence, "OWN", 2)
    monkeypatch.setattr(divergence, "HELD", 100)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "CELLS", 50)
    assert rows(divergence.audit(audited(data), least=2, top=3), *AUDIT) == brute_audit(data, 2, 3)


def test_audit_of_odd_and_empty_tables(audited, docs):
    assert divergence.audit(audited([])).count() == 0
    assert rows(divergence.audit(docs(ODD)), *AUDIT) == brute_audit([(t, "en", "s") for _, t in ODD])
    assert divergence.audit(audited([("1 2 3", "en", "a"), (None, "en", "b")])).count() == 2


def test_audit_shares_are_exact_for_large_counts(spark):
    n, total = 10**15 + 7, 10**16
    df = spark.createDataFrame([(n, total, 10**8)], "n bigint, total bigint, terms bigint")
    got = df.select(divergence.share("n", "total", "terms").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + 10**8)


# --- 12: fixed-block anchors -----------------------------------------------------------------------


def brute_windows(data, window=13):
    """data: (doc_id, text) -> (doc_id, n_words, n_removed, digest) of each row."""
    last = math.inf
    texts = [(last if i is None else i, WORD.findall(t or "")) for i, t in data]
    least = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            least[w] = min(least.get(w, last), i)
    out = []
    for (i, _), (key, words) in zip(data, texts):
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < key:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


BLOCKS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def repeated_texts():
    passage = [prose(900 + k, 12 + k) for k in range(6)]  # 12 to 17 words: some are too short
    data = [(3 * k, f"{prose(k, 5 + k % 9)} {passage[k % 6]}\n{prose(k + 99, k % 11)} {passage[(k * 5) % 6]}") for k in range(40)]
    data += [(7, data[0][1]), (200, data[4][1]), (201, data[4][1] + " tail"), (-5, "head " + data[7][1]), (None, data[3][1])]
    return data + [(300, "a b " * 40), (301, "b a " * 30), (302, "a " * 13), (303, "a " * 12), (200, data[4][1]), *ODD]


def test_anchors_equal_brute_force(docs, monkeypatch):
    data = repeated_texts()
    want = brute_windows(data)
    assert 20 < sum(w[2] > 0 for w in want) < len(want)
    assert rows(anchors.remove_repeats(docs(data, clash=True)), *BLOCKS) == want
    monkeypatch.setattr(anchors, "SLICE_WORDS", 60)  # many slices, many buckets, colliding hashes
    monkeypatch.setattr(anchors, "BUCKET", 50)
    monkeypatch.setattr(anchors, "ANCHOR_BITS", 8)
    assert rows(anchors.remove_repeats(docs(data)), *BLOCKS) == want
    assert rows(anchors.remove_repeats(docs(data), window=4), *BLOCKS) == brute_windows(data, 4)
    assert anchors.remove_repeats(docs([])).count() == 0


def test_anchors_give_what_stays(docs):
    passage = prose(1, 30)
    data = [(1, "one " + passage), (2, f"two  {passage}\nthree"), (3, None)]
    got = {r.doc_id: r for r in anchors.remove_repeats(docs(data)).collect()}
    assert got[1].kept.decode() == data[0][1] and got[1].n_spans == 0
    assert (got[2].kept, got[2].n_kept, got[2].n_removed, got[2].n_spans) == (b"two three", 2, 30, 1)
    assert (got[3].kept, got[3].n_words) == (b"", 0)


def test_anchors_catch_planted_passages_and_leave_the_rest(docs):
    passage = prose(5, 60)
    data = [(k, f"{prose(k + 10, 80)} {passage} {prose(k + 500, 80)}") for k in range(20)]
    data += [(100 + k, prose(k + 2000, 200)) for k in range(20)]
    got = {r.doc_id: r.n_removed for r in anchors.remove_repeats(docs(data)).collect()}
    assert got[0] == 0 and all(60 <= got[k] <= 62 for k in range(1, 20)) and not any(got[100 + k] for k in range(20))


# --- 13: vector codes --------------------------------------------------------------------------------


def brute_codes(data, rounds=6):
    """data: (vec_id, embedding, label), ids distinct -> rows and codebooks."""
    kept = [(i, v, la) for i, v, la in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    parts = [[[math.floor(4096 * x) for x in p] for p in np.array_split(v, 8)] for _, v, _ in kept]
    books = [[parts[k][p] for k in range(min(16, len(kept)))] for p in range(8)]

    def nearest(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for own in parts:
                groups[nearest(p, own[p])[0]].append(own[p])
            for e, found in groups.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found)]
    out, by_label = [], Counter()
    for (i, _, la), own in zip(kept, parts):
        found = [nearest(p, own[p]) for p in range(8)]
        out.append((i, bytes(e for e, _ in found).hex(), sum(d for _, d in found), la))
        by_label[la] += out[-1][2]
    return sorted([(*r[:3], by_label[r[3]]) for r in out], key=repr), books


def vectors(n, seed=0, dim=16):
    r = np.random.default_rng(seed)
    near = r.integers(-3, 4, (n, dim)) / 8 + r.integers(0, 2, (n, dim)) / 4096  # many shared prefixes
    return [[float(np.float32(x)) for x in v] for v in near]


SCHEMA = "vec_id bigint, embedding array<float>, label int"
CODES = ["vec_id", "code", "error", "label_error"]


def labelled(found):
    codes, books = found
    total = Counter()
    data = codes.collect()
    for r in data:
        total[r.label] += r.error
    return sorted([(r.vec_id, r.code, r.error, total[r.label]) for r in data], key=repr), books.tolist()


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "LEAVES", 7)  # the walk descends instead of looking at all at once
    data = [(k * 7 % 307, v, None if k % 5 == 0 else k % 4) for k, v in enumerate(vectors(300))]
    data += [(1000, None, 1), (1001, [None] + [0.5] * 15, 1), (1002, [math.nan] + [0.5] * 15, 1), (-1, [math.inf] * 16, 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3).selectExpr("*", "0 AS code", "0 AS n", "'x' AS position", "0 AS error")
    assert labelled(vectorcodes.encode(df)) == brute_codes(data)


def test_codes_of_odd_tables(spark):
    few = [(k, v, k) for k, v in enumerate(vectors(5, 3))]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert labelled(vectorcodes.encode(make(few))) == brute_codes(few)
    assert vectorcodes.encode(make([]))[0].count() == 0
    assert vectorcodes.encode(make([(1, None, 1), (None, [math.nan], None)]))[0].count() == 0
    empty = vectorcodes.encode(make([(1, [], 1), (2, [], 1)]))[0]
    assert rows(empty, "vec_id", "code", "error") == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    same = [(k, few[0][1], 0) for k in range(40)]  # equal vectors: ties go to the first entry
    assert labelled(vectorcodes.encode(make(same))) == brute_codes(same)
    repeated = few + [few[0], (0, few[1][1], 9), (None, few[2][1], 3), (9, few[0][1][:8], 1)]
    got = labelled(vectorcodes.encode(make(repeated)))[0]
    assert len(got) == 8 and got.count(next(r for r in got if r[0] == 0 and r[3] != 9)) >= 1
    with pytest.raises(Exception, match="magnitude"):
        vectorcodes.encode(make([(1, [1e9] * 16, 1)]))[0].count()


@pytest.mark.parametrize("leaves", [1, 5, 10**6])
def test_walk_gives_the_first_nearest_entry(leaves):
    r = np.random.default_rng(leaves)
    found, _, _ = vectorcodes.distinct(r.integers(-2, 3, (400, 4)))
    assert (found == np.unique(found, axis=0)).all()
    book = r.integers(-2, 3, (6, 4))
    far = ((found[:, None] - book) ** 2).sum(axis=2)
    best, least = vectorcodes.walk(found, book, leaves)
    assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_registered_codes_equal_brute_force(spark):
    got = vectorcodes.op13(spark, "/root/testdata/sf0.001")
    data = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = brute_codes(data)
    flat = ",".join(str(x) for b in books for e in b for x in e)
    assert rows(got, *CODES) == want
    assert {r.codebooks_sha256 for r in got.collect()} == {hashlib.sha256(flat.encode()).hexdigest()}


def test_registered_anchors_equal_brute_force(spark):
    data = [tuple(r) for r in base.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()]
    assert rows(anchors.op12(spark, "/root/testdata/sf0.001"), *BLOCKS) == brute_windows(data)
