"""Every operator against a brute-force version, on ordinary and on odd documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, prose
from tickerloom.llm import licenses, linedup, mixing, nearcopies, ogg, packing, quality, simhash, suffix, tokenfile, tokens, urllists

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- 1: run-length index --------------------------------------------------------------------


def brute_removed(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d) + 1)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_index_finds_every_repeat():
    from tickerloom.llm.runindex import RunIndex

    strings = [b"abcabcabx", b"zzabcabq", b"zz", b"aaaaaaa", b"q"]
    for length in (1, 2, 3, 5, 7):
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        assert [h.tolist() for h in RunIndex(strings).repeated(length)] == want
    index = RunIndex(strings)
    assert index.lengths.sum() == index.n and len(index.symbols) < index.n  # runs, not rows


def test_repeats_equal_brute_force(docs, spark, monkeypatch):
    shared, template = prose(7, 90), prose(8, 40)
    texts = [prose(k, 60) + " " + (shared if k % 3 else template) + prose(k + 50, 30) for k in range(30)]
    texts += [shared[:399], shared[:400], "ab" * 700, "x" * 2000, "", None, texts[0], template * 3]
    data = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    want = brute_removed([t for _, t in data], 400)
    want = sorted([(i, *w) for (i, _), w in zip(data, want)], key=repr)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(suffix.remove_repeats(docs(data, clash=True)), *cols) == want
    monkeypatch.setattr(suffix, "BUCKET", 2)  # crowded anchors go on to the next level
    assert rows(suffix.remove_repeats(docs(data)), *cols) == want


def test_planted_passages_go_and_clean_documents_stay(docs, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 8)  # occurrences of the common passage are dealt to blocks
    passage, common = prose(61, 110), prose(62, 110)
    assert min(len(p.encode()) for p in (passage, common)) > 400
    data = [(k, f"{prose(k + 700, 50)} {passage} {prose(k + 800, 50)}") for k in range(4)]
    data += [(100 + k, f"{prose(k + 1700, 40)} {common}") for k in range(60)]
    data += [(200 + k, prose(k + 2700, 150)) for k in range(30)] + [(k, prose(3, 300).replace("é", "e")[:399]) for k in (300, 301)]
    got = {r.doc_id: r for r in suffix.remove_repeats(docs(data)).collect()}
    assert all(got[k].n_removed >= len(passage.encode()) for k in range(4))
    assert all(got[100 + k].n_removed >= len(common.encode()) for k in range(60))
    assert not any(got[k].n_removed for k in [*range(200, 230), 300, 301])
    assert all(r.n_kept == len(r.kept) == r.n_bytes - r.n_removed for r in got.values())


def test_passages_of_the_benchmark_stay_below_400_bytes_and_go_from_there(docs, spark):
    """Passages of over 50 words can have fewer bytes than op1's strings: those stay, filled up to 400 they go."""
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()]
    items = [t for t in items if len(WORD.findall(t)) > 50]
    assert items and max(len(t.encode()) for t in items) < 398
    filled = [t + " " + "z" * (399 - len(t.encode())) for t in items]
    assert {len(t.encode()) for t in filled} == {400}

    def planted(passages, base):  # three documents a passage, none with the same byte beside it
        return [
            (base + 3 * k + j, f"{prose(base + 7 * k + j, 40)}{j}{t}{j}{prose(base + 9 * k + j, 40)}")
            for k, t in enumerate(passages)
            for j in range(3)
        ]

    data = planted(items, 0) + planted(filled, 10000)
    got = rows(suffix.remove_repeats(docs(data)), "doc_id", "n_removed", "n_spans")
    assert sorted(got) == sorted((i, *((400, 1) if i >= 10000 else (0, 0))) for i, _ in data)


def test_repeats_of_odd_documents(docs):
    out = suffix.remove_repeats(docs(ODD))
    want = sorted([(i, *w[:3]) for (i, _), w in zip(ODD, brute_removed([t for _, t in ODD], 400))], key=repr)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans") == want
    assert suffix.remove_repeats(docs([])).count() == 0


# --- 2: SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text, n):
    import xxhash

    w = [m.group().encode() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(values))]


def near_copies(seed, n, edits):
    words = prose(seed, n).split()
    return [" ".join(w if k != e else "edited" for k, w in enumerate(words)) for e in range(edits)]


def test_fingerprints_and_components_equal_brute_force(docs):
    texts = [t for s in range(4) for t in near_copies(s, 400, 12)] + [prose(k, 3) for k in range(20)]
    data = [*((100 + k, t) for k, t in enumerate(texts)), *ODD]
    fps = [brute_fingerprint(t, 4) for _, t in data]
    groups = defaultdict(list)
    for k, r in enumerate(brute_components(fps, 4)):
        groups[r].append(data[k][0])
    least = {r: min([i for i in ids if i is not None], default=None) for r, ids in groups.items()}
    want = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(data, fps, brute_components(fps, 4))]
    got = simhash.components_of(docs(data, clash=True))
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.components_of(docs([])).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_links_connect_planted_fingerprints(spark, bits, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "FEW", 4)
    r = random.Random(bits)
    values = set()
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            values.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, bits + 1)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for block in (4096, 3):
        links = simhash.links(fps, bits, block).collect()
        assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= bits for u, v in links)
        root = dict(zip(signed, signed))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for u, v in links:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        want = brute_components(values, bits)
        assert len({find(v) for v in signed}) == len(set(want))


def jaccard(a, b, n=5):
    def shingles(text):
        w = WORD.findall((text or "").lower())
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def family(seed, members, planted, words=300):
    """Texts of one template, about 0.74 similar, and edits of the first `planted` of them, 0.8 to 0.9."""
    import random

    r = random.Random(seed)
    template = prose(seed, words).split()

    def edited(text, n):
        own = list(text)
        for at in r.sample(range(0, words, 6), n):
            own[at] = f"w{r.getrandbits(32)}"
        return own

    texts = [edited(template, 5) for _ in range(members)]
    texts += [edited(t, 4 + k % 3) for k, t in enumerate(texts[:planted])]
    return [" ".join(t) for t in texts]


def brute_copies(texts, similarity=0.8):
    """The least place of each text's component of pairs with this similarity."""
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    for b, own in enumerate(sets):
        for a in range(b):
            k = len(sets[a] & own)
            if k >= similarity * (len(sets[a]) + len(own) - k):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return [find(k) for k in range(len(texts))]


def test_texts_with_one_very_common_shingle_stay(docs):
    texts = ["x " * 200 + prose(k, 60) for k in range(3)] + ["y " * 200 + prose(4, 60)]
    assert max(jaccard(a, b) for k, a in enumerate(texts) for b in texts[:k]) < 0.2
    got = nearcopies.keep_one(docs(list(enumerate([*texts, texts[0].upper()]))))
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3]


def test_hot_keys_are_dealt_to_blocks(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, 1L, id) AS key", "id AS fp")
    got = simhash.dealt(rows, simhash.hot_keys(rows, 100))
    groups = defaultdict(set)
    for r in got.collect():
        groups[r["group"]].add(r["fp"])
    assert max(map(len, groups.values())) < 300
    assert {frozenset((a, b)) for g in groups.values() for a in g for b in g if a < b} == {frozenset((a, b)) for b in range(900) for a in range(b)}
    assert "windowspecdefinition(key" not in got._jdf.queryExecution().toString()


def test_large_groups_give_forests():
    f = np.array([1 << k for k in range(40)] + [0], np.uint64)
    u, v = simhash.forest(f, 2)
    assert len(u) == len(f) - 1 == len(set(v.tolist()))


# --- 3: mixing --------------------------------------------------------------------------------------


def brute_targets(sizes):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in sizes if s not in capped)
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / free if free else 0
        over = {s for s in sizes if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= over


def test_targets_and_fit(docs):
    data = [(k, prose(k, 1 + k * 37 % 90), f"s{k % 7}") for k in range(300)]
    data += [(500, "one two", "tiny"), (501, "a b c", None), (502, None, "void"), (503, "", "void"), (7, prose(7, 11), "s0"), (7, prose(7, 11), "s0")]
    sizes = defaultdict(int)
    for _, text, source in data:
        sizes[source] += len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    got = mixing.mix(docs(data, clash=True)).collect()
    assert len(got) == len(data)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["times"] <= 3 and r["taken"] == r["size"] * r["times"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        if s in ("tiny", None):  # two documents of a few words: targets at their tops
            assert taken[s] == 3 * sizes[s] == want[s]
        else:
            assert abs(taken[s] - want[s]) <= 1
    assert rows(mixing.mix(docs(data)), "doc_id", "size", "times") == rows(mixing.mix(docs(data)), "doc_id", "size", "times")
    again = mixing.take(docs(data, clash=True))
    assert again.count() == sum(r["times"] for r in got) and again.columns == docs([], clash=True).columns
    assert mixing.mix(docs([])).count() == 0 and mixing.take(docs([])).count() == 0


def test_fit_reaches_the_best_sum():
    from itertools import product

    for lengths, counts, budget in (([3, 5, 11], [4, 2, 3], 31), ([7, 100], [2, 1], 50), ([4, 6], [3, 3], 29)):
        sums = {sum(n * k for n, k in zip(lengths, ks)) for ks in product(*(range(c + 1) for c in counts))}
        take = mixing.fit(lengths, counts, budget, most=8)
        assert all(0 <= take[n] <= c for n, c in zip(lengths, counts))
        assert sum(n * k for n, k in take.items()) <= budget
        take = mixing.fit(lengths, counts, budget)
        assert sum(n * k for n, k in take.items()) <= max(s for s in sums if s <= budget)
    assert mixing.fit([10**6], [3], 2 * 10**6 + 5) == {10**6: 2}


# --- 4: packing ---------------------------------------------------------------------------------------


def test_pieces_cover_every_document(docs, library):
    data = [*((100 + k, prose(k, 5 + 61 * k % 700)) for k in range(60)), *ODD]
    got = packing.pack(docs(data, clash=True)).collect()
    want = sorted(((i, len(ids_of(library, t)) + 1) for i, t in data), key=repr)
    whole = Counter((i, n) for i, n in want)
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sum(p[1] for p in v) for k, v in parts.items()} == {k: k[1] * c for k, c in whole.items()}
    for i, text in data:
        ids = [*ids_of(library, text), packing.END_ID]
        own = [p for p in parts[i, len(ids)] if crc(ids[p[0] : p[0] + p[1]]) == p[2]]
        assert sum(p[1] for p in own) >= len(ids)
    for own in seqs.values():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[0][0] == 0
        total = sum(n for _, n in own)
        assert total == 4096 or total & (total - 1) == 0
    assert packing.pack(docs([])).count() == 0


def test_pool_is_bounded_and_nothing_is_lost():
    packer = packing.Packer(0, window=64, pool=10)
    out = []
    for k in range(200):
        out += packer.add(k, (k).to_bytes(4, "little") * (1 + k * 7 % 150))
        assert packer.n <= 11
    out += packer.finish()
    total = Counter()
    for doc, _, n, _, whole, _, _ in out:
        total[doc, whole] += n
    assert all(n == whole for (_, whole), n in total.items()) and len(total) == 200


def test_fullest_is_best():
    counts = {7: 2, 12: 1, 30: 1}
    sums = {7 * a + 12 * b + 30 * c: (a, b, c) for a in range(3) for b in range(2) for c in range(2)}
    for room in range(60):
        took = packing.fullest(counts, room)
        assert sum(n * k for n, k in took.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in took.items())


# --- 5: quality rules -----------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_equal_brute_force(docs):
    data = [*ODD, (20, "a b c d e " * 3), (21, "one\n\ntwo\none\n \n# two"), (22, prose(5, 30) + "\n" + prose(5, 30)), (23, "** | <b>\r\nx\x0by")]
    got = quality.judge(quality.measure(docs(data, clash=True)))
    want = []
    for i, t in data:
        c = brute_counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert rows(got, "doc_id", *quality.COUNTS, "base_failed") == sorted(want, key=repr)
    kept = quality.keep_good(docs(data, clash=True))
    assert kept.columns == docs([], clash=True).columns
    assert rows(kept, "doc_id") == sorted([(r.doc_id,) for r in got.collect() if r.kept], key=repr)
    assert quality.keep_good(docs([])).count() == 0


def test_clean_prose_is_kept_and_junk_is_not(docs):
    stop = "the of and to a in is that it for was on".split()
    clean = "\n".join(" ".join(f"{stop[(k * 5 + j * j) % 12]} {w}" for j, w in enumerate(prose(k, 12).split())) for k in range(8))
    junk = " ".join(w + "***" for w in clean.split())
    got = {r.doc_id: r for r in quality.judge(quality.measure(docs([(1, clean), (2, junk), (3, " ".join(f"zq{k}x" for k in range(60)))]))).collect()}
    assert got[1].kept, got[1]
    assert not got[2].kept and "symbols_per_word" in got[2].broken
    assert got[3].broken == ["stop_words_per_word"]


# --- 6: token tables ---------------------------------------------------------------------------------------


def test_words_encode_like_whole_texts(library):
    enc = tokens.Encoder(tokens.default_tokenizer(), words_kept=50)
    odd = "Σας ΟΔΟΣ İx ß ́a é \x85a\xa0b\x1cc it's I'LL <|endoftext|> ½²ª q<|x ÀÉ\xad don't 12,5%  漢字 　 🙂 ﬁ"
    for text in [odd, prose(1, 500), "", " ", "A" * 500, odd.replace("<|endoftext|>", "")]:
        assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == ids_of(library, text)


def test_token_table_round_trip(docs, spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", 4)
    data = [*((100 - k, prose(k, 3 + 29 * k % 200)) for k in range(40)), *ODD]
    path = tokenfile.write_tokens(docs(data, clash=True), str(tmp_path / "t"))
    got = tokenfile.read_tokens(spark, path).join(tokenfile.starts(spark, path), ["shard", "block", "at"])
    got = got.orderBy("start").collect()
    want = sorted(((i, crc(ids_of(library, t) + [1])) for i, t in data), key=repr)
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=repr) == want
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at += r.n_tokens
        last = -1 if r.doc_id is None else r.doc_id
    one = tokenfile.fetch(spark, path, 77).collect()
    assert [r.ids for r in one] == [ids_of(library, dict(data)[77]) + [1]]
    assert tokenfile.fetch(spark, path, 10**6).count() == 0
    assert len(tokenfile.fetch(spark, path, 4).collect()) == 2
    empty = tokenfile.write_tokens(docs([]), str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, empty).count() == 0 == tokenfile.starts(spark, empty).count()


def test_wrong_dictionary_is_refused(docs, spark, tmp_path):
    path = tokenfile.write_tokens(docs([(k, prose(k, 300)) for k in range(30)]), str(tmp_path / "t"))
    unpack = tokenfile.unpacker(b"", "another", "<u2")
    row = tokenfile.blocks(spark, path).first()
    with pytest.raises(ValueError, match="dictionary"):
        unpack(row.dict_hash, row.offsets, row.payload, 0)


# --- 7: URL lists ----------------------------------------------------------------------------------------------


def test_hosts(spark):
    urls = ["http://A.Example.com:80/x", "https://u:p@b.org.", "ftp://c", "no url", None, "http:///x", "http://d?e@f"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(urllists.host(F.col("u"))).collect()] == ["a.example.com", "b.org", "c", None, None, None, "d"]


def test_captures_as_of(spark):
    import datetime as dt

    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    entries = [
        ("example.com", d(10), "block"), ("example.com", d(50), "allow"), ("a.example.com", d(20), "allow"),
        ("example.com", d(50), "block"), ("A.example.com", d(60), "block"), (None, d(1), "block"), ("x.org", None, "block"),
        ("ample.com", d(1), "block"), ("b.net", d(0), "allow"), ("b.net", d(400), "block"),
    ]
    captures = [("http://a.example.com/", k) for k in (5, 10, 19, 20, 59, 60, 500)]
    captures += [("http://example.com/", 49), ("http://example.com/", 50), ("http://b.net/", 399), ("http://c.b.net/", 400), ("bad", 3), (None, 3), ("http://x.org", 3), ("http://b.net/", None)]
    captures += captures[:2]
    frame = spark.createDataFrame([(u, None if k is None else d(k), "z", "y") for u, k in captures], "url string, fetched date, `_host` string, host string")
    listed = spark.createDataFrame(entries, "pattern string, since date, action string")
    got = urllists.filter_captures(frame, listed)

    def brute(url, k):
        host = re.match(r"http://([^/]+)", url or "")
        if not host or k is None:
            return None, True
        labels = host[1].split(".")
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            known = [(s, a) for p, s, a in entries if p and p.lower() == name and s and s <= d(k)]
            if known:
                last = max(s for s, _ in known)
                action = max(a for s, a in known if s == last)
                return action, action != "block"
        return None, True

    want = sorted([(u, None if k is None else d(k), *brute(u, k)) for u, k in captures], key=repr)
    assert rows(got, "url", "fetched", "action", "kept") == want
    assert got.columns == ["url", "fetched", "_host", "host", "pattern", "listed_since", "action", "kept"]
    assert urllists.filter_captures(frame, listed.limit(0)).filter("kept").count() == len(captures)
    assert urllists.filter_captures(frame.limit(0), listed).count() == 0


# --- 8: licenses ------------------------------------------------------------------------------------------------------


def test_licenses(docs):
    grant = licenses.TEMPLATES["mit-grant"]
    words = grant.split()
    edited = " ".join(w if k != len(words) - 2 else "changed" for k, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    data = [*ODD, (10, prose(1, 300) + " " + grant + " " + prose(2, 300)), (11, edited), (12, half), (13, "Released under the MIT License."), (13, "Released under the MIT License."), (14, "x\nLicensed under CC BY-NC 4.0.\ny"), (None, "released UNDER the mit license")]
    got = rows(licenses.scan(docs(data, clash=True)), "doc_id", "template")
    assert got == sorted([(10, "mit-grant"), (11, "mit-grant"), (13, "mit"), (14, "cc-by-nc-4.0"), (None, "mit")], key=repr)
    assert licenses.scan(docs([])).count() == 0
    assert licenses.scan(docs(data), templates={"none": "no such words stand here anywhere"}).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan(docs(data), templates={"short": "too short"})


# --- 9: Ogg -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 576, 577, 1152, 48_960, 48_961, 300_000])
def test_ogg_round_trip(n):
    data = bytes(k * 7 % 256 for k in range(n))
    payload = ogg.padded(data)
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n) and payload.startswith(data)
    media = ogg.encode(payload)
    back, times = ogg.decode(media)
    assert back == payload
    assert sum(map(len, times.values())) == len(payload) // 576
    assert all(t == pytest.approx([576 * (k + 1) / 8000 for k in range(len(t))]) for t in times.values())


def test_ogg_checksum_is_the_formats():
    def slow(data):
        reg = 0
        for b in data:
            reg ^= b << 24
            for _ in range(8):
                reg = (reg << 1 ^ 0x04C11DB7 if reg & 1 << 31 else reg << 1) & 0xFFFFFFFF
        return reg

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow(data)


def test_ogg_refuses_damage():
    media = ogg.encode(ogg.padded(b"abc" * 3000))
    for at in (0, 5, 40, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(broken))
    with pytest.raises((ValueError, Exception)):
        ogg.decode(media[:-100])


def test_ogg_packets_cross_pages():
    big = [(b"h" * 10, 0), (b"p" * 70_000, 70_000), (b"q" * 255, 70_255), (b"", 70_255)]
    pages = ogg._pages(9, big)
    assert len(pages) >= 3 and [p for p, _, _ in ogg.demultiplex(b"".join(p[-1] for p in pages))[9]] == [p for p, _ in big]


def test_media_of_odd_documents(docs, spark, tmp_path):
    got = ogg.read_media(spark, ogg.write_media(docs(ODD, clash=True), str(tmp_path / "m")))
    want = []
    for i, t in ODD:
        data = (t or "").encode()
        p = ogg.padded(data)
        want.append((i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    assert ogg.read_media(spark, ogg.write_media(docs([]), str(tmp_path / "e"))).count() == 0


# --- 10: line dedup ----------------------------------------------------------------------------------------------------


def brute_lines(data):
    order = sorted({(i is None, i or 0, t or "") for i, t in data})
    seen, out = set(), {}
    for key in order:
        lines = key[2].split("\n")
        worded = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for p in range(len(worded) - 2):
            w = tuple(lines[worded[p + k]] for k in range(3))
            if w in seen:
                gone |= {worded[p + k] for k in range(3)}
            seen.add(w)
        out[key] = (len(worded), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return [(i, *out[i is None, i or 0, t or ""][:2], out[i is None, i or 0, t or ""][2] if t is not None else None) for i, t in data]


def test_line_windows_equal_brute_force(docs):
    block = "first line\nsecond line\nthird line"
    data = [
        (1, f"a\n{block}\nb"), (2, f"{block}\n\nc\n{block}"), (3, "x\n" * 6), (4, "first line\nsecond line\nother"),
        (5, f"second line\nthird line\nb\n{block}"), (5, f"second line\nthird line\nb\n{block}"), (None, f"{block}\nq"), *ODD,
    ]
    data = [(i, t) for i, t in data if i != 4 or t != prose(1, 200)] + [(4, prose(1, 200))]
    got = linedup.remove_lines(docs(data, clash=True))
    assert rows(got, "doc_id", "n_lines", "n_removed", "text") == sorted(brute_lines(data), key=repr)
    assert linedup.remove_lines(docs([])).count() == 0
