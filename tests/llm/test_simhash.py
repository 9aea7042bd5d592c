import random

import numpy as np
import pytest
import xxhash

from postmill.llm import simhash
from postmill.llm.common import components


def fingerprint(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(codes, budget):
    root = {i: i for i in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(codes)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (codes[i] ^ codes[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_classes_match_brute_force(make_docs, edge_texts):
    rng = random.Random(5)
    texts = dict(edge_texts)
    for i in range(60):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))]
        texts[100 + i] = " ".join(words)
        words[0] = "Changed"
        texts[200 + i] = " ".join(words)
    want = {i: fingerprint(t) for i, t in texts.items()}
    rows = {r["doc_id"]: r for r in simhash.classes(make_docs(texts)).collect()}
    assert {i: r["fp"] % (1 << 64) for i, r in rows.items()} == want
    assert {i: r["component_id"] for i, r in rows.items()} == classes_of(want, 3)


@pytest.mark.parametrize("node_rows", [20_000, 20, 3])
@pytest.mark.parametrize("bits", [64, 32])
def test_links_lose_nothing_when_nodes_are_split(spark, node_rows, bits):
    rng = random.Random(bits)
    codes, seen = {}, set()
    for i in range(400):
        base = rng.getrandbits(bits) if i % 4 else 7 << (bits - 8)
        code = base if i % 3 else base ^ sum(1 << rng.randrange(bits) for _ in range(3))
        if i % 5 == 0 and codes:
            code = rng.choice(list(codes.values())) ^ (1 << rng.randrange(bits)) ^ (1 << rng.randrange(bits))
        code %= 1 << bits
        if code not in seen:
            seen.add(code)
            codes[i] = code
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    table = spark.createDataFrame([(0, i, signed(c)) for i, c in codes.items()], "tab int, node long, code long")
    found = {r["id"]: r["component"] for r in components(simhash.links(table, bits, 3, node_rows)).collect()}
    want = classes_of(codes, 3)
    assert {i: found.get(i, i) for i in codes} == want
    assert len(set(want.values())) < len(codes)


def grouped_sketches(rng, centres, copies, flips):
    out = []
    for _ in range(centres):
        base = rng.integers(0, 1 << 63, 5).astype(np.uint64)
        for _ in range(copies):
            one = base.copy()
            for bit in rng.integers(0, 320, rng.integers(0, flips)):
                one[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            out.append(one)
    return np.array(out)[rng.permutation(len(out))]


def roots_of(n, pairs):
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return simhash.local_roots(n, i, j)


@pytest.mark.parametrize("flips", [2, 60, 120])
def test_representatives_connect_like_all_pairs(flips):
    rng = np.random.default_rng(flips)
    for centres, copies in ((1, 200), (7, 40), (150, 2), (200, 1)):
        x = grouped_sketches(rng, centres, copies, flips)
        near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None]).sum(2) <= simhash.FAR)
        pairs = list(simhash.connecting(x, simhash.FAR, len(x)))
        assert all((np.bitwise_count(x[i] ^ x[j]).sum(1) <= simhash.FAR).all() for i, j in pairs)
        assert (roots_of(len(x), pairs) == simhash.local_roots(len(x), near[:, 0], near[:, 1])).all()


def test_near_copies_are_not_enumerated():
    x = grouped_sketches(np.random.default_rng(1), 1, 20_000, 20)
    assert sum(len(i) for i, _ in simhash.connecting(x, simhash.FAR, len(x))) == len(x) - 1


@pytest.mark.parametrize("node_rows", [20_000, 40, 6])
def test_equal_codes_are_linked_by_their_sketches(spark, node_rows):
    rng = np.random.default_rng(3)
    x = grouped_sketches(rng, 20, 6, 90)
    code = np.where(np.arange(len(x)) % 3 == 0, 5, np.where(np.arange(len(x)) % 3 == 1, 5 ^ (1 << 20), 77 << 20))
    rows = [(0, i, int(c), v.tobytes()) for i, (c, v) in enumerate(zip(code, x, strict=True))]
    table = spark.createDataFrame(rows, "tab int, node long, code long, sketch binary")
    found = {r["id"]: r["component"] for r in components(simhash.links(table, 32, 3, node_rows, far=simhash.FAR)).collect()}
    near = (np.bitwise_count(x[:, None] ^ x[None]).sum(2) <= simhash.FAR) & (np.bitwise_count(code[:, None] ^ code[None]) <= 3)
    at = np.argwhere(near)
    assert [found.get(i, i) for i in range(len(x))] == simhash.local_roots(len(x), at[:, 0], at[:, 1]).tolist()


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_duplicates_are_similar_to_what_stays(make_docs, edge_texts):
    rng = random.Random(11)
    texts = dict(edge_texts)
    for group in range(8):
        body = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60, 300))]
        for copy in range(6):
            words = list(body)
            for _ in range(copy * len(words) // 150):
                words[rng.randrange(len(words))] = "other"
            texts[1000 + 10 * group + copy] = " ".join(words)
    out = {r["doc_id"]: r["kept"] for r in simhash.duplicates(make_docs(texts)).collect()}
    similar = lambda a, b: len(a & b) / len(a | b)
    sets = {i: shingles(t) for i, t in texts.items()}
    kept = [i for i in texts if i not in out]
    assert all(v in kept and similar(sets[i], sets[v]) >= 0.8 for i, v in out.items())
    missed = [(a, b) for n, a in enumerate(kept) for b in kept[:n] if sets[a] and sets[b] and similar(sets[a], sets[b]) >= 0.85]
    assert not missed
    assert not {0, 1, 2} & set(out) and out[4] == 3


def test_empty_table(make_docs):
    assert simhash.classes(make_docs({})).count() == 0
    assert simhash.duplicates(make_docs({})).count() == 0


def test_majority_needs_more_than_half():
    one, two = np.uint64(1), np.uint64(3)
    assert simhash._majority(np.array([one, two], np.uint64), np.array([0]), np.array([2])).tolist() == [1]


def test_leaders_are_compared_exactly():
    rng = np.random.default_rng(4)
    some = lambda n: np.sort(rng.choice(400, n, replace=False)).astype(np.uint64)
    leaders, sets, met = simhash._Leaders(0.8), [], 0
    for doc in range(300):
        own = some(int(rng.integers(1, 12))) if doc % 3 else np.sort(np.append(sets[int(rng.integers(len(sets)))][1][1:] if sets else some(9), [1000 + doc])).astype(np.uint64)
        want = next((d for d, x in sets if len(np.intersect1d(own, x)) >= 0.8 * len(np.union1d(own, x)) - 1e-9), None)
        assert leaders.first(own) == want
        met += want is not None
        if want is None:
            leaders.add(doc, own)
            sets.append((doc, own))
    assert met and len(sets) > 50
    long = np.arange(10_000, 15_000, dtype=np.uint64)
    leaders.add(-1, long)
    for doc in range(300, 320):
        leaders.add(doc, some(20))
    assert leaders.first(long[100:]) == -1 and leaders.first(long[2000:]) is None
