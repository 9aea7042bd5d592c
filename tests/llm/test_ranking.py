import math
import random
import re

import numpy as np
import pytest

from postmill.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, ranks=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df, tf = {}, []
    for _, w in held:
        tf.append({t: w.count(t) for t in set(w)} if len(w) < 5000 else {t: w.count(t) for t in set(w)})
        for t in tf[-1]:
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for (doc, w), f in zip(held, tf, strict=True):
            m = 100 - 90 + (90 * len(w) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * f[t]) // (1000 * f[t] + 8 * m)) for t in own if t in f)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:ranks])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, bucket, first", [(1 << 19, 4096, 4096), (60, 7, 5)])
def test_ranks_match_brute_force(spark, make_docs, edge_texts, block, bucket, first):
    rng = random.Random(block)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["naïve", "日本", "Éa", "a1b"]
    line = lambda n: ", ".join(rng.choice(words) for _ in range(n))
    docs = list(edge_texts.items()) + [(100 + i, line(rng.randrange(1, 120))) for i in range(150)]
    docs += [(300 + i, docs[40][1]) for i in range(40)] + [(101, line(30)), (None, docs[30][1]), (None, line(9)), (90, line(4000))]
    items = [(i, line(rng.randrange(1, 40))) for i in range(25)] + [(50, None), (51, ""), (52, "!!"), (53, "nowhere"), (54, docs[40][1]),
                                                                     (3, line(5)), (None, line(4)), (None, line(3)), (55, "a"), (56, line(300))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted((tuple(r) for r in ranking.rank(make_docs(docs), table, block=block, bucket=bucket, first=first).collect()), key=str)
    assert got == brute(docs, items) and len(got) > 200
    assert ranking.rank(make_docs({}), table).count() == 0
    assert ranking.rank(make_docs(docs), table.limit(0)).count() == 0


def test_bounds_leave_out_most_vectors_and_nothing_that_ranks():
    """Pruning is exact, and it prunes."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    size, rows = 500, 3000
    lists = [np.sort(rng.choice(size, rng.integers(2, 12), replace=False)) for _ in range(rows)]
    impacts = [rng.integers(1, 1_000_000, len(t)) for t in lists]
    length = np.array([math.sqrt(float((v.astype(float) ** 2).sum())) for v in impacts])
    order = np.argsort(-length)
    whole = pa.table({"doc": pa.array(order), "length": pa.array(length[order]), "terms": pa.array([lists[i].astype(np.int32) for i in order]),
                      "impacts": pa.array([impacts[i] for i in order])})
    queries = [ranking.Query.of(np.sort(rng.choice(size, 6, replace=False)), rng.integers(0, 12_000, 6)) for _ in range(40)]
    best, scored = ranking.Best(np.ones(len(queries), np.int64), 10), []
    add = best.add
    best.add = lambda item, score, doc, known: (scored.append(len(score)), add(item, score, doc, known))
    for begin in range(0, rows, 200):
        ranking._search_bucket(whole.slice(begin, 200), queries, size, best, np.zeros(size, np.int64))
    for i, q in enumerate(queries):
        weight = dict(zip(q.terms.tolist(), q.weights.tolist(), strict=True))
        want = sorted(((-sum(weight.get(t, 0) * v for t, v in zip(lists[d].tolist(), impacts[d].tolist(), strict=True)), d) for d in range(rows)))[:10]
        want = [(-s, d) for s, d in want if s < 0]
        score, doc, _ = best.held[i]
        assert list(zip(score.tolist(), doc.tolist(), strict=True)) == want
    assert sum(scored) < 0.05 * rows * len(queries)


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ranking, "run_hash", lambda data, start, end: (end - start).astype(np.uint64))
    vocabulary, number = ranking.Vocabulary.of([b"ab", b"cd", b"xyz", b"ef"])
    data = np.frombuffer(b"efxyzcdabqqxyw", np.uint8)
    start, end = np.array([0, 2, 5, 7, 9, 11]), np.array([2, 5, 7, 9, 11, 14])
    assert vocabulary.alike == 3
    assert vocabulary.find(data, start, end).tolist() == [number[3], number[2], number[1], number[0], -1, -1]
