"""Quality, language and n-gram models against brute force or held-out accuracy."""

import collections
import math
import random

import numpy as np

from postmill.llm import katz, langid, quality


def test_flat_trees_equal_nested_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality.grow(x, y, trees=30)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node]:
                node = forest.left[node] + int(row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])
    fresh = rng.normal(size=(400, 4))
    assert (((fresh[:, 0] > 0.2) ^ (fresh[:, 2] > 0.5)) == (forest.score(fresh) > 0.5)).mean() > 0.95


def test_no_labels_and_one_label():
    x = np.zeros((3, len(quality.FEATURES)))
    assert np.allclose(quality.grow(x[:0], np.zeros(0)).score(x), 0.5)
    assert (quality.grow(x, np.ones(3)).score(x) > 0.99).all()


def test_quality_of_edge_texts(spark, make_docs, edge_texts):
    docs = make_docs({**edge_texts, 50: "a b c. d e f.", 51: "BUY!! NOW!! BUY!! NOW!!"})
    stats = quality.features(docs)
    labels = spark.createDataFrame([(50, 1), (51, 0), (999, 1), (50, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.score(stats, quality.fit(stats, labels)).collect()}
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    assert rows[0]["score"] == rows[1]["score"] and rows[3]["score"] == rows[4]["score"]
    assert quality.score(quality.features(make_docs({})), quality.fit(stats, labels)).count() == 0


def test_held_out_quality(spark, sf_dir):
    from postmill.llm.queries import op2_quality
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op2_quality(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.85


LATIN, GREEK = "lorem ipsum dolor sit amet consectetur", "αλφα βητα γαμμα δελτα"


def test_languages_mixtures_and_edges(make_docs, edge_texts):
    texts = {100 + i: LATIN for i in range(5)} | {200 + i: GREEK for i in range(5)}
    model = langid.fit(make_docs(texts, {i: "la" if i < 200 else "el" for i in texts}))
    assert model.names == ("el", "la")
    mixed = " ".join([LATIN] * 6 + [GREEK] * 4)
    docs = make_docs({**edge_texts, 300: LATIN, 301: GREEK, 302: mixed, 303: "αβγ 12"})
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 6)] == ["und"] * 4 and rows[0]["score"] == 0.0
    assert rows[300]["lang_pred"] == "la" and rows[301]["lang_pred"] == "el" and rows[303]["lang_pred"] == "el"
    assert set(rows[302]["langs"]) == {"la", "el"} and 0.5 < rows[302]["langs"]["la"] < 0.8
    assert set(rows[300]["langs"]) == {"la"}
    assert all(r["lang_pred"] != "und" for i, r in rows.items() if i in (3, 5, 7, 8))


def test_mixtures_match_a_direct_search(make_docs):
    """Shares and sets of each text against expectation-maximisation written out for one text at a time."""
    rng = random.Random(5)
    kinds = {"aa": "lorem ipsum dolor sit amet", "bb": "the of and to in that", "cc": "der die und das nicht ein"}
    train = {10 * i + k: " ".join(rng.choice(v.split()) for _ in range(30)) for i, v in enumerate(kinds.values()) for k in range(3)}
    model = langid.fit(make_docs(train, {i: list(kinds)[i // 10] for i in train}))
    texts = {200 + i: " ".join(rng.choice(kinds[rng.choice(list(kinds)[:1 + i % 3])].split()) for _ in range(rng.randrange(1, 40))) for i in range(12)}
    rows = {r["doc_id"]: r["langs"] for r in langid.identify(make_docs(texts), model).collect()}

    def em(like, allowed):
        share = [1 / len(allowed)] * len(allowed)
        for _ in range(langid.ROUNDS):
            parts = [[w[k] * s for k, s in zip(allowed, share)] for w in like]
            share = [sum(p[j] / sum(p) for p in parts) / len(like) for j in range(len(allowed))]
        return share, sum(math.log(sum(w[k] * s for k, s in zip(allowed, share))) for w in like)

    for i, t in texts.items():
        like = []
        for word in t.split():
            bins, _, _, _ = langid._grams(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
            logs = model.log_p[bins].astype(float).sum(0)
            like.append([math.exp(x - logs.max()) for x in logs])
        order = sorted(range(3), key=lambda k: -em(like, [0, 1, 2])[0][k])
        best, best_value = None, -math.inf
        for size in (1, 2, 3):
            share, value = em(like, order[:size])
            value -= (size - 1) * math.log(len(like) + 1)
            if value <= best_value:
                break
            best, best_value = dict(zip([model.names[k] for k in order[:size]], share)), value
        assert set(rows[i]) == set(best) and all(abs(rows[i][k] - best[k]) < 1e-6 for k in best)


def test_more_languages_than_a_block(make_docs):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k % 20:k % 20 + 6]) for _ in range(6))
    texts = {i: " ".join([f"l{i:03d}x".replace("0", "q").replace("1", "w")] + [word(i) for _ in range(4)]) for i in range(300)}
    texts |= {1000 + i: LATIN for i in range(4)} | {2000 + i: GREEK for i in range(4)}
    langs = {i: f"v{i}" if i < 1000 else "la" if i < 2000 else "el" for i in texts}
    model = langid.fit(make_docs(texts, langs))
    assert len(model.names) == 302 and model.names[0] in ("la", "el")
    rows = {r["doc_id"]: r for r in langid.identify(make_docs({**texts, 5000: LATIN, 5001: GREEK}), model).collect()}
    assert rows[5000]["lang_pred"] == "la" and rows[5001]["lang_pred"] == "el"
    assert sum(rows[i]["lang_pred"] == langs[i] for i in range(300)) > 200


def test_no_language_learned(make_docs):
    model = langid.fit(make_docs({1: "text"}))
    assert [r["lang_pred"] for r in langid.identify(make_docs({1: "text"}), model).collect()] == ["und"]


def brute_katz(train, texts, least):
    tokens = lambda t: [w.lower() for w in (t or "").split()] + ["</s>"]
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        one.update(tokens(t))
        two.update(zip(["<s>", *tokens(t)[:-1]], tokens(t), strict=True))
    d1 = katz.discounts(collections.Counter(one.values()), 1)
    d2 = katz.discounts(collections.Counter(two.values()), least)
    cut = lambda c, d: (d[c] if c < len(d) else 1.0) * c
    n = sum(one.values())
    left = n - sum(cut(c, d1) for c in one.values())
    total, left = (n, left) if left > 0 else (n + 1, 1.0)
    p1 = lambda w: cut(one[w], d1) / total if w in one else left / total
    after = collections.defaultdict(dict)
    for (h, w), c in two.items():
        if c >= least:
            after[h][w] = cut(c, d2)
    size = {**one, "<s>": len(train)}

    def p(w, h):
        kept = after.get(h, {})
        if not kept:
            return p1(w)
        mass = sum(kept.values())
        full = size[h] if mass < size[h] - 1e-6 else size[h] + 1
        return kept[w] / full if w in kept else (1 - mass / full) / (1 - sum(map(p1, kept))) * p1(w)

    def score(t):
        total_, h = 0.0, "<s>"
        for w in tokens(t):
            total_ += math.log10(p(w, h))
            h = w
        return total_

    vocabulary = [*one, "unseen"]
    for h in ["<s>", *one]:
        assert math.isclose(sum(p(w, h) for w in vocabulary), 1.0, rel_tol=1e-9)
    return {i: score(t) for i, t in texts.items()}


def test_katz_matches_normalised_recursion(make_docs):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(80)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(40))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "Never SEEN before", 103: "w1 " * 2000}
    train = {i: t for i, t in texts.items() if i < 50}
    for least in (2, 3):
        want = brute_katz(list(train.values()), texts, least)
        for frequent in (4, 1 << 17):
            model = katz.fit(make_docs(train), least=least, part=100, frequent=frequent)
            rows = {r["doc_id"]: r for r in katz.score(make_docs(texts), model).collect()}
            assert {i: round(r["score"], 8) for i, r in rows.items()} == {i: round(s, 8) for i, s in want.items()}
            assert rows[100]["n_tokens"] == 1 and rows[102]["n_known"] == 1
            assert math.isclose(rows[101]["base_score"], rows[100]["base_score"])


def test_katz_keeps_every_bigram(make_docs):
    rng = random.Random(3)
    texts = {i: " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(40))) for i in range(60)}
    train = {i: t for i, t in texts.items() if i < 50}
    pairs = {p for t in train.values() for w in [["<s>", *t.split(), "</s>"]] for p in zip(w, w[1:], strict=False)}
    model = katz.fit(make_docs(train), part=500, frequent=4)
    assert sum(r["n"] for r in model.bigrams.collect()) == len(pairs) and model.bigrams.count() > 1
    want = brute_katz(list(train.values()), texts, 1)
    rows = {r["doc_id"]: r for r in katz.score(make_docs(texts), model).collect()}
    assert {i: round(r["score"], 8) for i, r in rows.items()} == {i: round(s, 8) for i, s in want.items()}


def test_katz_without_training_texts(make_docs):
    model = katz.fit(make_docs({}))
    rows = katz.score(make_docs({1: "a b", 2: None}), model).collect()
    assert {(r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in rows} == {(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)}
    assert katz.score(make_docs({}), model).count() == 0


def test_katz_scores_every_row_with_its_own_id(make_docs):
    model = katz.fit(make_docs({1: "a b a b c", 2: "a b"}))
    rows = katz.score(make_docs([(1, "a b"), (1, "c c c"), (None, "a"), (None, None), (2, "a b")]), model).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == [("1", 3), ("1", 4), ("2", 3), ("None", 1), ("None", 2)]
    assert len({r["score"] for r in rows if r["n_tokens"] == 3}) == 1


def test_packed_columns_round_trip():
    rng = np.random.default_rng(0)
    codes = np.concatenate([rng.integers(0, katz._RANKS, 50), rng.integers(1 << 62, 1 << 63, 50)]).astype(np.uint64) | np.where(np.arange(100) < 50, 0, 1 << 63).astype(np.uint64)
    for x in (codes, rng.permutation(codes), codes[:0], codes[:1]):
        assert (katz.unpack_codes(katz.pack_codes(x)) == x).all() and (katz.unpack_numbers(katz.pack_numbers(x)) == x).all()


def test_bigrams_are_sorted_and_found_where_numbers_clash(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(katz, "mix", lambda x: (x % np.uint64(5)) << np.uint64(40))
    h, w = rng.integers(0, 30, 4000).astype(np.uint64), rng.integers(0, 30, 4000).astype(np.uint64)
    order, first, _ = katz.sorted_pairs(h, w)
    pairs = list(zip(h[order].tolist(), w[order].tolist(), strict=True))
    assert [p for i, p in enumerate(pairs) if not i or p != pairs[i - 1]] == [pairs[i] for i in first] and len(first) == len(set(pairs))
    a, b, n = katz._distinct(h, w, np.ones(len(h), np.int64))
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == collections.Counter(zip(h.tolist(), w.tolist(), strict=True))
    part = object.__new__(katz._Part)
    order, first, number = katz.sorted_pairs(a, b)
    part.h, part.w, part.number, part.gains = a[order], b[order], number, n[order].astype(float)
    ask = [(np.uint64(i), np.uint64(j)) for i in range(32) for j in range(32)]
    got = part.gain(*(np.array(x) for x in zip(*ask, strict=True)))
    held = dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))
    assert got.tolist() == [float(held.get((int(i), int(j)), 0)) for i, j in ask]


def test_frequent_words_get_their_ranks():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 5000):
        words = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64) | katz.TOP)
        rng.shuffle(words)
        ranks = katz.Ranks.of(words, np.ones(len(words), np.int64), 3, 4, 100)
        others = rng.integers(0, 1 << 62, 100).astype(np.uint64) | katz.TOP
        assert (ranks.codes(words) == np.arange(len(words))).all() and (ranks.codes(others) == others).all()
