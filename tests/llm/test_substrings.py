import hashlib
import random

import pytest

from postmill.llm import substrings


def brute(texts, length):
    first = {}
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for j in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][j:j + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if first[tuple(w[j:j + length])] < i:
                gone[j:j + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, k", [(8, 3), (50, 10)])
def test_removed_words_match_brute_force(make_docs, edge_texts, length, k):
    rng = random.Random(length)
    word = lambda: rng.choice("abcdefgh")
    passage = [str(rng.random()) for _ in range(3 * length)]
    texts = dict(edge_texts)
    for i in range(40):
        a = rng.randrange(length)
        body = [word() if length < 10 else str(rng.random()) for _ in range(rng.randrange(80))]
        if i % 2:
            body += passage[a:a + rng.randrange(2 * length)]
        if i % 5 == 0:
            body += passage
        if i % 7 == 0 and body:
            body[len(body) // 2] = "changed"
        texts[100 + i] = "  ".join(body)
    texts[200] = texts[105]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedupe(make_docs(texts), length=length, k=k).collect()}
    assert got == brute(texts, length)


def test_kept_text_and_empty_table(make_docs):
    docs = make_docs({1: " ".join(map(str, range(60))), 2: "start " + " ".join(map(str, range(60)))})
    rows = {r["doc_id"]: r["kept_text"] for r in substrings.dedupe(docs, with_text=True).collect()}
    assert rows[2] == "start" and rows[1] == " ".join(map(str, range(60)))
    assert substrings.dedupe(make_docs({})).count() == 0


def test_texts_of_one_id_lose_their_own_words_only(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(80))
    docs = make_docs([(1, passage), (2, f"x {passage}"), (2, other), (2, "short"), (2, f"x {passage}"), (None, passage), (3, other)])
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedupe(docs, with_text=True).collect())
    assert got == sorted([("1", 60, 0, passage), ("2", 61, 60, "x"), ("2", 80, 0, other), ("2", 1, 0, "short"), ("2", 61, 60, "x"),
                          ("None", 60, 0, passage), ("3", 80, 80, "")])
