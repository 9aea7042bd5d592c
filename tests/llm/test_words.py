import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import words
from postmill.llm.common import key_chunks, local_roots


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té.1"))))
def test_words_are_those_of_split(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    found = words.texts_of(batch, lower=False)
    for i, t in enumerate(texts):
        assert found.bytes_of(i) == (t or "").encode().split()
    word = [w for t in texts for w in (t or "").encode().split()]
    h = found.hashes()
    assert len(set(h.tolist())) == len(set(word))
    assert all((h[i] == h[j]) == (word[i] == word[j]) for i in range(len(word)) for j in range(i))


def test_runs_hash_alike_wherever_they_stand():
    x = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64)
    h = words.run_hash(x, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_slices_keep_rows_whole_and_in_order():
    texts = ["a" * n for n in (5, 0, 100, 3, 50)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(words.slices(iter([batch]), size=20))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert len(parts) > 2


def test_key_chunks_never_cut_a_key():
    keys = [0] * 5 + [1] * 7 + [2] + [3] * 4
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 3])], names=["k"]) for i in range(0, len(keys), 3)]
    chunks = [c["k"].to_pylist() for c in key_chunks(iter(batches), ["k"], 2)]
    assert sum(chunks, []) == keys
    assert all(not set(a) & set(b) for i, a in enumerate(chunks) for b in chunks[:i])


def test_local_roots_are_smallest_reachable():
    assert local_roots(6, np.array([5, 4, 2]), np.array([4, 1, 3])).tolist() == [0, 1, 2, 2, 1, 1]


def test_words_hash_alike_in_parts_and_at_once(monkeypatch):
    texts = ["ab  c " * 40, None, "x" * 300, "", " c ab", "é " * 50]
    found = words.texts_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))
    whole = found.hashes()
    monkeypatch.setattr(words, "PART", 16)
    assert (found.hashes() == whole).all() and len(whole) == 40 * 2 + 1 + 2 + 50
    assert len(words.texts_of(pa.RecordBatch.from_arrays([pa.array([None, ""], pa.string())], names=["text"])).hashes()) == 0
