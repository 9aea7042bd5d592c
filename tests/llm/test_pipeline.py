import random

import numpy as np

import corpus_pipeline as pipeline
from postmill.llm import simhash
from postmill.llm.queries import QUERIES, SQL


def test_stages(spark, make_docs, edge_texts, sf_dir):
    rng = random.Random(9)
    sentence = lambda n: " ".join(f"wort{rng.randrange(10 ** 5)}" for _ in range(n))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    body = sentence(200).split()
    near = list(body)
    near[100] = "anders"
    texts = dict(edge_texts) | {100: " ".join(body), 101: " ".join(near), 102: " ".join(body), 103: sentence(80) + " " + bench + " " + sentence(90),
                                104: sentence(60) + " mail a.b@c.example now", 105: sentence(60), 106: "12 34 !!"}
    docs = make_docs(texts, {i: "de" for i in texts})
    columns = docs.columns
    ids = lambda d: {r["doc_id"] for r in d.collect()}
    kept = pipeline.language(spark, docs, sf_dir)
    assert kept.columns == columns and ids(docs) - ids(kept) == {0, 1, 2, 6, 106}
    once = pipeline.near_duplicates(spark, kept, sf_dir)
    assert once.columns == columns and ids(kept) - ids(once) == {4, 101, 102}
    clean = pipeline.decontamination(spark, once, sf_dir)
    assert clean.columns == columns and ids(once) - ids(clean) == {103}
    private = pipeline.personal_data(spark, clean, sf_dir)
    rows = {r["doc_id"]: r for r in private.collect()}
    assert private.schema == clean.schema and rows[104]["text"].endswith(" mail <EMAIL> now") and rows[104]["n_chars"] == len(rows[104]["text"])
    assert ids(pipeline.sequences(spark, private, sf_dir)) == ids(clean)


def test_rows_are_judged_by_their_own_text(spark, make_docs, sf_dir):
    rng = random.Random(10)
    sentence = lambda n: " ".join(f"wort{rng.randrange(10 ** 5)}" for _ in range(n))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b, c, d = (sentence(60) for _ in range(4))
    leak = f"{sentence(30)} {bench} {sentence(30)}"
    rows = lambda f: sorted((str(r["doc_id"]), str(r["text"])) for r in f.collect())
    docs = make_docs([(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (3, a), (None, None), (None, None)])
    once = pipeline.near_duplicates(spark, docs, sf_dir)
    assert once.columns == docs.columns
    assert rows(once) == sorted([("1", a), ("2", b), ("None", c), ("3", d), ("None", "None"), ("None", "None")])
    docs = make_docs([(1, a), (1, leak), (None, leak), (None, b), (2, c)])
    assert rows(pipeline.decontamination(spark, docs, sf_dir)) == sorted([("1", a), ("None", b), ("2", c)])


def test_run_and_registry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    out = pipeline.run(spark, sf_dir)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_empty_documents_pass_every_stage(spark, make_docs, sf_dir):
    docs = make_docs({})
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else make_docs({})


def test_near_duplicates_take_the_links_of_the_fingerprints(spark, make_docs, sf_dir, monkeypatch):
    """What op5 puts into one class is compared, also where none of the other codes meet."""
    rng = random.Random(12)
    words = [f"wort{rng.randrange(10 ** 5)}" for _ in range(800)]
    texts = {0: " ".join(words), 50: " ".join(f"wort{rng.randrange(10 ** 5)}" for _ in range(300))}
    for i in range(1, 13):
        texts[i] = " ".join(words[:60 * i] + ["anders"] + words[60 * i + 1:])
    docs = make_docs(texts)
    together = {r["doc_id"] for r in simhash.classes(docs).filter("component_id = 0").collect()}
    assert len(together) > 4 and 50 not in together
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda codes, bits, *a, **k: links(codes if bits == simhash.BITS else codes.limit(0), bits, *a, **k))
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept & together == {0} and 50 in kept


def test_near_duplicates_compare_whole_classes(spark, make_docs, sf_dir):
    """What op5 puts into one class is compared exactly, however far apart the other codes are."""
    rng = random.Random(13)
    texts = {}
    for i in range(0, 400, 2):  # sets of four and five shingles, similar by 0.8; the repeats decide the fingerprint
        a, b, c, x, y = (f"wort{rng.randrange(10 ** 6)}" for _ in range(5))
        texts[i] = f"{' '.join([a, b, c] * 50)} {x}"
        texts[i + 1] = f"{texts[i]} {y}"
    found = {r["doc_id"]: np.frombuffer(r["sketch"], np.uint64) for r in simhash.sketches(make_docs(texts), "doc_id", "text").collect()}
    far = [i for i in range(0, 400, 2) if np.bitwise_count(found[i] ^ found[i + 1]).sum() > simhash.FAR]
    assert far
    docs = make_docs({j: texts[j] for i in far for j in (i, i + 1)})
    classes = {r["doc_id"]: r["component_id"] for r in simhash.classes(docs).collect()}
    one = [i for i in far if classes[i] == classes[i + 1]]
    assert one
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert set(one) <= kept and not kept & {i + 1 for i in one}


def test_unlike_texts_of_a_class_stay(spark, make_docs, sf_dir, monkeypatch):
    """Also where they are more than one round settles."""
    monkeypatch.setattr(simhash, "LEADERS", 5)
    rng = random.Random(14)
    line = " ".join(["eins zwei drei"] * 200)
    texts = {i: f"{line} {' '.join(f'wort{rng.randrange(10 ** 6)}' for _ in range(20))}" for i in range(12)}
    texts |= {100 + i: f"{texts[i]} ende" for i in range(12)}
    docs = make_docs(texts)
    assert {r["component_id"] for r in simhash.classes(docs).collect()} == {0}
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()} == set(range(12))
