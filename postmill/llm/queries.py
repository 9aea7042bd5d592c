"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    decontaminate, katz, langid, licenses, packing, pii, quality, ranking, simhash, substrings, urls, vectors, whitening)
from postmill.llm.common import fold, table
from postmill.sources.staging import stage


def vocabulary() -> str:
    """Place of the vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stage(quality.features(docs), "quality-features")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2).select("doc_id", "quality")
    forest = quality.fit(stats, labels)
    return quality.score(stats, forest).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = katz.fit(docs.filter(fold("doc_id", 7) != 2))
    return katz.score(docs, model).select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0))
    return langid.identify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.word_idf(docs))
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.annotate(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.BASE_KINDS)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed values of the query: action, host, beginning of the path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_katz": op4_katz,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_vectors": op9_vectors,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_ranking": op12_ranking,
    "op13_urls": op13_urls,
}

_PLAIN_WORDS = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ATTRIBUTE = ("replace(trim(regexp_extract(tag, '(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1), "
              "'\"'' ' || chr(9) || chr(10) || chr(13)), '&amp;', '&')")

SQL = {
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
ds AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d),
b AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
j AS (SELECT r, doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY r, doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM j JOIN n USING (item_id) WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9)""",
    "op12_ranking": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_PLAIN_WORDS}) AS term FROM benchmark),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
v AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term),
x AS (SELECT t.r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * docs) // words))) AS part
      FROM t JOIN v USING (term) JOIN d ON d.r = t.r, c),
s AS (SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY item_id, r),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_urls": rf"""
WITH RECURSIVE p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest,
                            regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script\s*>', '', 'g') AS html FROM pages),
a AS (SELECT page_id, url, {_LOWERED.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
             {_LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node, html FROM p),
l AS (SELECT a.*, {_ATTRIBUTE.format(name="rel")} AS rel, {_ATTRIBUTE.format(name="href")} AS target, split_part(url, '://', 1) AS scheme
      FROM (SELECT a.* EXCLUDE (html), unnest(regexp_extract_all(html, '(?i)<link\s[^>]*>')) AS tag FROM a) a),
m AS (SELECT a.*, {_ATTRIBUTE.format(name="http-equiv")} AS equiv, {_ATTRIBUTE.format(name="content")} AS content, split_part(url, '://', 1) AS scheme
      FROM (SELECT a.* EXCLUDE (html), unnest(regexp_extract_all(html, '(?i)<meta\s[^>]*>')) AS tag FROM a) a),
named AS (SELECT scheme, host, path, node, target FROM l WHERE list_contains(string_split_regex(lower(rel), '\s+'), 'canonical')
          UNION ALL SELECT scheme, host, path, node, regexp_extract(content, '(?i)^[0-9.\s]*[;,]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1) FROM m WHERE lower(equiv) = 'refresh'),
seen AS (SELECT node, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
                           WHEN starts_with(target, '//') THEN scheme || ':' || target WHEN starts_with(target, '/') THEN scheme || '://' || host || target
                           WHEN starts_with(target, '?') THEN scheme || '://' || host || path || target
                           WHEN starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                           ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '(?s)^.*/'), ''), '/') || target END AS other
         FROM named WHERE target <> ''),
e AS (SELECT DISTINCT node AS a, {_LOWERED.format("regexp_extract(substr(other, strpos(other, '://') + 3), '^[^/?#]*')")}
             || regexp_extract(substr(other, strpos(other, '://') + 3), '^[^/?#]*([^#]*)', 1) AS b FROM seen WHERE contains(other, '://')),
pairs AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
nodes AS (SELECT node, regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path
          FROM (SELECT node FROM a WHERE node IS NOT NULL UNION SELECT a FROM pairs)),
rules (action, rhost, rpath) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
named_by AS (SELECT node, action, rhost || rpath AS rule, row_number() OVER (PARTITION BY node ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, action) AS place
             FROM nodes JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
decided AS (SELECT node, action, rule FROM named_by WHERE place = 1),
reached AS (SELECT node FROM decided WHERE action = 'block' UNION SELECT b FROM reached JOIN pairs ON a = node)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN r.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM a LEFT JOIN decided d ON d.node = a.node LEFT JOIN reached r ON r.node = a.node""",
}
