"""Queries opN_<name> over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.llm import bpe, language, licenses, lm, middle, mincut, oph, quality, resampling, runs, setsketch, templates, toxicity
from contextmill.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = language.training_fold(F.col("doc_id"), 4, 2)
    out = language.identify(docs, language.fit(docs.where(learn)))
    return out.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS g FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f WHERE first < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM k
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = oph.neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = language.training_fold(F.col("doc_id"), 3, 1)
    machine = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, machine).select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op8_lbl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = language.training_fold(F.col("doc_id"), 5, 1)
    scratch = Scratch(spark, "lm")
    out = lm.scores(docs, lm.fit(docs.where(learn), scratch), scratch)
    return out.select("doc_id", (~learn).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


SQL_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM k),
r AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) WHERE doc_id IN (SELECT class_id FROM c)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i, any_value(x.n) AS na, any_value(y.n) AS nb FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS y FROM u UNION SELECT reach.x, u.b FROM reach JOIN u ON u.a = reach.y),
m AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component, c.class_id, w.doc_id) AS component_id,
       coalesce(m.component, c.class_id, w.doc_id) = w.doc_id AS kept, coalesce(c.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.x = c.class_id
"""


def op11_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = language.training_fold(F.col("doc_id"), 5, 0)
    space = quality.fit(docs, docs.where(learn), table(spark, sf_dir, "labels"))
    return quality.scores(docs, space).select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a feature's bytes by the table of its polynomial; ranks by one sort.
SQL_OP12 = r"""
WITH tab AS (SELECT list(t ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS t FROM range(256) r(b))),
texts AS (SELECT 'd' AS side, row_number() OVER () AS place, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
w AS (SELECT side, place, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
g AS (SELECT side, place, unnest(flatten(list_transform(range(1, 4), lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda x, y: xor(x >> 8, tab[1 + xor(x & 255, y)]))) % 10000 AS bucket FROM u, tab),
e AS (SELECT side, place, bucket FROM g JOIN c USING (f)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM e GROUP BY 1),
z AS (SELECT sum(s)::DOUBLE AS sa, sum(t)::DOUBLE AS ta FROM n),
k AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sa + 10000) / ((s + 1)::DOUBLE * (ta + 10000))))::BIGINT AS gain FROM n, z),
v AS (SELECT place, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM e JOIN k USING (bucket) WHERE side = 'd' GROUP BY 1),
d AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM (SELECT row_number() OVER () AS place, doc_id FROM documents) JOIN (SELECT place, ws FROM w WHERE side = 'd') USING (place) LEFT JOIN v USING (place)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM r
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


SQL_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_language_id, op2_substring_dedup, op3_fingerprints, op4_license_scan, op5_byte_bpe, op6_toxicity, op7_mincut_html, op8_lbl_score, op9_template_decontamination, op10_setsketch_near_dedup, op11_neighbour_quality, op12_importance_resampling, op13_fill_in_middle]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SQL_OP2, "op4_license_scan": licenses.sql(), "op10_setsketch_near_dedup": SQL_OP10, "op12_importance_resampling": SQL_OP12, "op13_fill_in_middle": SQL_OP13}
