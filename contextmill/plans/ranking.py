"""Queries of scans, ranking and packing, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import packing, ranking
from contextmill.sources import bindings as B

KEYS = ["thatin", "ononst", "inoran", "hehely", "orantion"]
BUDGET = 24_000
_SCORE = " + ".join(f"least(4.0, 0.25 * CAST((length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)} AS BIGINT))" for k in KEYS)
_SCORED = f"{B.SQL_FILES}, scored AS (SELECT doc_id, path, text, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, sha1(text) AS h, CAST({_SCORE} AS DOUBLE) AS score FROM files)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return B.files(spark, d).select("doc_id", "path", "text", S.tokens(F.col("text")).alias("tokens"), F.sha1("text").alias("h"), ranking.content_score(F.col("text"), KEYS).alias("score"))


def pack_prefix_stop(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts by score, until the budget overflows. Only hash, id, tokens and score are shuffled."""
    best = scored(spark, d).where("score > 0").groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("order"), "doc_id", "tokens")).alias("b"))
    return packing.best_within(best.select("b.doc_id", "b.tokens", (-F.col("b.order")).alias("score")), [F.desc("score"), F.asc("doc_id")], BUDGET).select("rank", "doc_id", "score", "tokens", F.col("used").alias("used_tokens"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their rank in the run; positions repeat in the table."""
    return B.packed(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy("position", "part", "original", "compressed")).cast("long"))


def pack_greedy_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = _placed(spark, d).select("run", "rank", F.col("compressed").alias("tokens"))
    return packing.greedy_skip(rows, 1500, ["run"])


def pack_multi_tier(spark: SparkSession, d: str) -> DataFrame:
    tiers = F.array("original", "compressed", F.floor(F.col("compressed") / 4))
    return packing.best_tiers(_placed(spark, d).select("run", "rank", tiers.alias("tiers")), 1500, ["run"]).select("run", "rank", F.col("tier").cast("long").alias("tier"), "tokens", "used")


def pack_progressive(spark: SparkSession, d: str) -> DataFrame:
    tiers = F.array("original", "compressed", F.floor(F.col("compressed") / 4))
    return packing.progressive(_placed(spark, d).select("run", "rank", F.col("score").alias("relevance"), tiers.alias("tiers")), 1500, "run")


def rank_file_score(spark: SparkSession, d: str) -> DataFrame:
    f = B.files(spark, d).select("doc_id", F.concat("path", F.when(F.col("doc_id") % 3 == 0, "_test.py").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".ts")).alias("path"), "text")
    names = F.when(F.col("doc_id") % 5 == 0, f"def {KEYS[0]}_{KEYS[0]}").when(F.col("doc_id") % 5 == 1, f"class {KEYS[3].upper()}").otherwise("")
    base = ranking.base_score(F.col("path"), F.col("text"), names, S.line_count(F.col("text")), KEYS, ("src1",)) * ranking.role_factor(F.col("path"), KEYS)
    out = f.select("doc_id", S.file_role(F.col("path")).alias("role"), F.round(S.clamp(base, 0, 10), 4).alias("score")).where("score > 0")
    return out


_PATH_HITS = " + ".join(f"2.0 * CAST((length(lower(path)) - length(replace(lower(path), '{k}', ''))) / {len(k)} AS BIGINT)" for k in KEYS)
_NAMED = {KEYS[0]: "CASE WHEN doc_id % 5 = 0 THEN 2.0 ELSE 0.0 END", KEYS[3]: "CASE WHEN doc_id % 5 = 1 THEN 1.0 ELSE 0.0 END"}
_IN_TEXT = "CAST((length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1} AS BIGINT)"
_TEXT_OR_NAMES = " + ".join(f"CASE WHEN {_IN_TEXT.format(k, len(k))} > 0 THEN least(4.0, 0.25 * {_IN_TEXT.format(k, len(k))}) ELSE {_NAMED.get(k, '0.0')} END" for k in KEYS)
SQL_FILE_SCORE = f"""WITH {B.SQL_FILES}, named AS (SELECT doc_id, path || CASE doc_id % 3 WHEN 0 THEN '_test.py' WHEN 1 THEN '.md' ELSE '.ts' END AS path, text, doc_id % 3 AS m FROM files),
base AS (SELECT doc_id, m, (CASE WHEN contains(path, 'src1') THEN 1.0 ELSE 0.0 END) + {_PATH_HITS} + {_TEXT_OR_NAMES} + CASE WHEN m <> 1 THEN 0.35 ELSE 0.0 END + CASE WHEN m = 0 THEN 0.25 ELSE 0.0 END
  - CASE WHEN length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 0 ELSE 1 END > 500 THEN 0.2 ELSE 0.0 END AS s FROM named)
SELECT doc_id, CASE m WHEN 0 THEN 'test' WHEN 1 THEN 'docs' ELSE 'prod' END AS role, score FROM (SELECT doc_id, m, round(greatest(0.0, least(10.0, s * CASE m WHEN 0 THEN 0.6 WHEN 1 THEN 0.4 ELSE 1.0 END)), 4)::DOUBLE AS score FROM base) WHERE score > 0"""


def token_estimators(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*[F.lit(m) for m in ("heuristic", "gpt-4o", "claude-x", "unknown")])
    rows = B.files(spark, d).select("doc_id", "text", F.explode(models).alias("model"))
    n = F.when(F.col("model") == "heuristic", S.tokens(F.col("text"))).otherwise(S.model_tokens(F.col("text"), F.col("model")))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("samples"), F.sum(n).alias("tokens"))


SQL_ESTIMATORS = """SELECT model, count(*) AS samples, CAST(sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE ceil(length(text) / ratio) END) AS BIGINT) AS tokens
FROM documents, (VALUES ('heuristic', 4.0::DOUBLE), ('gpt-4o', 3.55::DOUBLE), ('claude-x', 3.9::DOUBLE), ('unknown', 3.7::DOUBLE)) m(model, ratio) GROUP BY model"""


def dup_reads_prevented(spark: SparkSession, d: str) -> DataFrame:
    by = B.files(spark, d).select(F.sha1("text").alias("h"), S.tokens(F.col("text")).alias("tokens")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"))
    return by.agg(F.sum(F.col("n") - 1).alias("duplicate_reads_prevented"), F.sum((F.col("n") - 1) * F.col("tokens")).alias("tokens_prevented"))


def line_dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "documents").select("source", F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return packing.first_seen_lines(rows, "source").groupBy("source").agg(F.count(F.lit(1)).alias("distinct_lines"), F.sum(F.length("line")).cast("long").alias("chars"), F.sum(F.col("pos").cast("long")).alias("places"))


SQL_LINES = """WITH l AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
f AS (SELECT source, line, min({'file': doc_id, 'pos': pos}) AS at FROM l WHERE line <> '' GROUP BY ALL)
SELECT source, count(*) AS distinct_lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(f.at.pos) AS BIGINT) AS places FROM f GROUP BY source"""


def scan_classify(spark: SparkSession, d: str) -> DataFrame:
    f = B.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    kind = F.when(F.col("source") == "src3", "excluded").when(F.col("lang") == "es", "ignored").when(F.octet_length("text") > 6000, "too_large").when(F.instr("text", "\x00") > 0, "binary").when(F.length(F.trim("text")) == 0, "unreadable").otherwise("included")
    return f.select("doc_id", kind.alias("kind"), F.octet_length("text").cast("long").alias("size_bytes"), S.line_count(F.col("text")).alias("line_count"), F.sha1("text").alias("content_hash"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\s*([A-Za-zÀ-ÿ]+)"), F.lit(1))).cast("long").alias("heads"))


SQL_CLASSIFY = r"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)
SELECT doc_id, CASE WHEN source = 'src3' THEN 'excluded' WHEN lang = 'es' THEN 'ignored' WHEN strlen(text) > 6000 THEN 'too_large' WHEN contains(text, chr(0)) THEN 'binary' WHEN length(trim(text)) = 0 THEN 'unreadable' ELSE 'included' END AS kind,
CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS line_count,
sha1(text) AS content_hash, CAST(len(regexp_extract_all(text, '(?m)^\s*([A-Za-zÀ-ÿ]+)', 1)) AS BIGINT) AS heads FROM f"""


def secret_exclusion(spark: SparkSession, d: str) -> DataFrame:
    globs = ["*.pem", "*.env", "*/id_rsa", "*credentials.json", "*/9?"]
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    pattern = "|".join(f"(?:{S.glob_pattern(g)})" for g in globs)
    return B.table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", "path", F.col("path").rlike(pattern).alias("secret"))


SQL_SECRET = r"""SELECT page_id, path, regexp_matches(path, '\.pem$|\.env$|/id_rsa$|credentials\.json$|/9.$') AS secret
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"""


def keyword_extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "turn", F.array_join(S.keywords(F.col("text")), ",").alias("keywords"))


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_SQL_KEYS = rf"""w AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[a-zA-Z][a-zA-Z0-9_]{{2,}}') AS ws FROM conversations),
u AS (SELECT rid, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM w), c AS (SELECT rid, i, w, string_split(regexp_replace(regexp_replace(w, '([A-Z])([A-Z][a-z])', ' ', 'g'), '([a-z0-9])([A-Z])', ' ', 'g'), ' ') AS p FROM u),
a AS (SELECT rid, i, unnest([lower(w)] || CASE WHEN len(p) > 1 THEN list_transform(p, lambda x: lower(x)) ELSE [] END) AS k, unnest(range(0, 1 + CASE WHEN len(p) > 1 THEN len(p) ELSE 0 END)) AS j FROM c),
f AS (SELECT rid, k, min((i, j)) AS place FROM a WHERE length(k) >= 3 AND k NOT IN ({_STOP}) GROUP BY rid, k), g AS (SELECT rid, list(k ORDER BY place)[1:16] AS keys FROM f GROUP BY rid),
k AS (SELECT conv_id, turn, role, text, coalesce(keys, []) AS keys FROM w LEFT JOIN g USING (rid))"""


def keyword_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.keyword_window(B.files(spark, d), KEYS).select("path", F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"))


SQL_WINDOWS = f"""WITH {B.SQL_FILES}, l AS (SELECT path, string_split(text, chr(10)) AS ls FROM files), e AS (SELECT path, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM e WHERE regexp_matches(lower(line), '{'|'.join(KEYS)}')),
x AS (SELECT DISTINCT path, unnest(range(greatest(i - 1, 1), least(i + 1, n) + 1)) AS i FROM h WHERE k <= 6), o AS (SELECT path, i, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM x)
SELECT path, CAST(min(i) AS BIGINT) AS start_line, CAST(max(i) AS BIGINT) AS end_line FROM o WHERE k <= 120 GROUP BY path, i - k"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


SQL_EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def import_graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return ranking.degrees(edges(spark, d)).select("path", F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"))


def _node_scores(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.round(F.col("p_size") / 10.0, 1).alias("score"))
    supplier = B.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.round((F.col("s_suppkey") % 31) / 10.0, 1).alias("score"))
    return part.union(supplier)


def graph_one_hop_boost(spark: SparkSession, d: str) -> DataFrame:
    entries = B.table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("path"))
    return ranking.one_hop(_node_scores(spark, d), edges(spark, d), entries).select("path", F.round("boost", 4).alias("boost")).where("boost > 0")


SQL_ONE_HOP = f"""WITH {SQL_EDGES}, n AS (SELECT 'p' || p_partkey AS path, round(p_size / 10.0, 1) AS score FROM part UNION ALL SELECT 's' || s_suppkey, round((s_suppkey % 31) / 10.0, 1) FROM supplier),
seed AS (SELECT path FROM n WHERE score >= 2.0), ent AS (SELECT 's' || s_suppkey AS path FROM supplier WHERE s_suppkey % 7 = 0),
i AS (SELECT dst AS path, count(*) AS c FROM edges WHERE src IN (SELECT path FROM seed) GROUP BY 1), o AS (SELECT src AS path, count(*) AS c FROM edges WHERE dst IN (SELECT path FROM seed) GROUP BY 1),
t AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM ent) UNION SELECT src FROM edges WHERE dst IN (SELECT path FROM ent)), a AS (SELECT path FROM i UNION SELECT path FROM o UNION SELECT path FROM t)
SELECT a.path, round(least(2.5, 0.9 * coalesce(i.c, 0)) + least(2.5, 0.7 * coalesce(o.c, 0)) + CASE WHEN t.path IS NULL THEN 0 ELSE 0.45 END, 4)::DOUBLE AS boost
FROM a LEFT JOIN i ON i.path = a.path LEFT JOIN o ON o.path = a.path LEFT JOIN t ON t.path = a.path"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, s, n = (B.table(spark, d, t) for t in ("customer", "supplier", "nation"))
    e = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst")).union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    nodes = e.select(F.col("src").alias("path")).union(e.select("dst")).distinct()
    return nodes.withColumn("weight", F.lit(1.0)), e


def pagerank_fixed10(spark: SparkSession, d: str) -> DataFrame:
    nodes, e = _graph(spark, d)
    return ranking.pagerank(nodes, e, rounds=10, tolerance=None).select("path", F.round("rank", 6).alias("rank"))


def _pagerank_sql(rounds: int, end: str) -> str:
    steps = ["""WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
p AS (SELECT src AS path FROM e UNION SELECT dst FROM e), b AS MATERIALIZED (SELECT p.path, 1.0::DOUBLE / (SELECT count(*) FROM p) AS w, (SELECT count(*) FROM e WHERE e.src = p.path) AS n FROM p), r0 AS (SELECT path, w, n, w AS r FROM b)"""]
    for k in range(rounds):
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT x.path, x.w, x.n, 0.15 * x.w + 0.85 * (coalesce(g.g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE n = 0) * x.w) AS r
FROM r{k} x LEFT JOIN (SELECT dst, sum(r / n) AS g FROM e JOIN r{k} ON e.src = r{k}.path GROUP BY dst) g ON g.dst = x.path)""")
    return ",\n".join(steps) + f"\n{end}"


def pagerank_blend(spark: SparkSession, d: str) -> DataFrame:
    nodes, e = _graph(spark, d)
    scores = nodes.select("path", (F.length("path") * 1.0).alias("score"))
    return ranking.blend(scores, ranking.pagerank(nodes, e, rounds=5, tolerance=None)).select("path", F.round("blended", 6).alias("blended"))


def history_adjustment(spark: SparkSession, d: str) -> DataFrame:
    t = B.turns(spark, d).withColumn("path", F.concat("role", F.lit("/"), F.col("session") % 10))
    runs = t.groupBy("session").agg(F.array_distinct(F.flatten(F.collect_list(S.keywords(F.col("text"))))).alias("keys"), F.array_sort(F.collect_set(F.when(F.col("tokens") % 2 == 0, F.col("path")))).alias("selected"), F.array_sort(F.collect_set(F.when(F.col("tokens") % 2 == 1, F.col("path")))).alias("ignored"))
    entries = runs.select(F.col("session").alias("id"), F.col("session").alias("generated_at"), "keys", "selected", "ignored")
    return ranking.history_adjustment(entries, ["ing", "hello", "query", "question"], least=0.0)


SQL_ADJUSTMENT = f"""WITH {_SQL_KEYS}, t AS (SELECT conv_id AS id, role || '/' || conv_id % 10 AS path, CAST(ceil(length(text) / 4) AS BIGINT) % 2 AS odd, keys FROM k),
q AS (SELECT id, list_distinct(flatten(list(keys))) AS keys FROM t GROUP BY id), n AS (SELECT * FROM q ORDER BY id DESC LIMIT 50),
s AS (SELECT id, CASE WHEN len(keys) = 0 THEN 0.0 ELSE len(list_intersect(keys, ['ing', 'hello', 'query', 'question']))::DOUBLE / (len(keys) + 4 - len(list_intersect(keys, ['ing', 'hello', 'query', 'question']))) END AS s FROM n),
v AS (SELECT path, sum(CASE WHEN odd = 0 THEN s ELSE 0 END) AS up, sum(CASE WHEN odd = 1 THEN s ELSE 0 END) AS down FROM (SELECT DISTINCT id, path, odd FROM t) JOIN s USING (id) GROUP BY path)
SELECT path, round(greatest(0, least(3, up * 1.25)) - greatest(0, least(3, down * 0.35)), 3)::DOUBLE AS adjustment FROM v"""


def test_pair_join(spark: SparkSession, d: str) -> DataFrame:
    f = B.table(spark, d, "part").select(F.col("p_type").alias("repo"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, "_test.py").otherwise(".py")).alias("path")).distinct()
    return ranking.test_pairs(f).select("a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("repos"))


SQL_PAIRS = """WITH f AS (SELECT DISTINCT p_type AS repo, replace(p_name, ' ', '_') AS stem, p_size % 2 = 0 AS test FROM part)
SELECT x.stem || '_test.py' AS a, y.stem || '.py' AS b, count(*) AS repos FROM f x JOIN f y ON x.repo = y.repo AND x.stem = y.stem AND x.test AND NOT y.test GROUP BY 1, 2"""


def resolve_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    pages = B.table(spark, d, "pages").select(host.alias("host"), F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), "[?#].*$", "").alias("spec"))
    modules = pages.select(F.col("host").alias("name"), F.col("host").alias("module")).union(pages.select(F.regexp_extract("spec", r"^([^/]+/[^/]+)", 1), F.regexp_extract("spec", r"^([^/]+/[^/]+)", 1))).distinct()
    return ranking.resolve(pages, modules, "/")


SQL_RESOLVE = r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS spec FROM pages),
m AS (SELECT host AS name FROM p UNION SELECT regexp_extract(spec, '^([^/]+/[^/]+)', 1) FROM p)
SELECT spec, max_by(name, length(name)) AS module FROM (SELECT DISTINCT spec FROM p) q JOIN m ON spec = name OR starts_with(spec, name || '/') WHERE name <> '' GROUP BY spec"""


def search_regex(spark: SparkSession, d: str) -> DataFrame:
    lines = B.files(spark, d).select("path", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike("(?i)licen[cs]e|copyright")).orderBy("doc_id", "pos").limit(100).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), F.substring("line", 1, 200).alias("text"))


SQL_SEARCH = f"""WITH {B.SQL_FILES}, l AS (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files)
SELECT path, CAST(line_no AS BIGINT) AS line_no, substring(line, 1, 200) AS text FROM l WHERE regexp_matches(line, '(?i)licen[cs]e|copyright') ORDER BY doc_id, line_no LIMIT 100"""


def tier_builder(spark: SparkSession, d: str) -> DataFrame:
    return packing.tier_texts(scored(spark, d).withColumn("score", F.col("score") * 10), KEYS)


SQL_TIERS = f"""WITH {_SCORED}, l AS (SELECT path, text, score * 10 AS score, string_split(text, chr(10)) AS ls FROM scored),
h AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(lower(ls[i]), '{'|'.join(KEYS)}'))[1:6] AS hits FROM l),
x AS (SELECT *, array_to_string(list_filter(ls, lambda a, i: len(list_filter(hits, lambda k: abs(k - i) <= 1)) > 0), chr(10)) AS snip, array_to_string(list_filter(ls, lambda a: trim(a) <> '')[1:8], chr(10)) AS summ FROM h)
SELECT path, 0::BIGINT AS place, 'full' AS tier, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM x WHERE ceil(length(text) / 4) <= 300
UNION ALL SELECT path, 1, 'snippet', CAST(ceil(length(snip) / 4) AS BIGINT) FROM x WHERE score >= 2.5 AND len(hits) > 0 UNION ALL SELECT path, 2, 'summary', CAST(greatest(1, ceil(length(summ) / 4)) AS BIGINT) FROM x"""


QUERIES = {
    "rank_keyword_score": (lambda s, d: scored(s, d).where("score > 0").select("doc_id", "tokens", "score"), f"WITH {_SCORED} SELECT doc_id, tokens, score FROM scored WHERE score > 0"),
    "rank_file_score": (rank_file_score, SQL_FILE_SCORE),
    "pack_prefix_stop": (pack_prefix_stop, f"""WITH {_SCORED}, u AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY h ORDER BY score DESC, doc_id) = 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM u)
SELECT rank, doc_id, score, tokens, CAST(used AS BIGINT) AS used_tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM r) WHERE used <= {BUDGET}"""),
    "pack_greedy_skip": (pack_greedy_skip, f"""WITH RECURSIVE {B.SQL_PACKED}, o AS (SELECT run, position, compressed AS t, row_number() OVER (PARTITION BY run ORDER BY position, part, original, compressed) AS k FROM packed),
g AS (SELECT run, k, CASE WHEN t <= 1500 THEN t ELSE 0 END AS used, t <= 1500 AS ok FROM o WHERE k = 1 UNION ALL
SELECT o.run, o.k, g.used + CASE WHEN g.used + t <= 1500 THEN t ELSE 0 END, g.used + t <= 1500 FROM g JOIN o ON o.run = g.run AND o.k = g.k + 1)
SELECT run, CAST(k AS BIGINT) AS rank, CAST(used AS BIGINT) AS used FROM g WHERE ok"""),
    "pack_multi_tier": (pack_multi_tier, f"""WITH RECURSIVE {B.SQL_PACKED}, o AS (SELECT run, position, original AS t0, compressed AS t1, CAST(floor(compressed / 4) AS BIGINT) AS t2, row_number() OVER (PARTITION BY run ORDER BY position, part, original, compressed) AS k FROM packed),
g AS (SELECT run, 0::BIGINT AS k, NULL::BIGINT AS tier, 0::BIGINT AS tokens, 0::BIGINT AS used FROM (SELECT DISTINCT run FROM o) UNION ALL
SELECT o.run, o.k, CASE WHEN g.used + t0 <= 1500 THEN 0 WHEN g.used + t1 <= 1500 THEN 1 WHEN g.used + t2 <= 1500 THEN 2 END, CASE WHEN g.used + t0 <= 1500 THEN t0 WHEN g.used + t1 <= 1500 THEN t1 WHEN g.used + t2 <= 1500 THEN t2 ELSE 0 END,
g.used + CASE WHEN g.used + t0 <= 1500 THEN t0 WHEN g.used + t1 <= 1500 THEN t1 WHEN g.used + t2 <= 1500 THEN t2 ELSE 0 END FROM g JOIN o ON o.run = g.run AND o.k = g.k + 1)
SELECT run, k AS rank, tier, tokens, used FROM g WHERE tier IS NOT NULL"""),
    "pack_progressive": (pack_progressive, None),
    "tier_builder": (tier_builder, SQL_TIERS),
    "token_estimators": (token_estimators, SQL_ESTIMATORS),
    "dup_reads_prevented": (dup_reads_prevented, "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_reads_prevented, CAST(sum((n - 1) * t) AS BIGINT) AS tokens_prevented FROM (SELECT count(*) AS n, max(ceil(length(coalesce(text, '')) / 4)) AS t FROM documents GROUP BY coalesce(text, ''))"),
    "line_dedup_first_seen": (line_dedup_first_seen, SQL_LINES),
    "scan_classify": (scan_classify, SQL_CLASSIFY),
    "secret_exclusion": (secret_exclusion, SQL_SECRET),
    "keyword_extraction": (keyword_extraction, f"WITH {_SQL_KEYS} SELECT conv_id, turn, array_to_string(keys, ',') AS keywords FROM k"),
    "keyword_windows": (keyword_windows, SQL_WINDOWS),
    "import_graph_degrees": (import_graph_degrees, f"WITH {SQL_EDGES}, x AS (SELECT src AS path, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) SELECT path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM x GROUP BY path"),
    "graph_one_hop_boost": (graph_one_hop_boost, SQL_ONE_HOP),
    "pagerank_fixed10": (pagerank_fixed10, _pagerank_sql(10, "SELECT path, round(r / (SELECT sum(r) FROM r10), 6) AS rank FROM r10")),
    "pagerank_blend": (pagerank_blend, _pagerank_sql(5, "SELECT path, round(0.6::DOUBLE * (length(path)::DOUBLE / (SELECT max(length(path)) FROM r5)) + 0.4::DOUBLE * r / (SELECT sum(r) FROM r5), 6) AS blended FROM r5")),
    "history_adjustment": (history_adjustment, SQL_ADJUSTMENT),
    "test_pair_join": (test_pair_join, SQL_PAIRS),
    "resolve_longest_prefix": (resolve_longest_prefix, SQL_RESOLVE),
    "search_regex": (search_regex, SQL_SEARCH),
}
