"""Thin queries over the operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.decontam import find_contamination
from folioframe.llm.embeddings import embedding_duplicates
from folioframe.llm.html_text import extract_pages
from folioframe.llm.langid import identify_languages
from folioframe.llm.mixing import mix
from folioframe.llm.neardup import near_duplicates
from folioframe.llm.quality import classify_quality
from folioframe.llm.substrings import dedup_substrings
from folioframe.llm.suffix_tree import score_texts
from folioframe.llm.url_filter import host_rule, judge_urls, pattern_rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), form_text=True)


URL_RULES = [
    host_rule("allow", "com"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]


#: For what no rule above fits: numbered pages saved as files on .org hosts, and mobile twins on .net hosts.
URL_PATTERNS = [
    pattern_rule("block", "org html", r"^[^/]*\.org/[a-z]{2}/[0-9]+\.html$", ("org",)),
    pattern_rule("block", "mobile net", r"^m\.[^/]*\.net/", ("m", "net")),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, patterns=URL_PATTERNS)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier,
        op2_html_extraction,
        op3_url_filter,
        op4_language_id,
        op5_substring_dedup,
        op6_decontamination,
        op7_near_dedup,
        op8_embedding_dedup,
        op9_lm_scoring,
        op10_source_mix,
    )
    return {f.__name__: f for f in found}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = r"""
WITH cutup AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL
    ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cutup
), rules(rule, verdict, rhost, rpath) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL WHEN regexp_matches(host || path, '^[^/]*\.org/[a-z]{2}/[0-9]+\.html$') THEN 'org html'
  WHEN regexp_matches(host || path, '^m\.[^/]*\.net/') THEN 'mobile net' END AS pattern
FROM (SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  (SELECT arg_max(rules.verdict, length(rule)) FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule_verdict
FROM parts))
"""

OP5_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)
), judged AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) < doc_id AS gone FROM starts),
covered AS (SELECT DISTINCT doc_id, s + o AS i FROM judged, range(0, 50) t(o) WHERE gone),
kept AS (
  SELECT w.doc_id, count(*) AS n, count(c.i) AS gone,
    coalesce(string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY u.i), '') AS text
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) u
  JOIN w USING (doc_id) LEFT JOIN covered c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY w.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


LOWER_WORDS = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def shingle_sql(table_name: str, key: str, k: int) -> str:
    """Distinct shingles of ``k`` words; of fewer words, the whole sequence."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM (SELECT {key}, {LOWER_WORDS} AS ws FROM {table_name})"""


OP6_SQL = f"""
WITH d AS ({shingle_sql("documents", "doc_id", 5)}), b AS ({shingle_sql("benchmark", "item_id", 5)}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item FROM d JOIN b USING (sh) JOIN n USING (item_id)
GROUP BY 1, 2 HAVING count(*) * 100 >= 80 * any_value(n_item)
"""

REACH = """reach(a, b) AS (SELECT id, id FROM ids UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""

OP7_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED ({shingle_sql("documents", "doc_id", 2)}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (sh) JOIN n m ON m.doc_id = x.doc_id JOIN n o ON o.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id AND m.n * 100 >= 80 * o.n AND o.n * 100 >= 80 * m.n
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(m.n) + any_value(o.n) - count(*))),
ids AS (SELECT DISTINCT a AS id FROM links), {REACH},
c AS (SELECT a, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""

OP8_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
ids AS (SELECT a AS id FROM n), {REACH},
c AS (SELECT a, min(b) AS component FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, substr(md5(doc_id || ':17'), 1, 16) AS place FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM ranked),
queued AS (SELECT *, 2 * source_size / weight AS exhausted FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own
  FROM queued WINDOW before AS (ORDER BY exhausted, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, max(CASE WHEN exhausted > own THEN own END) OVER () AS level FROM levels),
sources AS (SELECT source, rank, source_size, CASE WHEN level IS NULL OR exhausted <= level THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target FROM levelled),
served AS (SELECT d.*, s.rank, s.source_size, s.target, sum(size) OVER (PARTITION BY s.rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT *, (served + copy * source_size) / target AS finish FROM served, range(2) t(copy) WHERE size > 0),
taken AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, place, doc_id, size, copy ROWS UNBOUNDED PRECEDING) <= 1.5 * (SELECT sum(size) FROM d) AS fits FROM copies),
of_doc AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM taken WHERE fits GROUP BY doc_id)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM served LEFT JOIN of_doc USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": OP3_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op6_decontamination": OP6_SQL,
        "op7_near_dedup": OP7_SQL,
        "op8_embedding_dedup": OP8_SQL,
        "op10_source_mix": OP10_SQL,
    }
