"""The registered queries of this subpackage, with their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.llm import bpe, compression_rules, cross_polytope, importance, near_duplicates, packing, permutation_index, pii, target_sampling, token_alignment, token_counts, toxicity, url_rules
from tabulario.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when SQL can express it, the SQL with the same result."""

    def register(f: Query) -> Query:
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


#: The rules of the url query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query("op1_url_rules", f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
split AS (SELECT rule, verdict, regexp_extract(rule, '^[^/]*') AS rule_host, substr(rule, length(regexp_extract(rule, '^[^/]*')) + 1) AS rule_path FROM rules),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT page_id, host, path, rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(rule_host) DESC) AS n
    FROM parsed LEFT JOIN split ON (host = rule_host OR right(host, length(rule_host) + 1) = '.' || rule_host)
        AND left(path, length(rule_path)) = rule_path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.report(table(spark, sf_dir, "pages"), rules)


@query("op2_near_duplicates")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find(table(spark, sf_dir, "documents"))


@query("op3_importance_resampling")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return importance.report(table(spark, sf_dir, "documents"), good)


@query("op4_token_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_compression_rules")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.report(table(spark, sf_dir, "documents"))


@query("op6_pattern_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_pii")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_bpe")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_permutation_index")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))


@query("op11_cross_polytope", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached(r, root) AS (SELECT r, vec_id FROM v UNION SELECT b, root FROM reached JOIN links ON a = r),
roots AS (SELECT r, min(root) AS root FROM reached GROUP BY r),
degrees AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN roots USING (r) LEFT JOIN degrees USING (r)
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.find(table(spark, sf_dir, "embeddings"))


@query("op12_token_alignment")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: CRC-32 of a word by its table, which is built from the polynomial.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
codes AS (SELECT w, list_transform(range(CAST(length(hex(encode(w))) // 2 AS BIGINT)),
    lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS codes FROM (SELECT DISTINCT w FROM words)),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
    FROM codes, crc)"""


@query("op13_target_resampling", rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}') AS text, true AS raw FROM documents
    UNION ALL SELECT 0, NULL, translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), false FROM benchmark),
words AS (SELECT r, doc_id, raw, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
{CRC_SQL},
counted AS (SELECT b, count(*) FILTER (WHERE raw) AS s, count(*) FILTER (WHERE NOT raw) AS t FROM words JOIN buckets USING (w) GROUP BY b),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counted),
gains AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counted, totals),
per AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM words JOIN buckets USING (w) JOIN gains USING (b) WHERE raw GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
    FROM texts LEFT JOIN per USING (r) WHERE raw),
placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= k THEN place END AS rank FROM placed
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
