"""The queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, bpe, centroids, embedding_dedup, exact_dedup, html_extraction, language_id, packing, pii, simhash, suffix_dedup, token_counts, url_filters
from corpusloom.session import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the URL filters that SQL can express: host, path and the rule that fits."""
    host, path = url_filters.host_and_path()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    return url_filters.match_rules(pages).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("rule_verdict"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), ids=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_read(spark, sf_dir, "embeddings"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), texts=False)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), ids=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(_read(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the personal data that SQL can express: the base kinds with their places."""
    return op12_pii(spark, sf_dir).drop("spans")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_read(spark, sf_dir, "documents"), groups=False)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_html_extraction": op6_html_extraction,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_pii": op12_pii,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "url_rules": url_rules,
    "pii_base": pii_base,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in url_filters.RULES)

_EMBEDDING = centroids.DIM


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and exact means, one after the other; distances are integers below 2^53, so doubles hold them."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) = {_EMBEDDING} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    apart = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT n, min(({apart}) * 64 + c) AS best FROM v, c{i} c GROUP BY n)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m FROM (SELECT (best % 64)::BIGINT AS c, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM v JOIN a{i} USING (n)) GROUP BY c, i)")
            parts.append(f"m{i} AS (SELECT c, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY i) AS x FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"a AS (SELECT vec_id, (best::BIGINT % 64)::INTEGER AS cluster, best::BIGINT // 64 AS distance FROM v JOIN a{rounds} USING (n))"
    return "WITH " + ", ".join([*parts, last]) + f"""
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(list_aggregate(list_transform(c.x, lambda y: y::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256
        FROM a JOIN c{rounds} c ON c.c = a.cluster"""


#: Pattern and check of each base kind of personal data, for matches ``m``; ``d`` are the digits of one.
_BASE_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || right(p, 3))::INTEGER <= 255))"),
    ("card", r"[0-9](?:[ -]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INTEGER WHEN d[length(d) - i]::INTEGER > 4 THEN 2 * d[length(d) - i]::INTEGER - 9 ELSE 2 * d[length(d) - i]::INTEGER END)) % 10 = 0"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
)


def _pii_sql() -> str:
    """Matches are as many as the gaps between them, so lengths give their places."""
    parts = []
    for order, (kind, pattern, check) in enumerate(_BASE_KINDS):
        parts.append(f"""
            {kind} AS (SELECT n, '{kind}' AS kind, {order} AS o, a, a + length(m) AS b FROM (SELECT n, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a
                FROM (SELECT n, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_split_to_array(text, '{pattern}')) AS g, generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS i FROM t)
                WHERE m IS NOT NULL WINDOW w AS (PARTITION BY n ORDER BY i)) WHERE {check})""")
    every = " UNION ALL ".join(f"FROM {kind}" for kind, _, _ in _BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in _BASE_KINDS)
    return f"""WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents), {', '.join(parts)}, s AS ({every})
        SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o), '')) AS base_sha256
        FROM t LEFT JOIN s USING (n) GROUP BY n, doc_id"""


ORACLES = {
    "op11_centroid_clustering": _clustering_sql(),
    "pii_base": _pii_sql(),
    "url_rules": f"""
        WITH r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {_RULES}) v(verdict, rule)),
        a AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
        SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict
        FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n, page_id, host, path
    """,
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY low)
    """,
}
