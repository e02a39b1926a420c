"""The registered query of each operator, over its whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import chat, collocations, decontamination, embedding_dedup, exact_dedup, near_dedup, packing, quality, sharding, spelling, substring_dedup, token_counts, url_filters
from fleetlens.llm.common import table

SHARDS = 16
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(SHARDS), sharding.grown_tree(sharding.even_tree(SHARDS)))


def op2_interval_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_snapshot_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_order_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("_node")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.match_rules(table(spark, sf_dir, "pages"), rules)


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontamination.report(found)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_polynomial_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_product_quantised_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_gram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree_sharding": op1_hash_tree_sharding,
    "op2_interval_substring_dedup": op2_interval_substring_dedup,
    "op3_snapshot_chat_format": op3_snapshot_chat_format,
    "op4_attention_quality": op4_attention_quality,
    "op5_order_minhash_near_dedup": op5_order_minhash_near_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_fm_index_decontamination": op7_fm_index_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_polynomial_exact_dedup": op9_polynomial_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_setm_collocations": op11_setm_collocations,
    "op12_product_quantised_near_dedup": op12_product_quantised_near_dedup,
    "op13_gram_spelling_variants": op13_gram_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op3_snapshot_chat_format": r"""
WITH turns AS (
  SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turn_no FROM conversations),
prefixes AS (
  SELECT conv_id, turn_no, n_turns, string_agg(coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-'), ';')
    OVER (PARTITION BY conv_id ORDER BY turn_no) AS prefix FROM turns),
wholes AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE turn_no = n_turns GROUP BY prefix),
kept AS (SELECT * FROM wholes WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE turn_no < n_turns))
SELECT conv_id, turn_no, n_turns, n_copies, role, coalesce(role = 'assistant', false) AS trained,
  '<|im_start|>' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered
FROM turns JOIN kept USING (conv_id)
""",
    "op9_polynomial_exact_dedup": r"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM folded
""",
    "op11_setm_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
f1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY ALL),
f2 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS p FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
held AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, split_part(p, ' ', 1) || ' ' || split_part(p, ' ', 2) AS p, f FROM f3 UNION ALL SELECT lang, split_part(p, ' ', 2) || ' ' || split_part(p, ' ', 3), f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.p, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.p = split_part(f2.p, ' ', 1)
    JOIN f1 y ON y.lang = f2.lang AND y.p = split_part(f2.p, ' ', 2) LEFT JOIN held ON held.lang = f2.lang AND held.p = f2.p WHERE coalesce(100 * held.f < 50 * f2.f, true)
  UNION ALL SELECT f3.lang, f3.p, f3.f, x.f, y.f, 1 FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.p = split_part(f3.p, ' ', 1)
    JOIN f2 y ON y.lang = f3.lang AND y.p = split_part(f3.p, ' ', 2) || ' ' || split_part(f3.p, ' ', 3)
  UNION ALL SELECT f3.lang, f3.p, f3.f, x.f, y.f, 2 FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.p = split_part(f3.p, ' ', 1) || ' ' || split_part(f3.p, ' ', 2)
    JOIN f1 y ON y.lang = f3.lang AND y.p = split_part(f3.p, ' ', 3)),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM best JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang) QUALIFY rank <= 2000
""",
    "op6_url_rules": r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
