"""The queries of this subpackage: op<N>_<name>(spark, sf_dir), each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, decontaminate, html_extract, mixing, ngram_join, pii, repetition, secret_scan, token_alignment, token_files, toxicity, url_templates, whitening
from marginalia.sources.tables import table

#: Weights of the production mix: domains and languages by name, sources alike.
PRODUCTION_MIX = mixing.Mix(
    weights={"domain": {"web": 5, "books": 3, "forums": 2}, "language": {"en": 6, "de": 2, "fr": 2, "es": 1}},
    budget_percent=100,
    max_epochs=4,
    seed=17,
)
END_ID = 1


# The rules of the URL query.
URL_RULES = (
    url_templates.Rule("net", "/", "block"),
    url_templates.Rule("example.net", "/en/", "allow"),
    url_templates.Rule("example.com", "/de/", "block"),
    url_templates.Rule("org", "/fr/", "allow"),
)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_path() -> str:
    return vocabulary_path("word_bpe_49k.json")


def word_pattern() -> str:
    import public_tokenizers

    return str(public_tokenizers.PATTERN)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenise_to_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifier_digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_selection(table(spark, sf_dir, "documents"), mixing.source_domain(F.col("source")), PRODUCTION_MIX)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"), word_pattern())


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_templates": op5_url_templates,
    "op6_secrets": op6_secrets,
    "op7_html_extract": op7_html_extract,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_repetition": op10_repetition,
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}


def _sql_case(column: str, weights: dict[str, int]) -> str:
    if not weights:
        return "1"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


def _sql_deal(out: str, keys: list[str], name: str, weight: str, parent: str) -> str:
    """The filling of children by weight, level by level, with integers."""
    by, using = ", ".join(keys) or "1", ", ".join(keys)
    every = ", ".join([*keys, name])
    return f"""
{out}_n AS (SELECT {every}, sum(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS w FROM leaf GROUP BY {every}),
{out}_g AS (SELECT n.*, g.given FROM {out}_n n {f"JOIN {parent} g USING ({using})" if keys else f"CROSS JOIN {parent} g"}),
{out}_r AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS p,
  sum(w) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS s FROM {out}_g),
{out}_f AS (SELECT *, w > 0 AND cap * s <= w * (given - p) AS is_full FROM {out}_r),
{out}_t AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {by}), 0)::HUGEINT AS filled,
  coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {by}), 0)::HUGEINT AS open_w FROM {out}_f),
{out} AS (SELECT {every}, CASE WHEN is_full THEN cap WHEN open_w > 0 THEN (w * (given - filled)) // open_w ELSE 0 END AS given FROM {out}_t)"""


def _sql_mixing(mix: mixing.Mix) -> str:
    w = mix.weights
    return f"""
WITH rows_ AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source_name,
  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other'
    ELSE ['web', 'books', 'forums'][(regexp_extract(source, '([0-9]+)$', 1)::INT % 3) + 1] END AS domain,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaf AS (SELECT domain, language, source_name, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {mix.max_epochs} AS cap FROM rows_ GROUP BY ALL),
total AS (SELECT (sum(tokens) * {mix.budget_percent} // 100)::HUGEINT AS given FROM leaf),
{_sql_deal("b1", [], "domain", _sql_case("domain", dict(w.get("domain", {}))), "total")},
{_sql_deal("b2", ["domain"], "language", _sql_case("language", dict(w.get("language", {}))), "b1")},
{_sql_deal("b3", ["domain", "language"], "source_name", _sql_case("source_name", dict(w.get("source", {}))), "b2")},
plan AS (SELECT domain, language, source_name, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole,
  CASE WHEN tokens > 0 THEN given - (given // tokens) * tokens ELSE given END AS partial FROM b3 JOIN leaf USING (domain, language, source_name)),
keyed AS (SELECT r.*, whole, partial, md5('{mix.seed}:' || whole::BIGINT || ':' || doc_id) AS ord FROM rows_ r JOIN plan USING (domain, language, source_name)),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source_name ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
epochs AS (SELECT *, whole + CASE WHEN partial > 0 AND before < partial THEN 1 ELSE 0 END AS n FROM summed)
SELECT doc_id, domain, language, source_name AS source, unnest(range(n::BIGINT)) AS epoch FROM epochs WHERE n > 0"""


ORACLE_SQL: dict[str, str] = {"op3_mixing": _sql_mixing(PRODUCTION_MIX)}
