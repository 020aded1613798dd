"""Queries of the training-data operators, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.common import table
from . import bpe, decontam, html, langid, langmodel, media, mixing, periodic, quality, secrets, sharding, simhash, whitening

#: Production parameters.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score_texts(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, SHARDS).withColumn("slot", sharding.slot_of(docs["doc_id"])).select("doc_id", "slot", "shard")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where a long can't hold it; ``deviation_exact`` always has it."""
    out = whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_repeats(table(spark, sf_dir, "documents"))))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {"op1_simhash": op1_simhash, "op2_secrets": op2_secrets, "op3_language_model": op3_language_model, "op4_media": op4_media, "op5_mixing": op5_mixing, "op6_decontamination": op6_decontamination,
            "op7_sharding": op7_sharding, "op8_language": op8_language, "op9_html": op9_html, "op10_quality": op10_quality,
            "op11_whitening": op11_whitening, "op12_periodic_runs": op12_periodic_runs, "op13_bpe": op13_bpe, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op7_sharding": sharding_sql(), "op5_mixing": mixing_sql()}


def sharding_sql() -> str:
    slots = ",".join(map(str, sharding.fill_table(SHARDS)))
    slot = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER)"
    return f"WITH t AS (SELECT [{slots}] AS shards), d AS (SELECT doc_id, {slot} AS slot FROM documents) SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM d, t"


def mixing_sql(fraction: float = 1.0, max_epochs: int = 3, seed: int = 7) -> str:
    """The same budgets from nested window queries and one running sum for each leaf."""
    case = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {v}.0" for k, v in WEIGHTS.get(level, {"": 1}).items()) + " ELSE 1.0 END"

    def shared(level: str, path: str, source: str) -> str:
        by = f"PARTITION BY {path}" if path else ""
        return f"""(SELECT *, CASE WHEN rate IS NULL THEN cap ELSE least(cap, w * greatest(rate, 0.0)) END AS share FROM (
            SELECT *, (min({{'r': ratio, 'l': {level}, 'v': lev}}) FILTER (WHERE lev < ratio) OVER ({by})).v AS rate FROM (
            SELECT *, cap / w AS ratio, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / (sum(w) OVER ({by}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lev
            FROM (SELECT *, {case(level)}::DOUBLE AS w FROM {source}) WINDOW o AS ({by} ORDER BY cap / ({case(level)})::DOUBLE, {level}))))"""

    return f"""
    WITH docs AS (SELECT doc_id, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 2) AS BIGINT) % {mixing.DOMAINS}) AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
    n1 AS (SELECT domain, sum(tokens * {max_epochs})::DOUBLE AS cap, floor(sum(sum(tokens)) OVER () * {fraction}::DOUBLE + 1e-6) AS budget FROM leaves GROUP BY 1),
    s1 AS (SELECT * FROM {shared("domain", "", "n1")}),
    n2 AS (SELECT domain, lang, sum(tokens * {max_epochs})::DOUBLE AS cap, any_value(share) AS budget FROM leaves JOIN s1 USING (domain) GROUP BY 1, 2),
    s2 AS (SELECT * FROM {shared("lang", "domain", "n2")}),
    n3 AS (SELECT domain, lang, source, sum(tokens * {max_epochs})::DOUBLE AS cap, any_value(share) AS budget FROM leaves JOIN s2 USING (domain, lang) GROUP BY 1, 2, 3),
    s3 AS (SELECT * FROM {shared("source", "domain, lang", "n3")}),
    plan AS (SELECT domain, lang, source, tokens AS leaf_tokens, CAST(floor(share + 1e-6) AS BIGINT) AS budget FROM s3 JOIN leaves USING (domain, lang, source)),
    e AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 0 END AS epochs FROM plan),
    r AS (SELECT doc_id, domain, lang, source, tokens, epochs, budget - epochs * leaf_tokens AS rest,
        sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS upto
        FROM docs JOIN e USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, tokens, CAST(epochs + (upto <= rest)::INTEGER AS INTEGER) AS copies FROM r"""
