"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from peaklake.llm import decontamination, exact_dedup, fill_middle, hard_negatives, jaccard_join, kd_sharding, licenses, mixing, quality, secrets, token_output, toxicity, url_filter
from peaklake.llm.common import table, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(secrets.oracle_sql())
def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query(exact_dedup.oracle_sql())
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


@query(kd_sharding.oracle_sql(16))
def op6_kd_sharding(spark, sf_dir):
    return kd_sharding.manifest(table(spark, sf_dir, "documents"), shards=16)


@query(licenses.oracle_sql())
def op10_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query(url_filter.oracle_sql())
def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labels_by_number(pages, table(spark, sf_dir, "labels")))


@query(mixing.oracle_sql())
def op9_source_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


@query()
def op4_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


@query()
def op7_token_output(spark, sf_dir):
    import public_tokenizers

    path = f"{workspace(spark, 'token-files').path}/files"
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.digest(token_output.read_tokens(spark, path))


@query(fill_middle.oracle_sql())
def op12_fill_in_middle(spark, sf_dir):
    return fill_middle.digest(fill_middle.transform(table(spark, sf_dir, "documents")))


@query()
def op11_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.digest(toxicity.score(docs, net))


@query(hard_negatives.oracle_sql())
def op13_hard_negatives(spark, sf_dir):
    vectors = hard_negatives.contract_rows(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
