"""The operators as queries over whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, infill, licenses, lines, mixing, ngram_join, secrets, throttle, topk, toxicity, urls, wordpiece
from ._spark import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.mix(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = wordpiece.VOCABULARY) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), wordpiece.vocabulary(vocabulary))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(html.extract(table(spark, sf_dir, "pages")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_click_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.report(throttle.throttle(table(spark, sf_dir, "clicks")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.report(urls.judge(pages.select("page_id", "url"), urls.word_counts(pages, "html")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_license_scan, op3_exact_top_k, op4_line_dedup, op5_source_mix, op6_toxicity, op7_token_counts,
        op8_decontamination, op9_ngram_jaccard_join, op10_html_extraction,
        op11_fill_in_middle, op12_click_throttle, op13_url_filter,
    )
}
