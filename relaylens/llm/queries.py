"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    prepare(spark)
    return scores(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    prepare(spark)
    return removed(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    prepare(spark)
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    prepare(spark)
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    prepare(spark)
    return pack(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import score

    prepare(spark)
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    prepare(spark)
    return round_trip(spark, table(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    prepare(spark)
    return mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    prepare(spark)
    return scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    prepare(spark)
    return collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    prepare(spark)
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge

    prepare(spark)
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_near_duplicates, op3_repeated_passages, op4_quality_rules, op5_top_k_search, op6_best_fit_packing, op7_quality_classifier, op8_warc_round_trip, op9_mix_sources, op10_license_scan,
                              op11_collocations, op12_spelling_variants, op13_url_filters)
}


def oracle_sql() -> dict[str, str]:
    from . import collocations, licenses, spelling, topk, url_filters, warc

    return {"op5_top_k_search": topk.oracle_sql(), "op8_warc_round_trip": warc.oracle_sql(), "op10_license_scan": licenses.oracle_sql(),
            "op11_collocations": collocations.oracle_sql(), "op12_spelling_variants": spelling.oracle_sql(),
            "op13_url_filters": url_filters.oracle_sql()}
