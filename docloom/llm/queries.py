"""The thin contract queries of the corpus operators: name → (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.plumbing import table
from docloom.llm.oracle import CONVERSATION_REPAIR, FINGERPRINTS, RANKED_SEARCH
from docloom.llm.winnow_sql import DECONTAMINATION


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.langid_crf import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.warc import derivatives, responses_of

    return derivatives(responses_of(table(spark, sf_dir, "pages")), "page_id")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.winnow import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.simhash_golay import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.toxicity_nnpu import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mpeg_audio import media_column

    return media_column(table(spark, sf_dir, "documents"))


def op9_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.url_lm import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.quality_rules import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.threshold_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.fingerprints import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.conversation_repair import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_language_id": op1_crf_language_id,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_winnowing": op3_winnowing,
    "op4_nnpu_toxicity": op4_nnpu_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_output": op6_token_output,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_url_lm": op9_url_lm,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op11_threshold_search": op11_threshold_search,
    "op12_winnow_fingerprints": op12_winnow_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op3_winnowing": DECONTAMINATION,
    "op11_threshold_search": RANKED_SEARCH,
    "op12_winnow_fingerprints": FINGERPRINTS,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
