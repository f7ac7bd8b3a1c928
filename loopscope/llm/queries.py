"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loopscope.llm.tokens import prefix_token_counts

    found = prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm import langid

    docs, part = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3
    found = langid.predict(docs, langid.fit(docs, part != 1))
    return found.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm import quality

    docs, part = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    rules = quality.fit(docs, table(spark, sf_dir, "labels"), part != 0)
    return quality.score(docs, rules).select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.contamination import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), entropy=0.95)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.substring import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), texts=False)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from loopscope.llm import contamination, mixing

    return {"op5_decontamination": contamination.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
