"""The pN_ queries of the problems tagged llm. Each loads its operator when it is called, as the driver needs no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argentum.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import linkage

    return linkage.link(*(table(spark, folder, t) for t in ("media", "sidecar", "embedded_meta", "export_source")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_links(spark, folder).select("media_id", "sidecar_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import truncation

    return truncation.truncated(table(spark, folder, "sidecar"), table(spark, folder, "media")).filter("cut").select("rec_id", "field_name")


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import truncation

    return truncation.report(table(spark, folder, "sidecar"), table(spark, folder, "media"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import cells

    return cells.repeats(table(spark, folder, "process_record"))


def p6_filled(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import packing

    return packing.fill_all(table(spark, folder, "documents"), table(spark, folder, "size_limit"))


def p6_use(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import packing

    return packing.use(table(spark, folder, "documents"), table(spark, folder, "size_limit"))


def p7_drawn(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import mixing

    return mixing.draw(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import mixing

    return mixing.shares(p7_drawn(spark, folder), table(spark, folder, "mix_target"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from argentum.llm import splitting

    return splitting.pieces(table(spark, folder, "documents"), table(spark, folder, "size_limit"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_links, p1_found, p2_found, p2_sources, p5_found, p6_filled, p6_use, p7_drawn, p7_shares, p8_pieces)}


def oracle_sql() -> dict[str, str]:
    return {}
