"""What leaves the engine: CSV and JSON files, report and card views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.text import first_filled, or_empty
from rolecast.operators.postings import POSTING_COLUMNS


def _joined(bucket: str, most: int | None = None, glue: str = "; ") -> Column:
    hits = F.col(f"matches.{bucket}")
    return F.array_join(hits if most is None else F.slice(hits, 1, most), glue)


def csv_view(ranked: DataFrame) -> DataFrame:
    """The twelve columns of the ranked CSV, in order."""
    return ranked.select(
        "score", "title", "req_id", "location", "posted",
        or_empty(F.col("date_posted")).alias("date_posted"),
        "source", "url",
        _joined("core").alias("core_matches"),
        _joined("nice").alias("nice_matches"),
        _joined("neg").alias("neg_matches"),
        F.substring(or_empty(F.col("description_text")), 1, 500).alias("description_preview"),
    )


def _in_rank_order(ranked: DataFrame) -> DataFrame:
    """Sorted over all part files: score, then scan order."""
    return ranked.orderBy(F.desc("score"), "ingest_seq")


def write_csv(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ranked CSV with header; quotes are doubled as spreadsheets expect."""
    csv_view(_in_rank_order(ranked)).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', encoding="UTF-8", emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def json_view(ranked: DataFrame) -> DataFrame:
    """The full nested record: ``score``, ``job`` with all posting fields, ``matches``, ``notes``."""
    job = F.struct(*[F.col(c) for c in POSTING_COLUMNS if c != "ingest_seq"])
    return ranked.select("score", job.alias("job"), "matches", "notes")


def write_json(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ranked JSON, one record per line; absent fields are written as null."""
    json_view(_in_rank_order(ranked)).write.mode(mode).json(path, ignoreNullFields=False)


def report_view(ranked: DataFrame, top: int = 25) -> DataFrame:
    """Console report: the best rows with at most ten hits per bucket."""
    return _in_rank_order(ranked).limit(top).select(
        "score", "title", "req_id", "location", "url",
        *[_joined(b, 10, ", ").alias(b) for b in ("core", "nice", "neg")],
    )


def card_view(ranked: DataFrame, top: int = 25) -> DataFrame:
    """Result cards: hits cut to 10, 5 and 5, placeholders for missing place and date."""
    return _in_rank_order(ranked).limit(top).select(
        "score", "title", "url",
        F.coalesce(F.nullif("location", F.lit("")), F.lit("Unknown location")).alias("location"),
        first_filled(F.col("posted"), F.col("date_posted"), F.lit("Unknown posted date")).alias("posted"),
        "req_id",
        *[_joined(b, n, ", ").alias(b) for b, n in (("core", 10), ("nice", 5), ("neg", 5))],
        F.substring(or_empty(F.col("description_text")), 1, 1800).alias("description"),
    )
