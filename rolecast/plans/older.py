"""The older variant of the chain, as presets of the same operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.functions.text import digest_cut, digest_tidy
from rolecast.functions.urls import requisition_id
from rolecast.operators.joins import hot_key_join
from rolecast.operators.postings import asked_for, detail_facts
from rolecast.operators.profiles import Profiles, override_weights
from rolecast.operators.ranking import OLDER_RULES, rank


def flat_records(postings: DataFrame, details: DataFrame) -> DataFrame:
    """``title, req_id, location, posted, url, digest`` of every posting.

    Only what follows the start heading makes the digest, null without it. The
    requisition number takes no query suffix, and a posting whose landed page has
    no readable block ends the job, as the older reading does.
    """
    facts = detail_facts(asked_for(details, postings, "url"), strict=True).select("url", "ld_description")
    joined = hot_key_join(postings, facts, ["url"], spread_by="ingest_seq")
    return joined.select(
        "ingest_seq",
        "title",
        requisition_id(F.col("url"), query_suffix=False).alias("req_id"),
        "location",
        "posted",
        "url",
        digest_tidy(digest_cut(F.col("ld_description"))).alias("digest"),
    )


def rank_older(records: DataFrame, tables: Profiles, changes: Mapping[str, float] | None = None) -> DataFrame:
    """Older ranking: terms as written, other knobs, unrounded; new terms always go to nice."""
    postings = records.withColumnRenamed("digest", "description_text")
    return rank(postings, override_weights(tables, changes or {}, new_bucket="nice"), OLDER_RULES)
