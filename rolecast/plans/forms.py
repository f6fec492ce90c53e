"""Submitted search forms as rows: what each asks for, its own profile, and its answer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.forms import clamp_float, clamp_int, term_list
from rolecast.functions.text import or_empty, strip
from rolecast.functions.urls import append_facets, assigned_facets, infer_site, list_address
from rolecast.operators.narrowing import Resolved, facet_index
from rolecast.operators.profiles import Profiles, preset_key, profiles_from_texts
from rolecast.plans.search import Found, Landed, browser_search, resolve_in_turn
from rolecast.sources.presets import DEFAULT_PROFILE, PRESETS

# The whole numbers of a form with their default and bounds, and the bounds of the others.
COUNTS = {"pages": (10, 1, 100), "page_size": (20, 1, 100), "max_jobs": (50, 1, 500), "top": (25, 1, 100), "location_matches": (1, 1, 50)}
KNOBS = {"title_boost": (3, 0.0, 10.0), "length_bonus_cap": (4, 0.0, 10.0), "length_bonus_divisor": (5, 1.0, 100_000.0)}
RANK, LOCATIONS = "rank", "locations"


class Forms(NamedTuple):
    """``settings``: one row a form; ``tables``: the profile each form spells out, named by ``form_id``; ``errors``: its bad lines."""

    settings: DataFrame
    tables: Profiles
    errors: DataFrame


def _given(name: str) -> Column:
    return strip(or_empty(F.col(name)))


def read_forms(forms: DataFrame) -> Forms:
    """Forms of raw texts to what they ask for.

    ``forms`` has ``form_id``, ``url``, ``location``, ``query``, ``title_keywords``,
    ``profile_key``, ``core_plus_weights``, ``nice_weights``, ``light_neg_weights``,
    the names in ``KNOBS`` and ``COUNTS``, ``hydrate`` and ``action``; null means
    not sent. Numbers are clamped; an unreadable one gives its default, which for
    the knobs is that of the chosen preset.
    """
    key = preset_key(F.col("profile_key"))

    def knob(name: str) -> Column:
        place, low, high = KNOBS[name]
        known = [F.when(key == p, clamp_float(F.col(name), spec[place], low, high)) for p, spec in PRESETS.items()]
        return F.coalesce(*known, clamp_float(F.col(name), PRESETS[DEFAULT_PROFILE][place], low, high))

    settings = forms.select(
        "form_id",
        *[_given(c).alias(c) for c in ("url", "query")],
        term_list(F.col("location")).alias("locations"),
        term_list(F.col("title_keywords")).alias("titles"),
        key.alias("profile_key"),
        *[knob(c).alias(c) for c in KNOBS],
        *[clamp_int(F.col(c), *bounds).alias(c) for c, bounds in COUNTS.items()],
        F.coalesce(F.col("hydrate") == "on", F.lit(False)).alias("hydrate"),
        F.when(or_empty(F.col("action")) == "", RANK).otherwise(F.col("action")).alias("action"),
    )
    texts = forms.select(
        F.col("form_id").alias("profile"),
        _given("core_plus_weights").alias("core"),
        _given("nice_weights").alias("nice"),
        _given("light_neg_weights").alias("neg"),
    ).join(
        settings.select(
            F.col("form_id").alias("profile"), "title_boost", F.col("length_bonus_cap").alias("length_cap"),
            F.col("length_bonus_divisor").alias("length_divisor"),
        ),
        "profile",
    )
    tables, errors = profiles_from_texts(texts)
    return Forms(settings, tables, errors.withColumnRenamed("profile", "form_id"))


def answer(landed: Landed, forms: Forms, form_id: str, members: DataFrame | None = None) -> Found | Resolved:
    """The answer to one form over landed tables: ranked postings and counts, or the locations alone if it asks for them.

    A form whose weight texts have a bad line is refused with that line.
    """
    row = forms.settings.where(F.col("form_id") == form_id).first()
    if row is None:
        raise ValueError(f"no form {form_id}")
    bad = forms.errors.where(F.col("form_id") == form_id).orderBy("bucket", "line").first()
    if bad is not None:
        raise ValueError(f"{bad.bucket} line {bad.line} {bad.error}")
    if row.action == LOCATIONS:
        if members is None:
            raise ValueError("locations are resolved against landed memberships")
        return resolve_in_turn(landed, facet_index(members), row.locations, row.location_matches)
    own = Profiles(*(t.where(F.col("profile") == form_id) for t in forms.tables))
    return browser_search(
        landed, own, row.locations, row.titles, row.pages, row.page_size, row.max_jobs, row.top, row.hydrate, row.query, members, row.location_matches
    )


def site_arguments(arguments: DataFrame) -> DataFrame:
    """Sites from an address or from their parts, with further facets appended.

    ``arguments`` has ``source_ord``, ``url``, ``base_url``, ``tenant``, ``site``,
    ``locale`` (null: the default) and ``given``, texts of the form ``key=value``.
    The result has the columns of a site table; ``source`` is the address, or the
    list address where there is none. What lacks both says so in ``error``.
    """
    locale = F.coalesce(F.nullif(strip(or_empty(F.col("locale"))), F.lit("")), F.lit("en-US"))
    given = assigned_facets(F.coalesce("given", F.array().cast("array<string>")))
    url = F.nullif(or_empty(F.col("url")), F.lit(""))
    parts = ("base_url", "tenant", "site")
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts]), lambda p: p.isNotNull()), ", ")
    error = F.when(lacking != "", F.concat(F.lit("give an address, or base_url, tenant and site; missing: "), lacking))
    rows = arguments.withColumn("_s", F.when(url.isNotNull(), infer_site(url, locale))).withColumn("_g", given)
    own = F.when(error.isNull(), list_address(F.col("base_url"), F.col("tenant"), F.col("site")))
    known = F.col("_s").isNotNull()
    return rows.select(
        F.coalesce(url, own).alias("source"),
        "source_ord",
        *[F.when(known, F.col(f"_s.{p}")).otherwise(F.when(error.isNull(), F.col(p))).alias(p) for p in parts],
        F.when(known, F.col("_s.locale")).otherwise(F.when(error.isNull(), locale)).alias("locale"),
        F.col("_s.public_prefix").alias("public_prefix"),
        F.when(known, append_facets(F.col("_s.facets"), F.col("_g"))).otherwise(F.col("_g")).alias("facets"),
        F.when(known, F.col("_s.error")).otherwise(error).alias("error"),
    )
