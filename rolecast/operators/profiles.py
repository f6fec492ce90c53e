"""Keyword profiles as two tables: one row per profile, one row per term.

``profiles``: profile, title_boost, length_cap, length_divisor.
``terms``: profile, bucket (core, nice, neg), term, weight, ord.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions.forms import number, weight_entry, weight_lines, weight_number
from rolecast.functions.text import fold_case, literal_json, strip
from rolecast.sources.presets import (
    DEFAULT_PROFILE,
    LENGTH_CAP,
    LENGTH_DIVISOR,
    PRESETS,
    PROPERTY_PROFILE,
    TITLE_BOOST,
)

BUCKETS = ("core", "nice", "neg")
PROFILE_ROW = "profile string, title_boost double, length_cap double, length_divisor double"
TERM_ROW = "profile string, bucket string, term string, weight double, ord int"


class Profiles(NamedTuple):
    profiles: DataFrame
    terms: DataFrame


def bucket_order(bucket: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BUCKETS)), bucket)


def merge_folded(terms: DataFrame) -> DataFrame:
    """Fold the terms; of equal ones the last weight counts, at the first position."""
    return (
        terms.withColumn("term", fold_case(F.col("term")))
        .groupBy("profile", "bucket", "term")
        .agg(F.max_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"))
        .select("profile", "bucket", "term", "weight", "ord")
    )


def _constant_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows given as parameters, as a constant of the plan."""
    fields = ",".join(part.strip().replace(" ", ":") for part in schema.split(","))
    return spark.range(1).select(F.inline(literal_json(rows, f"array<struct<{fields}>>")))


def profile_tables(spark: SparkSession, profiles: Mapping[str, tuple]) -> Profiles:
    """Tables from ``name -> (core, nice, neg, boost, cap, divisor)`` with weight dicts."""
    knobs = ("title_boost", "length_cap", "length_divisor")
    rows = [{"profile": name, **dict(zip(knobs, map(float, spec[3:])))} for name, spec in profiles.items()]
    terms = []
    for name, spec in profiles.items():
        for bucket, table in zip(BUCKETS, spec):
            folded = {term.casefold(): float(weight) for term, weight in table.items()}
            terms += [
                {"profile": name, "bucket": bucket, "term": term, "weight": weight, "ord": i}
                for i, (term, weight) in enumerate(folded.items())
            ]
    return Profiles(_constant_table(spark, rows, PROFILE_ROW), _constant_table(spark, terms, TERM_ROW))


def preset_tables(spark: SparkSession, *names: str) -> Profiles:
    chosen = names or (DEFAULT_PROFILE,)
    return profile_tables(spark, {n: PRESETS[n] for n in chosen})


def preset_key(key: Column) -> Column:
    """A known preset name, or the default one."""
    return F.when(key.isin(DEFAULT_PROFILE, PROPERTY_PROFILE), key).otherwise(DEFAULT_PROFILE)


# --- JSON profiles --------------------------------------------------------------

_TABLES = {"core_plus": "core", "nice": "nice", "light_neg": "neg"}
_TABLE = "map<string,string>"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per profile file: ``path`` and its whole ``text``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def _profile_entries(files: DataFrame) -> DataFrame:
    schema = "name string, title_boost string, length_bonus_cap string, length_bonus_divisor string, " + ", ".join(
        f"{t} {_TABLE}" for t in _TABLES
    )
    doc = F.try_parse_json("text")
    return files.select("path", doc.alias("_doc"), F.from_json("text", schema).alias("_p")).withColumn(
        "profile", F.coalesce(F.nullif("_p.name", F.lit("")), F.lit("custom"))
    )


def _exploded_terms(entries: DataFrame) -> DataFrame:
    tables = F.array(
        *[
            F.struct(F.lit(bucket).alias("bucket"), F.lit(table).alias("table"), F.map_entries(f"_p.{table}").alias("e"))
            for table, bucket in _TABLES.items()
        ]
    )
    return (
        entries.select("path", "profile", F.explode(tables).alias("_t"))
        .select("path", "profile", "_t.bucket", "_t.table", F.posexplode("_t.e").alias("ord", "_e"))
        .select("path", "profile", "bucket", "table", "ord", "_e.key", "_e.value")
    )


def profile_errors(files: DataFrame) -> DataFrame:
    """What is wrong with profile files: ``path`` and ``error``; empty when all are fine."""
    entries = _profile_entries(files)
    kinds = F.coalesce(F.schema_of_variant("_doc"), F.lit("unreadable"))
    shape = [
        F.when(~F.startswith(kinds, F.lit("OBJECT")), F.lit("profile must be an object")),
        *[
            F.when(
                ~F.coalesce(F.schema_of_variant(F.try_variant_get("_doc", f"$.{t}", "variant")), F.lit("VOID")).rlike(
                    "^(OBJECT|VOID)"
                ),
                F.lit(f"{t} must be an object mapping terms to weights"),
            )
            for t in _TABLES
        ],
        *[
            F.when(F.col(f"_p.{k}").isNotNull() & number(F.col(f"_p.{k}")).isNull(), F.lit(f"{k} is not a number"))
            for k in ("title_boost", "length_bonus_cap", "length_bonus_divisor")
        ],
    ]
    whole = entries.select("path", F.explode(F.array_compact(F.array(*shape))).alias("error"))
    terms = _exploded_terms(entries)
    bad_term = F.when(strip(F.col("key")) == "", F.concat("table", F.lit(" contains a blank term"))).when(
        number(F.col("value")).isNull(),
        F.concat("table", F.lit(" contains a non-numeric weight for "), "key"),
    )
    return whole.unionByName(terms.select("path", bad_term.alias("error")).where("error is not null"))


def parse_profiles(files: DataFrame, check: bool = True) -> Profiles:
    """Profile tables from JSON texts. With ``check`` any fault is raised first."""
    if check:
        first = profile_errors(files).take(1)
        if first:
            raise ValueError(f"{first[0].path}: {first[0].error}")
    entries = _profile_entries(files)

    def knob(name: str, default: float) -> Column:
        return F.coalesce(number(F.col(f"_p.{name}")), F.lit(default))

    profiles = entries.select(
        "profile",
        knob("title_boost", TITLE_BOOST).alias("title_boost"),
        knob("length_bonus_cap", LENGTH_CAP).alias("length_cap"),
        knob("length_bonus_divisor", LENGTH_DIVISOR).alias("length_divisor"),
    )
    terms = _exploded_terms(entries).select(
        "profile", "bucket", F.col("key").alias("term"), number(F.col("value")).alias("weight"), "ord"
    )
    return Profiles(profiles, merge_folded(terms))


# --- weight texts ---------------------------------------------------------------


def profiles_from_texts(forms: DataFrame) -> tuple[Profiles, DataFrame]:
    """Profiles from edited weight texts, and the faulty lines.

    ``forms``: profile, core, nice, neg (texts), title_boost, length_cap,
    length_divisor.
    """
    tables = F.array(
        *[F.struct(F.lit(b).alias("bucket"), weight_lines(F.col(b)).alias("lines")) for b in BUCKETS]
    )
    lines = (
        forms.select("profile", F.explode(tables).alias("_t"))
        .select("profile", "_t.bucket", F.posexplode("_t.lines").alias("ord", "_l"))
        .select("profile", "bucket", "ord", "_l.*")
    )
    terms = merge_folded(lines.where("error is null"))
    errors = lines.where("error is not null").select("profile", "bucket", "line", "error")
    return Profiles(forms.select("profile", "title_boost", "length_cap", "length_divisor"), terms), errors


def weight_texts(terms: DataFrame) -> DataFrame:
    """The editable ``term = weight`` text of every profile and bucket."""
    line = F.concat("term", F.lit(" = "), weight_number(F.col("weight")))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return terms.groupBy("profile", "bucket").agg(
        F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("weights")
    )


# --- overrides ------------------------------------------------------------------


def override_weights(tables: Profiles, changes: Mapping[str, float], new_bucket: str | None = None) -> Profiles:
    """Profiles with some term weights replaced or added.

    A known term keeps its bucket (the first of core, nice, neg that has it). A
    new one goes to neg when negative, else to nice; ``new_bucket`` fixes the
    bucket, as the older preset does. The inputs stay as they are.
    """
    if not changes:
        return tables
    folded: dict[str, float] = {}
    placed: dict[str, str] = {}  # by the first weight given, also when a later one replaces it
    for term, weight in changes.items():
        folded[term.casefold()] = float(weight)
        placed.setdefault(term.casefold(), new_bucket or ("neg" if weight < 0 else "nice"))
    table = literal_json(folded, "map<string,double>")
    order = bucket_order(F.col("bucket"))
    owners = tables.terms.where(F.col("term").isin(*folded)).groupBy("profile", "term").agg(
        F.min(order).alias("_owner")
    )
    replaced = tables.terms.join(owners, ["profile", "term"], "left").select(
        "profile",
        "bucket",
        "term",
        F.when(order == F.col("_owner"), F.element_at(table, F.col("term"))).otherwise(F.col("weight")).alias("weight"),
        "ord",
    )
    after = (tables.terms.agg(F.max("ord")).first()[0] or 0) + 1
    rows = [
        {"term": t, "weight": w, "ord": after + i, "bucket": placed[t]} for i, (t, w) in enumerate(folded.items())
    ]
    additions = literal_json(rows, "array<struct<term:string,weight:double,ord:int,bucket:string>>")
    added = (
        tables.profiles.select("profile", F.explode(additions).alias("_a"))
        .select("profile", "_a.*")
        .join(owners, ["profile", "term"], "left_anti")
        .select("profile", "bucket", "term", "weight", "ord")
    )
    return Profiles(tables.profiles, replaced.unionByName(added))


def weight_arguments(arguments: DataFrame) -> DataFrame:
    """``term=number`` texts (column ``argument``) to term, weight and error; terms keep their case and commas."""
    read = weight_entry(F.col("argument"), fold=False)
    return arguments.select("argument", F.when(F.col("argument").isNotNull(), read).alias("_l")).select(
        "argument", "_l.term", "_l.weight", F.coalesce("_l.error", F.when(F.col("_l").isNull(), F.lit("is empty"))).alias("error")
    )
