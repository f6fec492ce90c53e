"""Score postings against keyword profiles and keep the best.

Two ways to the same result. Up to ``INLINE_TERMS`` terms the profiles become
constants of the plan and every posting is scored where it is read: no shuffle
at all. Larger profile tables are joined to the words of the postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.text import WORD, fold_case, literal_json, or_empty
from rolecast.operators.joins import lookup_join
from rolecast.operators.limits import top_per_group
from rolecast.operators.profiles import BUCKETS, Profiles, bucket_order
from rolecast.session import materialize

INLINE_TERMS = 2_000
PACK = 1_000
NOT_WORD = WORD.replace("[", "[^") + "+"

# whitespace as in rolecast.functions.text, with the other separators
_BLANK = r"\s\x1c-\x1f\x85\p{Z}"
LOOSE, STRICT, LITERAL = "loose", "strict", "literal"


@dataclass(frozen=True)
class RankRules:
    """How terms match and scores are finished.

    ``separators``: ``loose`` lets blanks, ``-`` and ``/`` stand for each other
    inside a term; ``literal`` takes terms as written; ``strict`` reproduces the
    published matcher to the letter, where a blank in a term asks for a slash and
    a closing bracket and so hardly ever matches.
    """

    separators: str = LOOSE
    digits: int | None = 3
    folded_length: bool = True
    null_text: str = ""
    older_notes: bool = False


OLDER_RULES = RankRules(separators=LITERAL, digits=None, folded_length=False, null_text="None", older_notes=True)


def _pattern_maker():
    # functions made here travel to the workers by value: they need no copy of this package

    def quoted(text: str) -> str:
        return re.sub(r"([^\w\s])", r"\\\1", text)

    def make(term: str, separators: str = LOOSE) -> str:
        """Java regex of a folded term between word boundaries."""
        if separators == LOOSE:
            body = rf"[{_BLANK}\-/]+".join(quoted(p) for p in re.split(r"[ \-/]+", term))
        elif separators == STRICT:
            body = re.sub(r"\\-", lambda _: rf"[{_BLANK}\-/]+", quoted(term))
            body = body.replace(" ", rf"[{_BLANK}\[\-/]+/\]+")
        else:
            body = quoted(term)
        if body.startswith("["):
            return f"(?<!{WORD}){body}(?!{WORD})"
        # the look-behind stands after the first character: most positions fail on that sooner
        first = re.match(r"\\?.", body, re.S)[0]
        return f"{first}(?<!{WORD}{first}){body[len(first):]}(?!{WORD})"

    return make


term_pattern = _pattern_maker()


def _compiler(separators: str):
    """Batch function that adds the matching columns; local, so it travels by value."""
    patterns = term_pattern

    def compile_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            boosted = batch.weight * batch.title_boost
            yield batch.assign(
                words=[re.findall(r"\w+", t) for t in batch.term],
                plain=[re.fullmatch(r"\w+", t) is not None for t in batch.term],
                pattern=[patterns(t, separators) for t in batch.term],
                boosted=boosted,
                label=[f"{t}({w:+.1f})" for t, w in zip(batch.term, batch.weight)],
                title_label=[f"{t}({w:+.1f})" for t, w in zip(batch.term, boosted)],
            )

    return compile_terms


_RAW_TERM = ("profile", "bucket", "term", "weight", "ord", "title_boost")
_TERM = (
    "profile string, bucket string, term string, weight double, ord int, title_boost double, "
    "words array<string>, plain boolean, pattern string, boosted double, label string, title_label string"
)
_TERMS = "array<struct<" + _TERM.replace(" string", ":string").replace(" double", ":double").replace(
    " int", ":int"
).replace(" array", ":array").replace(" boolean", ":boolean") + ">>"
_PROFILES = "array<struct<profile:string,title_boost:double,length_cap:double,length_divisor:double>>"


def _boosted(tables: Profiles) -> DataFrame:
    return tables.terms.join(tables.profiles.select("profile", "title_boost"), "profile").select(*_RAW_TERM)


def compiled_terms(tables: Profiles, rules: RankRules) -> DataFrame:
    """The term table with its match words, pattern, boosted weight and hit labels."""
    return _boosted(tables).mapInPandas(_compiler(rules.separators), _TERM)


def _inline_terms(terms: DataFrame, profiles: list[dict], rules: RankRules, most: int) -> list[dict] | None:
    """The compiled terms as constants, or None when there are more than ``most``."""
    rows = terms.limit(most + 1).collect()
    if len(rows) > most:
        return None
    boosts = {p["profile"]: p["title_boost"] for p in profiles}
    raw = [{**r.asDict(), "title_boost": boosts[r.profile]} for r in rows if r.profile in boosts]
    raw.sort(key=lambda r: (r["profile"], BUCKETS.index(r["bucket"]), r["ord"]))
    batch = pd.DataFrame(raw, columns=list(_RAW_TERM))
    return next(_compiler(rules.separators)(iter([batch]))).to_dict("records")


def _texts(postings: DataFrame, rules: RankRules) -> DataFrame:
    description = F.coalesce("description_text", F.lit(rules.null_text))
    length = F.length("_body") if rules.folded_length else F.length(description)
    return (
        postings.withColumn("_title", fold_case(F.col("title")))
        .withColumn("_body", fold_case(description))
        .withColumn("_length", length)
        .withColumn("_both", F.concat_ws("\n", "_title", "_body"))
        .drop("_body")
    )


def _bonus() -> Column:
    return F.least(F.col("_length") / F.col("_p.length_divisor"), F.col("_p.length_cap"))


def _notes(rules: RankRules) -> Column:
    title, url = F.substring(or_empty(F.col("title")), 1, 80), or_empty(F.col("url"))
    if rules.older_notes:
        return F.concat(F.lit("title='"), title, F.lit("...' url='"), url, F.lit("'"))
    return F.concat(
        F.lit("profile='"), F.col("profile"), F.lit("' title='"), title, F.lit("' url='"), url, F.lit("'")
    )


def _finish(scored: DataFrame, columns: list[str], rules: RankRules) -> DataFrame:
    score = F.round("score", rules.digits) if rules.digits is not None else F.col("score")
    return scored.withColumn("score", score).select(
        *columns, "profile", "score", "matches", _notes(rules).alias("notes")
    )


def rank(
    postings: DataFrame,
    tables: Profiles,
    rules: RankRules = RankRules(),
    inline_terms: int = INLINE_TERMS,
) -> DataFrame:
    """Every posting under every profile: ``profile``, ``score``, ``matches``, ``notes``.

    ``postings`` needs ``ingest_seq``, ``title``, ``description_text`` and ``url``.
    """
    profiles = [p.asDict() for p in tables.profiles.limit(inline_terms + 1).collect()]
    terms = _inline_terms(tables.terms, profiles, rules, inline_terms) if len(profiles) <= inline_terms else None
    if terms is None:
        return _rank_joined(postings, tables, rules)
    return _rank_inline(postings, profiles, terms, rules)


def _rank_inline(postings: DataFrame, profiles: list[dict], terms: list[dict], rules: RankRules) -> DataFrame:
    words = sorted({w for t in terms for w in t["words"]})
    vocabulary = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")

    def hits(text: str, test: str) -> Column:
        # bound first: a column used inside the filter would be rebuilt for every term
        words = f"array_intersect({text}_tokens, {text}_vocabulary)"
        found = f"{test} and forall(t.words, w -> array_contains(x.words, w)) and (t.plain or x.text rlike t.pattern)"
        return F.expr(
            f"get(transform(array(named_struct('words', {words}, 'text', {text})), "
            f"x -> filter(_terms, t -> {found})), 0)"
        )

    texts = _texts(postings, rules).withColumn("_terms", literal_json(terms, _TERMS))
    for text in ("_title", "_both"):
        texts = texts.withColumn(f"{text}_tokens", F.split(text, NOT_WORD)).withColumn(f"{text}_vocabulary", vocabulary)
    texts = (
        texts.withColumn("_title_hits", hits("_title", "t.bucket <> 'neg'"))
        .withColumn("_hits", hits("_both", "true"))
        .select(*postings.columns, "_length", "_title_hits", "_hits")
    )
    per_profile = texts.withColumn("_p", F.explode(literal_json(profiles, _PROFILES)))
    if len(profiles) > 1:
        for hits in ("_title_hits", "_hits"):
            per_profile = per_profile.withColumn(hits, F.expr(f"filter({hits}, t -> t.profile = _p.profile)"))
    total = F.expr(
        "aggregate(_title_hits, 0D, (s, t) -> s + t.boosted) + aggregate(_hits, 0D, (s, t) -> s + t.weight)"
    )

    def labels(bucket: str) -> str:
        return (
            f"concat(transform(filter(_title_hits, t -> t.bucket = '{bucket}'), t -> t.title_label), "
            f"transform(filter(_hits, t -> t.bucket = '{bucket}'), t -> t.label))"
        )

    matches = F.expr(f"named_struct('core', {labels('core')}, 'nice', {labels('nice')}, 'neg', {labels('neg')})")
    scored = per_profile.withColumn("score", total + _bonus()).withColumn("matches", matches)
    return _finish(scored.withColumn("profile", F.col("_p.profile")), postings.columns, rules)


def numbered_texts(postings: DataFrame, rules: RankRules) -> DataFrame:
    """The postings with folded texts and a number of their own, stored.

    The number tells rows with the same ``ingest_seq`` apart and spreads frequent
    words and terms.
    """
    return materialize(_texts(postings, rules).withColumn("_row", F.monotonically_increasing_id()))


def grouped_hits(texts: DataFrame, tables: Profiles, rules: RankRules) -> DataFrame:
    """``_row, profile, _hits``: the terms that were met, in the order of the profile.

    Weights are added in this order, as when the terms are constants of the plan.
    """
    # read from files, as it is looked at several times
    compiled = materialize(compiled_terms(tables, rules))
    distinct_terms = compiled.groupBy("term").agg(
        F.first("words").alias("words"), F.first("plain").alias("plain"), F.first("pattern").alias("pattern")
    )
    no_words = F.array(F.lit(""))
    by_word = distinct_terms.select(
        "term",
        F.explode(F.when(F.size("words") == 0, no_words).otherwise(F.array_distinct("words"))).alias("word"),
        F.greatest(F.size(F.array_distinct("words")), F.lit(1)).alias("n_words"),
    )
    # the blank word stands for terms without any word; every text has it
    title_words = F.array_union(F.split("_title", NOT_WORD), no_words)
    tokens = texts.select(
        "_row",
        F.explode(F.array_union(F.split("_both", NOT_WORD), no_words)).alias("word"),
        title_words.alias("_title_words"),
    ).select("_row", "word", F.array_contains("_title_words", F.col("word")).alias("in_title"))
    # a term is a candidate where all its words occur; terms of more than one word are then tested on the text
    candidates = (
        lookup_join(tokens, by_word, ["word"], spread_by="_row", how="inner")
        .groupBy("_row", "term", "n_words")
        .agg(F.count("*").alias("n"), F.count_if("in_title").alias("n_title"))
        .where(F.col("n") == F.col("n_words"))
        .select("_row", "term", (F.col("n_title") == F.col("n_words")).alias("in_title"))
    )
    known = lookup_join(
        candidates, distinct_terms.select("term", "plain", "pattern"), ["term"], spread_by="_row", how="inner"
    )
    tested = (
        known.where(~F.col("plain"))
        .join(texts.select("_row", "_title", "_both"), "_row")
        .where(F.expr("_both rlike pattern"))
        .select("_row", "term", F.expr("in_title and _title rlike pattern").alias("in_title"))
    )
    hits = known.where("plain").select("_row", "term", "in_title").unionByName(tested)
    per_profile = lookup_join(
        hits,
        compiled.select("profile", "bucket", "term", "weight", "ord", "boosted", "label", "title_label"),
        ["term"],
        spread_by="_row",
        how="inner",
    ).withColumn("in_title", F.col("in_title") & (F.col("bucket") != "neg"))
    place = bucket_order(F.col("bucket")).alias("place")
    hit = F.struct(place, "ord", "bucket", "in_title", "weight", "boosted", "label", "title_label")
    return per_profile.groupBy("_row", "profile").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))


def scored_hits(joined: DataFrame) -> DataFrame:
    """Adds ``score`` and ``matches`` to rows with ``_hits``, ``_length`` and ``_p``; null hits are none."""
    joined = joined.withColumn("_hits", F.coalesce("_hits", F.expr("filter(array(" + _NO_HIT + "), h -> false)")))
    total = F.expr(
        "aggregate(filter(_hits, h -> h.in_title), 0D, (s, h) -> s + h.boosted)"
        " + aggregate(_hits, 0D, (s, h) -> s + h.weight)"
    )

    def labels(bucket: str) -> str:
        return (
            f"concat(transform(filter(_hits, h -> h.bucket = '{bucket}' and h.in_title), h -> h.title_label), "
            f"transform(filter(_hits, h -> h.bucket = '{bucket}'), h -> h.label))"
        )

    matches = F.expr(f"named_struct('core', {labels('core')}, 'nice', {labels('nice')}, 'neg', {labels('neg')})")
    return joined.withColumn("score", total + _bonus()).withColumn("matches", matches)


def _rank_joined(postings: DataFrame, tables: Profiles, rules: RankRules) -> DataFrame:
    """The same for profile tables of any size."""
    texts = numbered_texts(postings, rules)
    grouped = grouped_hits(texts, tables, rules)
    pairs = _paired(texts.drop("_title", "_both"), tables.profiles)
    joined = pairs.withColumn("profile", F.col("_p.profile")).join(grouped, ["_row", "profile"], "left")
    return _finish(scored_hits(joined), postings.columns, rules)


def _paired(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per posting and profile, which is the size of the result itself.

    The profiles are packed into rows of about ``PACK`` and joined by pack number,
    so neither the driver nor one task ever holds the whole list.
    """
    packs = -(-profiles.count() // PACK) or 1
    packed = (
        profiles.withColumn("_pack", F.pmod(F.xxhash64("profile"), F.lit(packs)))
        .groupBy("_pack")
        .agg(F.collect_list(F.struct("profile", "title_boost", "length_cap", "length_divisor")).alias("_ps"))
    )
    each_pack = texts.withColumn("_pack", F.expr(f"explode(sequence(0L, {packs - 1}L))"))
    paired = lookup_join(each_pack, packed, ["_pack"], spread_by="_row", how="inner", broadcast_rows=100)
    return paired.withColumn("_p", F.explode("_ps")).drop("_pack", "_ps")


_NO_HIT = (
    "named_struct('place', 0, 'ord', 0, 'bucket', '', 'in_title', false, 'weight', 0D, 'boosted', 0D, 'label', '', 'title_label', '')"
)


def length_bonus(text: Column, divisor: float, cap: float) -> Column:
    """Bonus for long descriptions, by folded length."""
    return F.least(F.length(fold_case(text)) / F.lit(divisor), F.lit(cap))


def top(ranked: DataFrame, k: int) -> DataFrame:
    """Best ``k`` postings of one profile: score, then scan order."""
    return ranked.orderBy(F.desc("score"), "ingest_seq").limit(k)


def top_by_profile(ranked: DataFrame, k: int) -> DataFrame:
    """Best ``k`` postings of every profile, with their ``rank``."""
    return top_per_group(ranked, ["profile"], [F.desc("score")], k, unique=["ingest_seq"], rank="rank")
