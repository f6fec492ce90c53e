"""Human location words: aliases, country tests, location and title predicates, option score."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.sql import apply, bind, constant, each, quoted
from rolecast.functions.text import match_key, match_key_sql, or_empty

# Names that stand for the same place.
_US = ("us", "u.s.", "u.s", "usa", "u.s.a.", "united states", "united states of america", "america", "(us)")
COUNTRIES = {
    "us": _US,
    "usa": _US,
    "united states": _US,
    "uk": ("uk", "u.k.", "united kingdom", "great britain", "england", "(uk)"),
    "canada": ("canada", "ca", "(ca)"),
}
STATES = {
    "ma": "massachusetts",
    "ca": "california",
    "nc": "north carolina",
    "tx": "texas",
    "ny": "new york",
    "nj": "new jersey",
    "va": "virginia",
    "fl": "florida",
    "co": "colorado",
    "wa": "washington",
}
# Labels that name a whole country.
COUNTRY_LABELS = (
    "us", "usa", "u s", "u s a", "united states", "united states of america",
    "uk", "u k", "united kingdom", "canada",
)
# Option score by kind of match.
EXACT, EDGE_WORD, INNER_WORD, SUBSTRING, IN_PATH = 100.0, 90.0, 80.0, 65.0, 45.0
COUNTRY_BONUS, COUNT_UNIT, COUNT_CAP = 20.0, 1000.0, 3.0


def _key(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.casefold()).strip()


def _alias_table() -> dict[str, list[str]]:
    groups = [{_key(k), *map(_key, v)} for k, v in COUNTRIES.items()]
    groups += [{short, long} for short, long in STATES.items()]
    names = set().union(*groups)
    return {n: sorted(set().union(*(g for g in groups if n in g))) for n in sorted(names)}


_ALIASES = _alias_table()
_COUNTRY_WORDS = sorted({_key(w) for k, v in COUNTRIES.items() for w in (k, *v)})


def aliases_sql(query: str) -> str:
    table = constant(_ALIASES, "map<string,array<string>>")
    none = "cast(array() as array<string>)"
    return bind(match_key_sql(query), lambda k: f"if({k} = '', {none}, coalesce(element_at({table}, {k}), array({k})))")


def aliases(query: Column) -> Column:
    """Array of the reduced query and every name of the same place; empty for a blank query."""
    return apply(query, aliases_sql)


def _country_query(query: str) -> str:
    return f"{match_key_sql(query)} in ({', '.join(map(quoted, _COUNTRY_WORDS))})"


def _country_label(label: str) -> str:
    return f"{match_key_sql(label)} in ({', '.join(map(quoted, COUNTRY_LABELS))})"


def is_country_query(query: Column) -> Column:
    return apply(query, _country_query)


def is_country_label(label: Column) -> Column:
    return apply(label, _country_label)


def is_location_facet(facet_key: Column, facet_label: Column) -> Column:
    return F.contains(match_key(F.concat_ws(" ", or_empty(facet_key), or_empty(facet_label))), F.lit("location"))


def _place_matches(blob: str, query: str) -> str:
    """Test of reduced location text: whole words for a country, substring otherwise."""

    def test(names: str) -> str:
        word = f"exists({names}, a -> contains(concat(' ', {blob}, ' '), concat(' ', a, ' ')))"
        part = f"exists({names}, a -> contains({blob}, a))"
        return (
            f"case when {blob} = '' then false when size({names}) = 0 then true "
            f"when {_country_query(quoted(query))} then {word} else {part} end"
        )

    return bind(aliases_sql(quoted(query)), test)


def any_place_matches(blob: Column, queries: Sequence[str]) -> Column:
    """True when any query that is not blank matches, or there is no such query."""
    kept = [q.strip() for q in queries if q.strip()]
    if not kept:
        return F.lit(True)
    return apply(blob, lambda b: " or ".join(_place_matches(b, q) for q in kept))


def title_matches(title: Column, keywords: Sequence[str]) -> Column:
    """True when any keyword occurs in the reduced title, or there is no keyword."""
    if not keywords:
        return F.lit(True)

    def test(reduced: str) -> str:
        return " or ".join(f"contains({reduced}, {match_key_sql(quoted(k))})" for k in keywords)

    return apply(title, lambda t: bind(match_key_sql(t), test))


def option_score(label: str, path: str, count: str, query: str, strict: bool = False) -> str:
    """How well a facet option fits a location query, 0 for not at all (SQL text).

    The arguments are SQL texts. The count and country bonuses only rank
    options that match; ``strict`` adds them to every option, matching or not.
    """

    def tier(f: str, name: str) -> str:
        return (
            f"case when {f}.label = {name} then {EXACT}D "
            f"when startswith({f}.label, concat({name}, ' ')) or endswith({f}.label, concat(' ', {name})) then {EDGE_WORD}D "
            f"when contains(concat(' ', {f}.label, ' '), concat(' ', {name}, ' ')) then {INNER_WORD}D "
            f"when contains({f}.label, {name}) then {SUBSTRING}D "
            f"when contains({f}.path, {name}) then {IN_PATH}D else 0D end"
        )

    def total(f: str) -> str:
        best = f"array_max({each(f'{f}.names', lambda n: tier(f, n))})"
        bonus = (
            f"(if({f}.country and {f}.country_label, {COUNTRY_BONUS}D, 0D) "
            f"+ coalesce(least({count} / {COUNT_UNIT}D, {COUNT_CAP}D), 0D))"
        )
        scored = bind(best, lambda b: f"{b} + {bonus}" if strict else f"if({b} > 0, {b} + {bonus}, 0D)")
        return f"if(size({f}.names) = 0 or ({f}.country and not {f}.country_label), 0D, {scored})"

    joined = f"array_join({path}, ' ')"
    facts = (
        f"named_struct('label', {match_key_sql(label)}, 'path', {match_key_sql(joined)}, "
        f"'names', {aliases_sql(query)}, 'country', {_country_query(query)}, 'country_label', {_country_label(label)})"
    )
    return bind(facts, total)
