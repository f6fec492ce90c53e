"""Text columns: entities, tags, whitespace, case folding, description cut.

Everything here is Column -> Column, so it runs inside the scan stage with no
shuffle and no Python worker.
"""

from __future__ import annotations

import html
import html.entities
import json
import re
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.sql import apply, bind, constant, each, quoted

# Java's \s and \w are ASCII; these classes cover the Unicode sets of Python's re.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARS = "".join(
    c for c in map(chr, range(0x3001)) if c.isspace()
)


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor ``""``; ``""`` when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_json(value: object, schema: str) -> Column:
    """A nested constant. ``from_json`` of a literal is folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


# --- HTML character references -------------------------------------------------
# The tables come from the HTML5 list in Python's standard library.


def _named_references() -> dict[str, dict[str, str]]:
    by_initial: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        if name.endswith(";"):
            by_initial.setdefault(name[0], {})[name] = value
    return by_initial


def _odd_numbers() -> dict[int, str]:
    suspects = [
        *range(0xA0),
        *range(0xFDD0, 0xFDF0),
        0xFEFF,
        *(plane * 0x10000 + low for plane in range(17) for low in (0xFFFE, 0xFFFF)),
    ]
    return {n: html.unescape(f"&#{n};") for n in suspects if n == 0xFEFF or html.unescape(f"&#{n};") != chr(n)}


_NAMES = _named_references()
_ODD_NUMBERS = _odd_numbers()
_BARE_NAMES = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_RE = "^&(" + "|".join(_BARE_NAMES) + ")"
_BARE_VALUES = {n: html.entities.html5[n] for n in _BARE_NAMES}


def _number(digits: str, base: int) -> str:
    def char(code: str) -> str:
        odd = constant({str(n): c for n, c in _ODD_NUMBERS.items()}, "map<string,string>")
        return (
            f"coalesce(element_at({odd}, cast({code} as string)), "
            f"if({code} > 1114111 or {code} between 55296 and 57343, '�', "
            f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')))"
        )

    # nine digits hold every code point in either base; longer ones are out of range
    value = f"ltrim('0', {digits})"
    code = f"if(length({value}) <= 9, cast(conv(concat('0', {value}), {base}, 10) as bigint), 2000000L)"
    return bind(code, char)


def _reference(piece: str) -> str:
    """Decode the reference a piece starts with; pieces are cut in front of each ``&``."""
    name = f"regexp_extract({piece}, '^&([A-Za-z0-9]{{1,32}};)', 1)"
    bare = f"regexp_extract({piece}, '{_BARE_RE}', 1)"
    names = constant(_NAMES, "map<string,map<string,string>>")
    values = constant(_BARE_VALUES, "map<string,string>")
    without_number = f"regexp_replace({piece}, '^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?', '')"

    def numbered(pattern: str, base: int) -> str:
        return f"concat({_number(f'regexp_extract({piece}, {quoted(pattern)}, 1)', base)}, {without_number})"

    def unnamed(text: str) -> str:
        known = f"concat(element_at({values}, {text}), substring({piece}, length({text}) + 2))"
        return f"if({text} <> '', {known}, {piece})"

    def named(value: str) -> str:
        return f"if({value} is not null, concat({value}, substring({piece}, length({name}) + 2)), {bind(bare, unnamed)})"

    return (
        f"case when not startswith({piece}, '&') then {piece} "
        f"when startswith({piece}, '&amp;') then concat('&', substring({piece}, 6)) "
        f"when startswith({piece}, '&lt;') then concat('<', substring({piece}, 5)) "
        f"when startswith({piece}, '&gt;') then concat('>', substring({piece}, 5)) "
        f"when {piece} rlike '^&#[0-9]' then {numbered('^&#([0-9]+)', 10)} "
        f"when {piece} rlike '^&#[xX][0-9a-fA-F]' then {numbered('^&#[xX]([0-9a-fA-F]+)', 16)} "
        f"else {bind(f'element_at(element_at({names}, substring({name}, 1, 1)), {name})', named)} end"
    )


def unescape_sql(text: str) -> str:
    def decode(t: str) -> str:
        pieces = each(f"split({t}, '(?=&)')", _reference)
        return f"if(contains({t}, '&'), array_join({pieces}, ''), {t})"

    return bind(text, decode)


def unescape(col: Column) -> Column:
    """Decode HTML character references once, the way HTML5 readers do."""
    return apply(col, unescape_sql)


# --- case folding --------------------------------------------------------------


def _fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Code points whose full case folding differs from lower case, by result length."""
    one, many = {}, {}
    for c in map(chr, range(sys.maxunicode + 1)):
        low, fold = c.lower(), c.casefold()
        if fold != low and len(low) == 1:
            (one if len(fold) == 1 else many)[low] = fold
    many.pop("ß")
    return one, many


def _ranges(chars: str) -> str:
    """A short character class that covers ``chars`` (and near neighbours)."""
    spans: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if spans and point - spans[-1][1] <= 0x40:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


_FOLD_ONE, _FOLD_MANY = _fold_tables()


def fold_case_sql(text: str) -> str:
    odd = quoted(_ranges("".join(_FOLD_ONE) + "".join(_FOLD_MANY)))
    many = quoted(_ranges("".join(_FOLD_MANY)))
    table = constant(_FOLD_MANY, "map<string,string>")

    def expand(t: str) -> str:
        chars = each(f"split({t}, '')", lambda c: f"coalesce(element_at({table}, {c}), {c})")
        return f"if({t} rlike {many}, array_join({chars}, ''), {t})"

    def fold(low: str) -> str:
        singles = f"translate({low}, {quoted(''.join(_FOLD_ONE))}, {quoted(''.join(_FOLD_ONE.values()))})"
        plain = f"octet_length({low}) = length({low}) or not {low} rlike {odd}"
        return f"if({plain}, {low}, {bind(singles, expand)})"

    return bind(f"replace(lower(coalesce({text}, '')), 'ß', 'ss')", fold)


def fold_case(col: Column) -> Column:
    """Unicode case folding; null becomes ``""``.

    Almost every text needs ``lower`` and the sharp s only. The rest is reached
    by the rows that hold such characters.
    """
    return apply(col, fold_case_sql)


def match_key_sql(text: str) -> str:
    spelled = f"replace({fold_case_sql(text)}, '&', ' and ')"
    return f"btrim(regexp_replace({spelled}, '[^a-z0-9]+', ' '))"


def match_key(col: Column) -> Column:
    """Text reduced to ASCII words for loose comparison (labels, titles, places)."""
    return apply(col, match_key_sql)


# --- whitespace and tags -------------------------------------------------------

# Characters read as a list dash, and the block tags.
MOJIBAKE_BULLET = "â\u0080¢"
BULLET = "•"
BLOCK_TAGS = ("p", "div", "br", "li", "ul", "ol", "section", "h1", "h2", "h3", "h4", "tr")


def strip_sql(text: str) -> str:
    return f"btrim({text}, {quoted(SPACE_CHARS)})"


def _unify_bullets(text: str) -> str:
    return f"replace(replace({text}, {quoted(MOJIBAKE_BULLET)}, '-'), {quoted(BULLET)}, '-')"


def _replace(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(new)})"


def _tight_slashes(text: str) -> str:
    return f"if(contains({text}, '/'), {_replace(text, f'{SPACE}*+/{SPACE}*+', '/')}, {text})"


def tidy_sql(text: str) -> str:
    out = _unify_bullets(unescape_sql(f"coalesce({text}, '')"))
    out = f"replace({out}, chr(160), ' ')"
    # a run of blanks that is not one space already
    out = _replace(out, r" [ \t\r\f\x0b]++|[\t\r\f\x0b][ \t\r\f\x0b]*+", " ")
    out = _replace(out, rf"\n{SPACE}*\n", "\n")
    out = _replace(out, r" \n ?|\n ", "\n")
    return strip_sql(bind(out, _tight_slashes))


def tidy(col: Column) -> Column:
    """Decode references, unify bullets and spaces, tighten slashes and line breaks."""
    return apply(col, tidy_sql)


_RAW_ELEMENT = r"<(?:script|style)\b[^>]*+(?<!/)>"
_MARKUP = "|".join(
    [
        r"<script\b[^>]*+(?<!/)>.*?(?=</script[\s/>]|\z)",
        r"<style\b[^>]*+(?<!/)>.*?(?=</style[\s/>]|\z)",
        r"<!--.*?-->",
        r"</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>",
        r"<[a-z/!?][^>]*+>",
        r"[^<]++",
        r"<",
    ]
)


def strip_tags_sql(text: str, drop_scripts: bool = False) -> str:
    item = quoted(r"(?i)^<li[\s/>]")
    block = quoted("(?i)^</?(?:" + "|".join(BLOCK_TAGS) + r")[\s/>]")
    raw = f"(?i)^{_RAW_ELEMENT}"

    def piece(token: str) -> str:
        body = "''" if drop_scripts else _replace(token, raw, "")
        return (
            f"case when not startswith({token}, '<') then {unescape_sql(token)} "
            f"when {token} rlike {item} then if(endswith({token}, '/>'), '\\n- \\n', '\\n- ') "
            f"when {token} rlike {block} then '\\n' "
            f"when {token} rlike {quoted(raw)} then {body} "
            f"when {token} rlike '^<[a-zA-Z/!?]' then '' else {token} end"
        )

    tokens = f"regexp_extract_all({text}, {quoted('(?is)' + _MARKUP)}, 0)"
    return f"array_join({each(tokens, piece)}, '')"


def html_text_sql(text: str, drop_scripts: bool = False) -> str:
    return tidy_sql(strip_tags_sql(unescape_sql(f"coalesce({text}, '')"), drop_scripts))


def html_text(col: Column, drop_scripts: bool = False) -> Column:
    """HTML (possibly escaped once more) to tidy plain text; null gives ``""``.

    Block tags break lines and list items start with a dash. Script and style
    bodies are text to the parser this follows; ``drop_scripts`` removes them.
    """
    return apply(col, lambda t: html_text_sql(t, drop_scripts))


# --- description cut -----------------------------------------------------------

# Headings that open and close the useful part of a description.
START_CUES = (
    r"\bJob Description Summary:\s*",
    r"\bWhat you will be doing:\s*",
    r"\bWhat you'll be doing:\s*",
    r"\bWhat you’ll be doing:\s*",
    r"\bResponsibilities:?\s*",
    r"\bDuties/Responsibilities:?\s*",
)
STOP_CUES = (
    r"\bAdditional Job Description\b",
    r"\bThe US base salary range\b",
    r"\bThe U\.S\. base salary range\b",
    r"\bEqual Opportunity Employer\b",
    r"\bE-Verify\b",
    r"\bConnect With\b",
    r"\bExplore life at\b",
    r"\bReasonable accommodation\b",
)
# Heading spellings unified in the result.
LABELS = (
    (r"\bJob Description:\s*", ""),
    (r"\bDuties/Responsibilities\b:?", "Duties & Responsibilities:"),
    (r"\bSkills/Abilities\b:?", "Skills & Abilities:"),
    (r"\bEducation\b:?", "Education:"),
    (r"\bExperience\b:?", "Experience:"),
    (r"\bWhat we need to see:\b:?", "What we need to see:"),
    (r"\bWays to stand out from the crowd:\b:?", "Ways to stand out from the crowd:"),
)
# The older preset of the same cut.
DIGEST_START = (r"What you will be doing:\s*",)
DIGEST_STOP = (
    r"\bAdditional Job Description\b",
    r"\bConnect With Draper\b",
    r"\bJob Location\b",
    r"\bThe US base salary range\b",
    r"\bOur work is very important\b",
    r"\bDraper is committed to\b",
    r"\bExplore life at Draper\b",
)
DIGEST_LABELS = (
    (r"\bWhat you will be doing:\s*", ""),
    (r"\bWhat we need to see:\b:?", " What we need to see:"),
    (r"\bWays to stand out from the crowd:\b:?", " Ways to stand out from the crowd:"),
)
OVERVIEW_HEAD = r"Overview:\s*Draper\b"


def _java(pattern: str) -> str:
    """Case-blind and Unicode-aware, as the cue patterns are meant."""
    return "(?iU)" + re.sub(r"\\s", lambda _: SPACE, pattern)


def _required(pattern: str, first_word: bool = False) -> str | None:
    """Plain text every match must contain: a cheap test before the regex runs."""
    run = re.match(r"(?:\\b)?([A-Za-z][A-Za-z '’/-]*)(?=(.?))", pattern, re.S)
    if not run or any(c in pattern for c in "|(["):
        return None
    text = run[1][:-1] if run[2] and run[2] in "?*{" else run[1]
    if first_word:
        text = re.match("[A-Za-z]*", text)[0]
    return text.lower() or None


def _may_match(low: str, pattern: str, first_word: bool = False) -> str:
    needed = _required(pattern, first_word)
    return f"contains({low}, {quoted(needed)})" if needed else "true"


def _low(text: str) -> str:
    """Lower case as case-blind matching sees it (the long s equals s)."""
    return f"replace(lower({text}), 'ſ', 's')"


def _after_first_cue(text: str, cues: Sequence[str]) -> str:
    """Text behind the first match of the first cue (in list order) that occurs; else null."""

    def tail(low: str) -> str:
        tries = [f"if({_may_match(low, c)}, get(split({text}, {quoted(_java(c))}, 2), 1), null)" for c in cues]
        return f"coalesce({', '.join(tries)}, null)"

    return bind(_low(text), tail)


def _before_any_cue(text: str, cues: Sequence[str]) -> str:
    """Text in front of the earliest match of any cue."""

    def head(low: str) -> str:
        possible = " or ".join(_may_match(low, c) for c in cues)
        return f"if({possible}, get(split({text}, {quoted(_java('|'.join(cues)))}, 2), 0), {text})"

    return bind(_low(text), head)


def _relabel(text: str, labels: Sequence[tuple[str, str]]) -> str:
    """Apply the label edits in order.

    An edit never creates the first word of a later label, so one look at the
    incoming text decides which edits can matter.
    """

    def one(pattern: str, label: str, possible: str) -> Callable[[str], str]:
        return lambda t: f"if({possible}, {_replace(t, _java(pattern), label)}, {t})"

    def edit(low: str) -> str:
        result = text
        for pattern, label in labels:
            result = bind(result, one(pattern, label, _may_match(low, pattern, first_word=True)))
        return result

    return bind(_low(text), edit)


def description_text(
    col: Column,
    start_cues: Sequence[str] | None = None,
    stop_cues: Sequence[str] | None = None,
    drop_scripts: bool = False,
) -> Column:
    """Clean a posting's HTML description; without a cue the whole text stays."""

    def cut(text: str) -> str:
        kept = f"coalesce({_after_first_cue(text, start_cues or START_CUES)}, {text})"
        kept = bind(kept, lambda t: _before_any_cue(t, stop_cues or STOP_CUES))
        return tidy_sql(bind(kept, lambda t: _relabel(t, LABELS)))

    return apply(col, lambda t: bind(html_text_sql(t, drop_scripts), cut))


def digest_cut(
    col: Column,
    start_cues: Sequence[str] = DIGEST_START,
    stop_cues: Sequence[str] = DIGEST_STOP,
) -> Column:
    """Older cut: only what follows the start cue, null when it is missing."""

    def head(text: str) -> str:
        return strip_sql(bind(_after_first_cue(text, start_cues), lambda t: _before_any_cue(t, stop_cues)))

    return apply(col, head)


def digest_tidy(col: Column) -> Column:
    """Older tidy: all whitespace to one space, three label edits; null stays null."""

    def tidy_digest(text: str) -> str:
        out = _replace(_unify_bullets(unescape_sql(text)), rf" {SPACE}++|(?! ){SPACE}{SPACE}*+", " ")
        return strip_sql(bind(bind(out, _tight_slashes), lambda t: _relabel(t, DIGEST_LABELS)))

    return apply(col, tidy_digest)


def split_overviews(col: Column, head: str = OVERVIEW_HEAD) -> Column:
    """Array of the chunks that start at each heading; blank chunks dropped."""
    chunks = F.transform(F.split(col, f"(?i)(?={head.replace(chr(92) + 's', SPACE)})"), strip)
    return F.filter(chunks, lambda c: c != "")
