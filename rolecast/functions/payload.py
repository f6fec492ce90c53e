"""Parsed JSON (VARIANT): fallback chains, posting fields, embedded JSON.

The helpers compose SQL text. Fallback chains make large expressions, and one
parsed text is far quicker to build than hundreds of column calls. ``v`` is
always the SQL text of a VARIANT expression (a column name, a lambda variable);
functions that return a Column say so in their signature.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.sql import bind, each, those
from rolecast.functions.text import strip, unescape

# Where an alternate listing may keep its description.
DESCRIPTION_KEYS = ("job_description", "description", "description_html")
DESCRIPTION_CONTAINERS = ("position", "job", "data", "details")

NO_ITEMS = "cast(array() as array<variant>)"


def field(v: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({v}, r'{path}', '{kind}')"


def kind_of(v: str) -> str:
    return f"coalesce(schema_of_variant({v}), '')"


def is_object(v: str) -> str:
    return f"startswith({kind_of(v)}, 'OBJECT')"


def is_array(v: str) -> str:
    return f"startswith({kind_of(v)}, 'ARRAY')"


def is_text(v: str) -> str:
    return f"({kind_of(v)} = 'STRING')"


def is_number(v: str) -> str:
    return f"({kind_of(v)} rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)')"


def elements(v: str) -> str:
    """Elements of a JSON array; anything else has none."""
    return f"if({is_array(v)}, coalesce(try_cast({v} as array<variant>), {NO_ITEMS}), {NO_ITEMS})"


def objects(v: str) -> str:
    return those(bind(v, elements), is_object)


def keep_filled(v: str) -> str:
    """The value, or null where a fallback chain moves on: null, "", 0, false, [] and {}."""
    text = f"try_cast({v} as string)"
    nothing = r"r'^(-?0(\.0*)?|false|\[\]|\{\})$'"
    return (
        f"case when coalesce({text}, '') <> '' "
        f"and ({is_text(v)} or not {text} rlike {nothing}) then {v} end"
    )


def first_value(v: str, *paths: str) -> str:
    """First filled value on the paths, as VARIANT."""
    return "coalesce(" + ", ".join(bind(field(v, p), keep_filled) for p in paths) + ")"


def as_text(v: str) -> str:
    text = f"try_cast({v} as string)"
    return f"if({kind_of(v)} = 'BOOLEAN', initcap({text}), {text})"


def first_text(v: str, *paths: str) -> str:
    """First filled value on the paths as text, ``''`` when there is none."""
    return f"coalesce({bind(first_value(v, *paths), as_text)}, '')"


def first_filled(*texts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({t}, '')" for t in texts) + ", '')"


def whole_number(v: str) -> str:
    """Number, or text that is one, as BIGINT (fractions cut); else null."""
    text = f"trim(try_cast({v} as string))"
    return (
        rf"case when {is_number(v)} then try_cast(try_cast({v} as decimal(38,6)) as bigint) "
        rf"when {text} rlike r'^[+-]?\d+$' then try_cast({text} as bigint) end"
    )


def parse_whole(text: str) -> str:
    """JSON text to VARIANT; null when it is no JSON or anything follows the value."""
    wrapped = f"try_cast(try_parse_json(concat('[', {text}, ']')) as array<variant>)"
    return bind(wrapped, lambda a: f"if(size({a}) = 1, get({a}, 0), null)")


# --- list pages ----------------------------------------------------------------

_ALTERNATE_LISTS = ("$.positions", "$.records", "$.jobs")


def posting_items(page: str) -> str:
    return bind(field(page, "$.jobPostings"), elements)


def alternate_items(page: str) -> str:
    """Items of an alternate listing; entries that are no objects are dropped."""
    return objects(first_value(page, *_ALTERNATE_LISTS))


def alternate_total(page: str) -> str:
    """Announced total; without one it is the number of entries on this page."""
    listed = bind(first_value(page, *_ALTERNATE_LISTS), elements)
    announced = first_value(page, "$.count", "$.total")
    return bind(
        announced, lambda a: f"if({a} is null, cast(size({listed}) as bigint), {whole_number(a)})"
    )


# --- fields of one listed posting ----------------------------------------------


def _label(subtitle: str) -> str:
    return f"lower({first_text(subtitle, '$.label')})"


def place_text(item: str) -> str:
    """Display location: own text, else a location subtitle, else the listed names."""
    labelled = those(objects(field(item, "$.subtitles")), lambda s: f"startswith({_label(s)}, 'location')")
    values = those(each(labelled, lambda s: first_text(s, "$.value")), lambda t: f"{t} <> ''")
    names = each(objects(field(item, "$.locations")), lambda p: first_text(p, "$.descriptor"))
    listed = f"array_join({those(names, lambda n: f'{n} <> {chr(39) * 2}')}, ', ')"
    return first_filled(first_text(item, "$.locationsText"), f"get({values}, 0)", listed)


def posted_text(item: str) -> str:
    """Value of the first posted-subtitle even when blank; only without one ``postedOn``."""
    posted = those(objects(field(item, "$.subtitles")), lambda s: f"contains({_label(s)}, 'posted')")
    return bind(
        posted,
        lambda p: f"if(size({p}) > 0, {first_text(f'get({p}, 0)', '$.value')}, {first_text(item, '$.postedOn')})",
    )


def posted_date(v: str) -> str:
    """Epoch seconds or milliseconds, digits or an ISO text to an ISO date text."""
    text = f"try_cast({v} as string)"
    number = f"try_cast({text} as double)"

    def day(seconds: str) -> str:
        # years 1 to 9999, the range of the calendar followed here
        return (
            f"if({seconds} >= -62135596800 and {seconds} < 253402300800, "
            f"date_format(date_from_unix_date(cast(floor({seconds} / 86400) as int)), 'yyyy-MM-dd'), '')"
        )

    epoch = bind(f"if({number} > 10000000000, {number} / 1000, {number})", day)
    digits = rf"({is_text(v)} and {text} rlike r'^\d+$')"
    return (
        f"case when coalesce({text}, '') = '' then '' when {is_number(v)} or {digits} then {epoch} "
        # truth values count as one and zero seconds
        f"when {kind_of(v)} = 'BOOLEAN' then '1970-01-01' "
        f"when {is_text(v)} then substring_index({text}, 'T', 1) else '' end"
    )


def nested_description(v: str) -> Column:
    """Description of an alternate listing, at any depth of the known containers.

    Nearly every payload has it on top. Below, the containers are searched depth
    first with a stack, for as many steps as the payload names containers.
    """

    def filled(found: str) -> str:
        return f"if({is_text(found)} and try_cast({found} as string) rlike r'(?U)\\S', try_cast({found} as string), null)"

    def own(node: str) -> str:
        return "coalesce(" + ", ".join(bind(field(node, f"$.{k}"), filled) for k in DESCRIPTION_KEYS) + ")"

    def step(state: str) -> str:
        def taken(node: str) -> str:
            # what is put on last is taken first
            below = ", ".join(field(node, path) for path in ("$.custom_JD.data_fields", *(f"$.{c}" for c in DESCRIPTION_CONTAINERS[::-1])))
            rest = f"slice({state}.stack, 1, size({state}.stack) - 1)"
            return f"named_struct('stack', concat({rest}, {those(f'array({below})', is_object)}), 'found', {own(node)})"

        return f"if({state}.found is not null or size({state}.stack) = 0, {state}, {bind(f'element_at({state}.stack, -1)', taken)})"

    text, named = f"to_json({v})", "|".join((*DESCRIPTION_CONTAINERS, "data_fields"))
    steps = f"""sequence(0, regexp_count({text}, r'"(?:{named})":'))"""
    start = f"named_struct('stack', array({v}), 'found', cast(null as string))"
    search = f"aggregate({steps}, {start}, (s, i) -> {step('s')}, s -> s.found)"
    mentions = f"""{is_object(v)} and {text} rlike r'"(?:{"|".join(DESCRIPTION_KEYS)})":'"""
    return F.expr(f"coalesce({own(v)}, if({mentions}, {search}, null), '')")


def location_words(v: str) -> str:
    """Strings of a location payload at any depth, joined by spaces.

    A string counts when it stands in a list, or under a key that names a place.
    Works on the JSON text, so no depth is assumed: each match is a key with its
    string, a key in front of something else, or a string in a list.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    token = rf"(?s){string}(?::{string}|:)?"
    place_key = r'(?i)^"[^"]*?(?:location|address|city|state|country|descriptor)[^"]*?":"'
    kept = those(
        f"regexp_extract_all(to_json({v}), r'{token}', 0)",
        lambda t: rf"({t} rlike r'(?s)^{string}\z' or {t} rlike r'{place_key}')",
    )
    texts = each(kept, lambda t: rf"trim(try_cast(try_parse_json(regexp_extract({t}, r'(?s)({string})\z', 1)) as string))")
    return f"array_join({those(texts, lambda t: f'{t} <> {chr(39) * 2}')}, ' ')"


# --- embedded JSON-LD ----------------------------------------------------------


def json_ld_block(page_html: Column) -> Column:
    """Decoded text of a page's first JSON-LD script, ``""`` when there is none."""
    pattern = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>\s*(.*?)\s*</script>"""
    return unescape(strip(F.regexp_extract(F.coalesce(page_html, F.lit("")), pattern, 1)))


def json_ld_posting(block: str) -> str:
    """The posting object in the JSON text ``block``, null when there is none."""

    def choose(data: str) -> str:
        items = elements(data)
        typed = those(items, lambda i: f"{is_object(i)} and {field(i, chr(36) + '.@type', 'string')} = 'JobPosting'")
        first = bind(f"get({items}, 0)", lambda f: f"if({is_object(f)}, {f}, null)")
        return f"case when {is_object(data)} then {data} when {is_array(data)} then coalesce(get({typed}, 0), {first}) end"

    return bind(parse_whole(block), choose)


def json_ld_strict(page_html: Column) -> Column:
    """Older reading: exact script tag, plain object, no entity decoding; a missing
    or unreadable block is an error."""
    block = F.regexp_extract(page_html, r'(?is)<script type="application/ld\+json">\s*(\{.*?\})\s*</script>', 1)
    missing = F.raise_error(F.lit("JSON-LD block not found"))
    return F.when(F.coalesce(block, F.lit("")) == "", missing).otherwise(F.parse_json(block))


def json_ld_place(posting: str) -> str:
    """``addressLocality`` of the job location, an object or the first of a list."""
    return first_filled(
        first_text(posting, "$.jobLocation.address.addressLocality"),
        first_text(posting, "$.jobLocation[0].address.addressLocality"),
    )
