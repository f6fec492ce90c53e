"""Career-site addresses: site inference, query facets, posting links, requisition ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.text import blank_to_null, let, literal_json, or_empty

# Branded hosts and the (base address, tenant, site) behind them.
BRANDED_HOSTS = {
    "explore.jobs.netflix.net": ("https://netflix.wd1.myworkdayjobs.com", "netflix", "Netflix"),
    "www.borgwarner.com": ("https://borgwarner.wd5.myworkdayjobs.com", "borgwarner", "BorgWarner_Careers"),
    "borgwarner.com": ("https://borgwarner.wd5.myworkdayjobs.com", "borgwarner", "BorgWarner_Careers"),
}
# Path parts read as a locale, and query parameters that are no facet.
LOCALES = ("en-us", "en_us", "fr-fr", "de-de")
SEARCH_PARAMETERS = ("q", "query", "searchText")
DEFAULT_LOCALE = "en-US"

FACETS = "map<string,array<string>>"
SITE = (
    "struct<base_url:string,tenant:string,site:string,locale:string,"
    f"public_prefix:string,facets:{FACETS},error:string>"
)


def is_locale(part: Column) -> Column:
    return F.lower(part).isin(*LOCALES)


def group_pairs(pairs: Column) -> Column:
    """Array of (key, value) structs to a multimap; keys and values keep their order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = F.transform(
        keys,
        lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]),
    )
    return F.map_from_arrays(keys, values)


def _form_decode(text: Column) -> Column:
    # a percent sign that opens no escape stands for itself
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_facets(query: Column) -> Column:
    """Facet multimap of a query string: repeated keys make lists, blanks are dropped."""
    parts = F.filter(F.split(or_empty(query), "&"), lambda p: p.rlike("(?s)=."))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("key"),
            _form_decode(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("value"),
        ),
    )
    facets = F.filter(pairs, lambda p: ~p["key"].isin(*SEARCH_PARAMETERS))
    return let(facets, group_pairs)


def mapping_facets(values: Column) -> Column:
    """The same rules for a multimap given as such: list blanks and search text dropped."""
    kept = F.map_filter(values, lambda k, _: ~k.isin(*SEARCH_PARAMETERS))
    return F.transform_values(kept, lambda _, v: F.filter(v, lambda x: or_empty(x) != ""))


def single_facets(values: Column) -> Column:
    """A plain key-to-string map: one-element lists, blanks kept."""
    kept = F.map_filter(values, lambda k, _: ~k.isin(*SEARCH_PARAMETERS))
    return F.transform_values(kept, lambda _, v: F.array(v))


def assigned_facets(assignments: Column) -> Column:
    """Array of ``key=value`` texts to a multimap; a text without ``=`` is an error."""
    checked = F.transform(
        assignments,
        lambda a: F.when(F.contains(a, F.lit("=")), a).otherwise(
            F.raise_error(F.concat(F.lit("facet must be key=value, got: "), a))
        ),
    )
    pairs = F.transform(
        checked,
        lambda a: F.struct(
            F.substring_index(a, "=", 1).alias("key"),
            F.regexp_replace(a, "(?s)^[^=]*=", "").alias("value"),
        ),
    )
    return let(pairs, group_pairs)


def append_facets(left: Column, right: Column) -> Column:
    """Merge two multimaps by appending, without removing repeats."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(
        left, right, lambda _, a, b: F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
    )


def infer_site(url: Column, locale: Column | str = DEFAULT_LOCALE) -> Column:
    """Struct of everything a public address tells about its site; see ``SITE``.

    Problems come back in ``error`` so that one bad address does not end the job.
    """
    default_locale = F.lit(locale) if isinstance(locale, str) else locale
    clean = F.regexp_replace(F.regexp_replace(or_empty(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    split = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"
    branded = literal_json(
        {h: {"base": b, "tenant": t, "site": s} for h, (b, t, s) in BRANDED_HOSTS.items()},
        "map<string,struct<base:string,tenant:string,site:string>>",
    )

    def parts(address: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(address, split, 3), ";[^/]*$", "")
        host = F.regexp_extract(address, split, 2)
        return F.struct(
            F.lower(F.regexp_extract(address, split, 1)).alias("scheme"),
            host.alias("host"),
            F.filter(F.split(path, "/"), lambda p: p != "").alias("path"),
            query_facets(F.regexp_extract(address, split, 4)).alias("facets"),
            F.element_at(branded, F.lower(host)).alias("known"),
        )

    def locale_cut(p: Column) -> Column:
        strip_first = is_locale(F.get(p["path"], F.lit(0))) & (F.size(p["path"]) > 1)
        return F.when(strip_first, 1).otherwise(0)

    def site(p: Column, skip: Column) -> Column:
        rest = F.slice(p["path"], skip + 1, F.size(p["path"]))
        part = lambda i: F.get(rest, F.lit(i))
        word = lambda i: F.lower(part(i))
        vanity = p["known"].isNotNull() & (
            (F.size(p["path"]) == 0) | (F.lower(F.get(p["path"], F.lit(0))) == "careers")
        )
        service = (F.size(rest) >= 5) & (word(0) == "wday") & (word(1) == "cxs")
        shared = ~service & (F.size(rest) >= 3) & (word(0) == "recruiting")
        base = F.concat(p["scheme"], F.lit("://"), p["host"])
        host_tenant = F.substring_index(p["host"], ".", 1)
        no_facets = F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<array<string>>")
        )

        def row(base_url, tenant, name, lang, prefix, facets, error) -> Column:
            values = [base_url, tenant, name, lang, prefix, facets, error]
            names = ["base_url", "tenant", "site", "locale", "public_prefix", "facets", "error"]
            return F.struct(*[v.alias(n) for v, n in zip(values, names)]).cast(SITE)

        null = F.lit(None).cast("string")
        name = F.when(service, part(3)).when(shared, part(2)).otherwise(part(0))
        return (
            F.when(p["scheme"] == "", row(null, null, null, null, null, no_facets, F.lit("not an absolute address")))
            .when(
                vanity,
                row(
                    p["known"]["base"], p["known"]["tenant"], p["known"]["site"],
                    default_locale, null, p["facets"], null,
                ),
            )
            .when(name.isNull(), row(null, null, null, null, null, no_facets, F.lit("no site name in the address")))
            .otherwise(
                row(
                    base,
                    F.when(service, part(2)).when(shared, part(1)).otherwise(host_tenant),
                    name,
                    F.when(skip > 0, F.get(p["path"], F.lit(0))).otherwise(default_locale),
                    F.when(shared, F.concat(F.lit("/"), F.array_join(F.slice(p["path"], 1, skip + 3), "/"))),
                    p["facets"],
                    null,
                )
            )
        )

    return let(let(clean, parts), lambda p: let(locale_cut(p), lambda skip: site(p, skip)))


def _slashed(prefix: Column) -> Column:
    return F.when(prefix.startswith("/"), prefix).otherwise(F.concat(F.lit("/"), prefix))


def public_prefix(site: Column, locale: Column, prefix: Column) -> Column:
    """Path in front of every public page of a site."""
    return F.coalesce(_slashed(blank_to_null(prefix)), F.concat(F.lit("/"), locale, F.lit("/"), site))


def list_address(base: Column, tenant: Column, site: Column) -> Column:
    return F.concat(base, F.lit("/wday/cxs/"), tenant, F.lit("/"), site, F.lit("/jobs"))


def detail_address(base: Column, tenant: Column, site: Column) -> Column:
    return F.concat(base, F.lit("/wday/cxs/"), tenant, F.lit("/"), site, F.lit("/job"))


def referer(base: Column, site: Column, locale: Column, prefix: Column) -> Column:
    return F.concat(base, public_prefix(site, locale, prefix))


def posting_address(base: Column, prefix: Column, path: Column) -> Column:
    """Public address of a posting; ``prefix`` comes from :func:`public_prefix`."""

    def build(p: Column) -> Column:
        joined = F.concat(base, F.regexp_replace(prefix, "/+$", ""), _slashed(p))
        return (
            F.when(p == "", F.concat(base, prefix))
            .when(p.startswith("http://") | p.startswith("https://"), p)
            .otherwise(joined)
        )

    return let(or_empty(path), build)


def requisition_id(path: Column, query_suffix: bool = True) -> Column:
    """Requisition number at the end of a posting path, ``""`` when there is none."""
    tail = r"(?:\?.*)?" if query_suffix else ""
    return F.regexp_extract(or_empty(path), rf"_([A-Za-z]*\p{{Nd}}+){tail}\n?\z", 1)
