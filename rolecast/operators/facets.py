"""Facet trees: flatten, search, merge, and the filter they stand for."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.payload import (
    elements,
    field,
    first_filled,
    first_text,
    first_value,
    is_array,
    is_object,
    objects,
    whole_number,
)
from rolecast.functions.sql import bind, quoted, those
from rolecast.functions.places import is_location_facet, option_score
from rolecast.operators.limits import top_per_group
from rolecast.session import materialize, shared_folder

# facet keys that one number of bits stands for
FACETS_PER_NUMBER = 62
# levels of a facet tree that are unrolled inside the row; deeper trees are walked level by level
LEVELS = 4

# The names a payload may use for the parts of a facet.
FACET_KEYS = ("$.facetParameter", "$.facetKey", "$.parameter", "$.name")
FACET_LABELS = ("$.descriptor", "$.label", "$.displayName")
FACET_VALUES = ("$.values", "$.items", "$.children")
OPTION_LABELS = ("$.descriptor", "$.label", "$.displayName", "$.text")
OPTION_VALUES = ("$.id", "$.value", "$.wid", "$.descriptor")
OPTION_CHILDREN = ("$.children", "$.values", "$.items")

_NODE = (
    "array<struct<facet_key:string,value:string,label:string,count:int,"
    "path:array<string>,place:array<int>,below:array<variant>>>"
)


def _listed(v: str, *wrapped: str) -> str:
    """The objects of a list, or of the list inside a wrapper object."""
    return f"if({is_array(v)}, {objects(v)}, {objects(first_value(v, *wrapped))})"


def _node(item: str, index: str, facet_key: str, path: str, place: str) -> str:
    # a count of zero falls through to whatever the total says
    count = bind(f"coalesce({first_value(item, '$.count')}, {field(item, '$.total')})", whole_number)
    below = bind(first_value(item, *OPTION_CHILDREN), elements)
    return bind(
        first_text(item, *OPTION_LABELS),
        lambda label: (
            f"named_struct('facet_key', {facet_key}, 'value', {first_text(item, *OPTION_VALUES)}, "
            f"'label', {label}, 'count', try_cast({count} as int), "
            f"'path', if({label} <> '', concat({path}, array({label})), {path}), "
            f"'place', concat({place}, array({index})), 'below', {below})"
        ),
    )


def _first_level(doc: str) -> str:
    facets = bind(first_value(doc, "$.facets", "$.facetValues"), lambda v: _listed(v, "$.facets", "$.values"))

    def options(facet: str, index: str) -> str:
        values = bind(first_value(facet, *FACET_VALUES), lambda v: _listed(v, "$.values", "$.items"))

        def nodes(key: str) -> str:
            path = f"array({first_filled(first_text(facet, *FACET_LABELS), key)})"
            return f"transform({values}, (item, i) -> {_node('item', 'i', key, path, f'array({index})')})"

        return bind(first_text(facet, *FACET_KEYS), nodes)

    return f"cast(flatten(transform({facets}, (facet, f) -> {options('facet', 'f')})) as {_NODE})"


def _next_level(nodes: str) -> str:
    node = _node("item", "i", "node.facet_key", "node.path", "node.place")
    children = f"transform({those('node.below', is_object)}, (item, i) -> {node})"
    return f"cast(flatten(transform({nodes}, node -> {children})) as {_NODE})"


_PARTS = ("facet_key", "value", "label", "count", "path")


def _named(node: Column) -> Column:
    return (node["facet_key"] != "") & (node["value"] != "") & (node["label"] != "")


def facet_options(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Flatten the facet trees of ``pages`` (``source``, ``doc``) to one row per option.

    A tree is part of one payload, so its first ``levels`` are unrolled inside the
    row and nothing is shuffled. Pages with a deeper tree are walked level by
    level, so the plan is the same at any depth. On a stream a deeper tree is an
    error; :func:`rolecast.streaming.ingest.stream_facets` takes any depth.
    ``seq`` is the position in a depth-first walk.
    """
    rows = pages.withColumn("_l0", F.expr(_first_level("doc")))
    for depth in range(1, levels):
        rows = rows.withColumn(f"_l{depth}", F.expr(_next_level(f"_l{depth - 1}")))
    deeper = F.expr(f"exists(_l{levels - 1}, n -> exists(n.below, b -> {is_object('b')}))")
    nodes = F.concat(*[F.col(f"_l{d}") for d in range(levels)])
    if pages.isStreaming:
        fault = F.raise_error(F.lit(f"a facet tree has more than {levels} levels: flatten it inside foreachBatch"))
        nodes = F.when(deeper, fault.cast(_NODE)).otherwise(nodes)
        return _numbered(rows.withColumn("_nodes", nodes))
    deep = rows.where(deeper).select("source", "doc")
    if deep.isEmpty():
        return _numbered(rows.withColumn("_nodes", nodes))
    return _numbered(rows.where(~deeper).withColumn("_nodes", nodes)).unionByName(_walked(deep))


def _numbered(rows: DataFrame) -> DataFrame:
    light = F.transform(
        F.filter("_nodes", _named), lambda n: F.struct(n["place"].alias("place"), *[n[c].alias(c) for c in _PARTS])
    )
    return rows.select("source", F.posexplode(F.array_sort(light)).alias("seq", "_n")).select(
        "source", F.col("seq").cast("bigint").alias("seq"), *[F.col(f"_n.{c}").alias(c) for c in _PARTS]
    )


def _walked(pages: DataFrame) -> DataFrame:
    """The options of trees of any depth: the nodes of a level, stored, give those of the next, until there are none."""
    spark = pages.sparkSession
    whole = materialize(pages.withColumn("_page", F.monotonically_increasing_id()))
    front = whole.select("source", "_page", F.explode(F.expr(_first_level("doc"))).alias("_n"))
    path = f"{shared_folder(spark)}/rolecast-facets-{uuid.uuid4().hex}"
    level = 0
    while True:
        front = materialize(front)
        if front.isEmpty():
            break
        flat = front.where(_named(F.col("_n"))).select("source", "_page", F.col("_n.place").alias("place"), *[F.col(f"_n.{c}").alias(c) for c in _PARTS])
        # each level once, also when this is run again
        flat.write.mode("overwrite").parquet(f"{path}/level={level}")
        front = front.select("source", "_page", F.explode(F.expr(_next_level("array(_n)"))).alias("_n"))
        level += 1
    if not level:
        return whole.select("source", F.lit(0).cast("bigint").alias("seq"), *[F.lit(None).cast("string").alias(c) for c in _PARTS]).where("false")
    found = spark.read.schema(flat.schema).parquet(f"{path}/level=*")
    # a page's options are those of one payload
    order = Window.partitionBy("_page").orderBy("place")
    return found.select("source", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), *_PARTS)


def search_options(
    options: DataFrame,
    queries: Sequence[str],
    limit: int = 10,
    location_only: bool = False,
    facet_keys: Iterable[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Best ``limit`` options per source and query.

    Ordered by score, count and label, all descending. The queries are constants
    of the plan, so each option is scored where it is read.
    """
    if facet_keys:
        options = options.where(F.col("facet_key").isin(*facet_keys))
    if location_only:
        options = options.where(is_location_facet(F.col("facet_key"), F.get("path", F.lit(0))))
    score = option_score("label", "path", "count", "q", strict)
    asked = ", ".join(map(quoted, queries))
    scored = f"transform(array({asked}), q -> named_struct('query', q, 'score', {score}))"
    # scored before the explode, so a pair is looked at once and only matches become rows
    found = F.explode(F.expr(f"filter({scored}, s -> s.score > 0)"))
    matched = options.withColumn("_s", found).select(
        *options.columns, "_s.query", F.round("_s.score", 3).alias("score")
    )
    order = [F.desc("score"), F.desc(F.coalesce("count", F.lit(0))), F.desc("label")]
    return top_per_group(matched, ["source", "query"], order, limit, unique=["seq"], rank="rank")


def merge_facet_rows(facets: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Union of facet rows (``facet_key``, ``value``, ``ord``) with repeats removed.

    Row form of a merged multimap: ``ord`` is where a value was first seen, so
    sorting by it restores the order of keys and values. One partial aggregate,
    no group is collected.
    """
    return facets.groupBy(*keys, "facet_key", "value").agg(F.min("ord").alias("ord"))


def merge_facet_maps(*maps: Column) -> Column:
    """Union of multimaps held in one row: first-seen order, repeats removed."""
    empty = F.array().cast("array<string>")

    def two(a: Column, b: Column) -> Column:
        joined = F.map_zip_with(
            a, b, lambda _, x, y: F.array_distinct(F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))
        )
        return joined

    nothing = F.map_from_arrays(empty, F.array().cast("array<array<string>>"))
    return reduce(two, [F.coalesce(m, nothing) for m in maps], nothing)


def resolve_locations(
    options: DataFrame, queries: Sequence[str], max_matches: int = 1, strict: bool = False
) -> DataFrame:
    """Facet rows chosen for the location queries of a source, merged over the queries.

    Every query is resolved against the same options. A site whose facets are
    narrowed query by query needs its facet page landed again between them.
    """
    found = search_options(options, queries, max(max_matches, 1), location_only=True, strict=strict)
    place = reduce(
        lambda acc, iq: F.when(F.col("query") == iq[1], iq[0]).otherwise(acc),
        reversed(list(enumerate(queries))),
        F.lit(len(queries)),
    )
    rows = found.select(
        "source", "facet_key", "value", F.struct(place.cast("bigint").alias("a"), F.col("rank").cast("bigint").alias("b")).alias("ord")
    )
    return merge_facet_rows(rows)


def unresolved_queries(sources: DataFrame, found: DataFrame, queries: Sequence[str]) -> DataFrame:
    """The (source, query) pairs that found no option."""
    asked = sources.select("source", F.explode(F.array(*[F.lit(q) for q in queries])).alias("query"))
    return asked.join(found.select("source", "query").distinct(), ["source", "query"], "left_anti")


def apply_facets(members: DataFrame, facets: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """Ids that carry, for every facet key, at least one of its chosen values.

    ``members`` has one row per (``key``, ``facet_key``, ``value``). No facets
    means no filter. Each id contributes one bit per facet, combined before the
    shuffle.
    """
    chosen = {k: list(v) for k, v in facets.items() if v}
    if not chosen:
        return members.select(key).distinct()
    wanted, groups = F.lit(False), []
    names = list(chosen)
    for start in range(0, len(names), FACETS_PER_NUMBER):
        part = names[start : start + FACETS_PER_NUMBER]
        bit = F.lit(None).cast("bigint")
        for i, name in enumerate(part):
            hit = (F.col("facet_key") == name) & F.col("value").isin(*chosen[name])
            bit = F.when(hit, F.lit(1 << i).cast("bigint")).otherwise(bit)
            wanted = wanted | hit
        groups.append((F.bit_or(bit), (1 << len(part)) - 1))
    bits = members.where(wanted).groupBy(key).agg(*[g.alias(f"_bits{i}") for i, (g, _) in enumerate(groups)])
    return bits.where(reduce(and_, [F.col(f"_bits{i}") == every for i, (_, every) in enumerate(groups)])).select(key)
