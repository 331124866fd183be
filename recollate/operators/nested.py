"""Deeply nested JSON text to flat parent-child rows.

One higher-order expression per record does the whole walk: ``aggregate`` folds over the levels of the
text, each step a nested ``transform`` that hands every child the path of its nearest ancestor row, ``flatten``
combines the arrays, and one ``inline`` emits the rows. There is no depth limit: the fold takes as many steps
as the text has opening brackets, which bounds the depth, and steps on an empty frontier cost next to nothing.

Defined results
* text that isn't strict JSON (trailing text, repeated keys, NaN, single quotes) gives no row; null and '' neither
* a string whose text is a JSON object or array counts as that object or array, at any depth and as a whole text
* every row is one object that is an element of an array
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIST = "array<variant>"
_MAP = "map<string,variant>"
_NODE = "struct<path:string,anc:string,elem:boolean,v:variant>"


def strict_json(text: Column) -> Column:
    """The variant of a strict JSON text, else null. The brackets make trailing text an error, which the parser alone accepts."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", _LIST)
    return F.when(F.size(wrapped) == 1, wrapped[0])


def _opened(v: Column) -> Column:
    """v, or what its text holds if v is a string with a JSON object or array."""
    text = F.try_variant_get(v, "$", "string")
    is_text = F.try_variant_get(v, "$", _MAP).isNull() & F.try_variant_get(v, "$", _LIST).isNull() & text.rlike(r"^\s*[\[{]")
    return F.when(is_text, F.coalesce(strict_json(text), v)).otherwise(v)


def _node(path: Column, anc: Column, elem: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), anc.alias("anc"), elem.alias("elem"), v.alias("v"))


def _typed(frontier: Column) -> Column:
    """Each node with its members (m) or elements (a), nodes that have neither left out."""
    opened = F.transform(frontier, lambda n: _node(n["path"], n["anc"], n["elem"], _opened(n["v"])))
    typed = F.transform(
        opened,
        lambda n: F.struct(
            n["path"].alias("path"), n["anc"].alias("anc"), n["elem"].alias("elem"), F.try_variant_get(n["v"], "$", _MAP).alias("m"), F.try_variant_get(n["v"], "$", _LIST).alias("a"), n["v"].alias("v")
        ),
    )
    return F.filter(typed, lambda n: n["m"].isNotNull() | n["a"].isNotNull())


def _children(n: Column) -> Column:
    own = F.when(n["elem"] & n["m"].isNotNull(), n["path"]).otherwise(n["anc"])
    members = F.transform(F.map_entries(n["m"]), lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), own, F.lit(False), e["value"]))
    elements = F.transform(n["a"], lambda x, i: _node(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), own, F.lit(True), x))
    return F.coalesce(members, elements)


def array_objects(text: Column) -> Column:
    """array<struct<node_path, parent_path, node>>: each object that is an element of an array in the JSON text."""
    none = F.array().cast(f"array<{_NODE}>")
    row = "array<struct<node_path:string,parent_path:string,node:variant>>"
    root = strict_json(text)
    start = F.when(root.isNotNull(), F.array(_node(F.lit("$"), F.lit("$"), F.lit(False), root)).cast(f"array<{_NODE}>")).otherwise(none)
    # Each bracket, and each \u00.. that may spell one inside a string, can open one more level at most.
    levels = F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[\[{]|\\u00", "")), F.lit(0)) + 1

    def step(acc: Column, _: Column) -> Column:
        kids = F.flatten(F.transform(acc["typed"], _children)).cast(f"array<{_NODE}>")
        typed = F.filter(_typed(kids), lambda n: F.lit(True))
        return F.struct(acc["found"].alias("found"), typed.alias("typed"))

    typed_type = f"array<struct<path:string,anc:string,elem:boolean,m:{_MAP},a:{_LIST},v:variant>>"
    zero = F.struct(F.array().cast(row).alias("found"), _typed(start).cast(typed_type).alias("typed"))

    def merge(acc: Column, i: Column) -> Column:
        stepped = step(acc, i)
        hits = F.transform(
            F.filter(acc["typed"], lambda n: n["elem"] & n["m"].isNotNull()),
            lambda n: F.struct(n["path"].alias("node_path"), n["anc"].alias("parent_path"), n["v"].alias("node")),
        )
        out = F.struct(F.concat(acc["found"], hits.cast(row)).alias("found"), stepped["typed"].cast(typed_type).alias("typed"))
        return F.when(F.size(acc["typed"]) > 0, out).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), levels), zero, merge, lambda acc: acc["found"])


def flatten_records(df: DataFrame, keys: list[str], text: str, with_node: bool = False) -> DataFrame:
    """keys, node_path, parent_path (and node, its JSON text) of every array object in the texts of df, a set.

    Copies of a record are folded before the shuffle; records that share a key but differ in text each give their rows once.
    Rows with a null in a key column are left out, as nothing could be linked to them. Other columns of df are ignored.
    """
    records = df.filter(F.col(text).isNotNull()).na.drop(subset=keys).select(*keys, F.col(text).alias("__text")).groupBy(*keys).agg(F.collect_set("__text").alias("__texts"))
    rows = F.flatten(F.transform("__texts", array_objects))
    if not with_node:
        rows = F.array_distinct(F.transform(rows, lambda r: F.struct(r["node_path"], r["parent_path"])))
    else:
        rows = F.array_distinct(F.transform(rows, lambda r: F.struct(r["node_path"], r["parent_path"], F.to_json(r["node"]).alias("node"))))
    return records.select(*keys, F.inline(rows))
