"""Schemas that drift between the export files of a source.

Three steps, all distributed:
1. profile   - which fields each export has, with their JSON types (built-in expressions, partial aggregation)
2. evidence  - for each field that a record lost and each it gained from one export to the next, how many records
               hold the same value in both, with and without regard to its JSON type (window per record, then partial
               aggregation; no self-join)
3. flooding  - similarity flooding between the schema graphs of consecutive exports (fields, types, nesting),
               started from name and value similarity and propagated to convergence

Flooding proposes the correspondences: only pairs at or above ``PROPOSED`` go on, a threshold that no pair with full evidence can
miss. A rename in the report is a proposal that an exact check of values confirms. Which fields become one in the unified table is
chosen one to one by flooded score, first among the renames, then among the other proposals that agree in at least ``SUPPORT`` of
their records, so that a rename with a change of type or with some differing values is found.

A field is gone or new only if no row of an export has it, so rows of old layout in late exports keep it alive.
Unreadable or non-object JSON and null labels contribute no field; rows without id carry no evidence; an export
whose rows have no field at all still counts as an export.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollate.operators.nested import strict_json
from recollate.session import cut

EPSILON, ROUNDS = 1e-6, 60
#: How much of a pair's initial similarity is that of the names, how much of it neighbours replace in a round, and the least flooded score of a proposal.
NAME_WEIGHT, DAMPING = 0.3, 0.4
PROPOSED = (1 - NAME_WEIGHT) * (1 - DAMPING)
#: Share of the records with a lost field that must hold its value, whatever its type, in the gained one for a correspondence.
SUPPORT = 0.8
_GROUP = ("origin", "instance")


def _cell(v: Column) -> Column:
    """JSON type (null for JSON null), a hash for equality, and the JSON text of a variant."""
    kind = F.schema_of_variant(v)
    text = F.to_json(v)
    named = (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("number")
    )
    return F.struct(named.alias("t"), F.xxhash64(named, text).alias("h"), F.coalesce(text, F.lit("null")).alias("j"))


def field_rows(df: DataFrame, origin: str, json_col: str, prefix: str, label_col: str | None = None, others: bool = False) -> DataFrame:
    """origin, instance, export_no, id, readable, fields: one row per record and export; fields maps a name to type, hash, text.

    Exact copies are folded first. Other columns of df are ignored, whatever their names; with ``others`` they are kept in front
    of ``readable``, with the JSON text itself where it is no object as ``unread``, and only rows alike in all of them are copies.
    """
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    kept = [c for c in df.columns if others and c not in ("instance", "export_no", "id", json_col, label_col)]
    raw = df.select(F.lit(origin).alias("origin"), "instance", "export_no", "id", *kept, F.col(json_col).alias("__json"), label.alias("__label")).distinct()
    members = F.try_variant_get(strict_json(F.when(F.col("__json").rlike(r"^\s*\{"), F.col("__json"))), "$", "map<string,variant>")
    listed = strict_json(F.when(F.col("__label").rlike(r"^\s*\["), F.col("__label")))
    parsed = raw.select("origin", "instance", "export_no", "id", *kept, "__json", "__label", F.inline(F.array(F.struct(members.alias("__m"), listed.alias("__l")))))
    of_json = F.transform(F.map_entries("__m"), lambda e: F.struct(F.concat(F.lit(f"{prefix}."), e["key"]).alias("key"), _cell(e["value"]).alias("value")))
    quoted = F.regexp_extract(F.to_json(F.array("__label")), r"(?s)^\[(.*)\]$", 1)
    plain = F.struct(F.lit("string").alias("t"), F.xxhash64(F.lit("string"), quoted).alias("h"), quoted.alias("j"))
    of_label = F.when(F.col("__label").isNotNull(), F.array(F.struct(F.lit("label").alias("key"), F.when(F.col("__l").isNotNull(), _cell(F.col("__l"))).otherwise(plain).alias("value"))))
    none = F.filter(F.array(_null_entry()), lambda _: F.lit(False))
    entries = F.concat(F.coalesce(of_json, none), F.coalesce(of_label, none))
    kept += [F.when(F.col("__m").isNull(), F.col("__json")).alias("unread")] if others else []
    return parsed.select("origin", "instance", "export_no", "id", *kept, F.col("__m").isNotNull().alias("readable"), F.map_from_entries(entries).alias("fields"))


def _null_entry() -> Column:
    return F.struct(
        F.lit("").alias("key"),
        F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).cast("long").alias("h"), F.lit("").alias("j")).alias("value"),
    )


def layouts(rows: DataFrame) -> DataFrame:
    """origin, instance, export_no, field, t: the fields of every export with each of their types (schema-sized); field null says only that the export exists."""
    cells = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), e["value"]["t"].alias("t")))
    return rows.select("origin", "instance", "export_no", F.inline_outer(cells)).distinct()


def _profile(fields: DataFrame) -> DataFrame:
    """Per origin and instance the list of (export_no, field, types)."""
    per_field = fields.groupBy("origin", "instance", "export_no", "field").agg(F.array_sort(F.collect_set("t")).alias("types"))
    return per_field.groupBy("origin", "instance").agg(F.collect_list(F.struct("export_no", "field", "types")).alias("profile"))


def _evidence(rows: DataFrame) -> DataFrame:
    """Per origin and instance the list of (export_no, former export, lost field, gained field or null, records, those of one type)."""
    per_record = Window.partitionBy("origin", "instance", "id").orderBy("export_no", F.col("readable").desc())
    # h tells values with their types apart, v only their texts: 5 and "5" are alike.
    value = lambda _, c: F.struct(c["h"].alias("h"), F.xxhash64(F.regexp_replace(c["j"], r'(?s)^"(.*)"$', "$1")).alias("v"))
    slim = rows.filter(F.col("id").isNotNull()).select("origin", "instance", "export_no", "id", "readable", F.transform_values("fields", value).alias("f"))
    pairs = slim.select(
        "origin", "instance", "export_no", "readable", "f",
        F.lag("export_no").over(per_record).alias("former_no"), F.lag("f").over(per_record).alias("g"), F.lag("readable").over(per_record).alias("was_readable"),
    ).filter("readable AND was_readable AND former_no < export_no")
    lost = F.array_except(F.map_keys("g"), F.map_keys("f"))
    gained = F.array_except(F.map_keys("f"), F.map_keys("g"))
    each = pairs.select("origin", "instance", "export_no", "former_no", "f", "g", gained.alias("gained"), F.explode(lost).alias("lost"))
    at = lambda n, part: F.try_element_at(F.col("f"), n)[part] == F.try_element_at(F.col("g"), F.col("lost"))[part]
    same = F.transform(F.filter("gained", lambda n: at(n, "v")), lambda n: F.struct(n.alias("gained"), at(n, "h").alias("exact")))
    every = F.array(F.struct(F.lit(None).cast("string").alias("gained"), F.lit(False).alias("exact")))
    hits = each.select("origin", "instance", "export_no", "former_no", "lost", F.inline(F.concat(every, same)))
    counted = hits.groupBy("origin", "instance", "export_no", "former_no", "lost", "gained").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"))
    return counted.groupBy("origin", "instance").agg(F.collect_list(F.struct("export_no", "former_no", "lost", "gained", "n", "exact")).alias("evidence"))


def _trigrams(name: str) -> set[str]:
    text = f"  {name.lower()} "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _name_similarity(a: str, b: str) -> float:
    x, y = _trigrams(a.rpartition(".")[2]), _trigrams(b.rpartition(".")[2])
    return 2 * len(x & y) / (len(x) + len(y))


def flood(gone: dict[str, tuple], new: dict[str, tuple], agreement: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Similarity in 0..1 of each gone and new field after flooding the pairwise connectivity graph to convergence.

    Nodes of the graph are pairs: (field, field) joined to their parent pair (export, export) and to the pairs of
    their types. In each round a node takes ``DAMPING`` of the mean of its neighbours, weighted by how few neighbours those have,
    and the rest of its own initial similarity. The map is a contraction, so the rounds converge.
    """
    start: dict[tuple, float] = {("", "", "root"): 1.0}
    edges: dict[tuple, set[tuple]] = {}

    def link(a: tuple, b: tuple) -> None:
        edges.setdefault(a, set()).add(b)
        edges.setdefault(b, set()).add(a)

    for g, types_g in gone.items():
        for n, types_n in new.items():
            pair = (g, n, "field")
            start[pair] = NAME_WEIGHT * _name_similarity(g, n) + (1 - NAME_WEIGHT) * agreement.get((g, n), 0.0)
            link(("", "", "root"), pair)
            for s in types_g:
                for t in types_n:
                    start[(s, t, "type")] = 1.0 if s == t else 0.1
                    link(pair, (s, t, "type"))
    now = dict(start)
    share = {p: sum(1 / len(edges[q]) for q in edges[p]) for p in edges}
    for _ in range(ROUNDS):
        inflow = {p: sum(now[q] / len(edges[q]) for q in edges[p]) / share[p] if p in edges else now[p] for p in start}
        after = {p: (1 - DAMPING) * start[p] + DAMPING * inflow[p] for p in start}
        moved = max(abs(after[p] - now[p]) for p in start)
        now = after
        if moved < EPSILON:
            break
    return {(g, n): x for (g, n, kind), x in now.items() if kind == "field"}


def correspondences(
    gone: dict[str, tuple], new: dict[str, tuple], shared: dict[tuple[str, str], int], total: dict[str, int], like: dict[tuple[str, str], int]
) -> list[tuple[str, str, float, bool, bool]]:
    """(gone, new, score, confirmed, chosen) of the pairs that flooding proposes; confirmed: an exact check found full evidence.

    Only pairs whose flooded score reaches ``PROPOSED`` are looked at. That loses no pair with full evidence: its initial similarity is at
    least 1 - NAME_WEIGHT, and of that flooding keeps at least 1 - DAMPING, which is PROPOSED. chosen is the one-to-one
    selection by flooded score, among confirmed pairs first, then among those supported by most records.
    shared counts the records with the same value in both fields, like those with the same text of any type, total those with the gone field.
    """
    scores = flood(gone, new, {p: n / total[p[0]] for p, n in like.items()})
    proposed = {p: x for p, x in scores.items() if x >= PROPOSED - 1e-9}
    exact = {p for p in proposed if total.get(p[0], 0) and shared.get(p, 0) == total[p[0]]}
    supported = {p for p in proposed if total.get(p[0], 0) and like.get(p, 0) >= SUPPORT * total[p[0]]}
    out, left, right = [], set(), set()
    for (g, n), score in sorted(proposed.items(), key=lambda x: (x[0] not in exact, -x[1], x[0])):
        chosen = (g, n) in supported and g not in left and n not in right
        if chosen:
            left.add(g)
            right.add(n)
        if chosen or (g, n) in exact:
            out.append((g, n, score, (g, n) in exact, chosen))
    return out


_OUT = "origin string, instance string, export_no int, field string, change string, former string, score double, chosen boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            exports: dict[int, dict[str, tuple]] = {}
            for x in row["profile"]:
                if x["export_no"] is None:
                    continue
                fields = exports.setdefault(x["export_no"], {})
                if x["field"] is not None:
                    fields[x["field"]] = tuple(x["types"])
            total: dict[tuple, dict[str, int]] = {}
            shared: dict[tuple, dict[tuple[str, str], int]] = {}
            like: dict[tuple, dict[tuple[str, str], int]] = {}
            for x in row["evidence"] or ():
                at = (x["former_no"], x["export_no"])
                if x["gained"] is None:
                    total.setdefault(at, {})[x["lost"]] = x["n"]
                else:
                    shared.setdefault(at, {})[x["lost"], x["gained"]] = x["exact"]
                    like.setdefault(at, {})[x["lost"], x["gained"]] = x["n"]
            numbers = sorted(exports)
            for before, after in zip(numbers, numbers[1:], strict=False):
                a, b, at = exports[before], exports[after], (before, after)
                gone, new = {k: a[k] for k in a.keys() - b.keys()}, {k: b[k] for k in b.keys() - a.keys()}
                named = correspondences(gone, new, shared.get(at, {}), total.get(at, {}), like.get(at, {}))
                renamed = [x for x in named if x[3]]
                changes = [(n, "renamed" if confirmed else "proposed", g, s, chosen) for g, n, s, confirmed, chosen in named]
                changes += [(g, "removed", "", None, False) for g in gone.keys() - {x[0] for x in renamed}]
                changes += [(n, "added", "", None, False) for n in new.keys() - {x[1] for x in renamed}]
                changes += [(k, "retyped", "", None, False) for k in a.keys() & b.keys() if a[k] != b[k]]
                out += [(row["origin"], row["instance"], after, *c) for c in changes]
        names = ("origin", "instance", "export_no", "field", "change", "former", "score", "chosen")
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
        columns = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def drift_report(rows: DataFrame, proposed: bool = False, fields: DataFrame | None = None) -> DataFrame:
    """Each change from one export of an instance to the next: origin, instance, export_no, field, change, former, score, chosen.

    rows as of field_rows. change is added, removed, renamed or retyped; score is the flooded similarity of a rename, chosen whether
    flooding chose it among all that concern its fields. With ``proposed``, the correspondences that flooding chose without full
    evidence are listed as well, beside the removal and addition of their fields. fields: the layouts of rows if they are at hand.
    """
    profile, evidence = _profile(layouts(rows) if fields is None else fields), _evidence(rows)
    both = profile.join(evidence, [profile[c].eqNullSafe(evidence[c]) for c in _GROUP], "left")
    report = both.select(profile["origin"], profile["instance"], "profile", "evidence").mapInArrow(_compare, _OUT)
    return report if proposed else report.filter("change <> 'proposed'")


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        origins, names, homes = [], [], []
        for row in batch.to_pylist():
            parent: dict[str, str] = {}

            def find(x: str, parent: dict[str, str] = parent) -> str:
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            for pair in row["pairs"]:
                a, b = sorted((find(pair["former"]), find(pair["field"])))
                parent[b] = a
            for name in list(parent):
                origins.append(row["origin"])
                names.append(name)
                homes.append(find(name))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (origins, names, homes)], names=["origin", "field", "canonical"])


def canonical_names(report: DataFrame) -> DataFrame:
    """origin, field, canonical: chosen pairs of fields joined over all exports under the least of their names."""
    pairs = report.filter("chosen").groupBy("origin").agg(F.collect_set(F.struct("former", "field")).alias("pairs"))
    return pairs.mapInArrow(_components, "origin string, field string, canonical string")


def names_by_instance(profile: DataFrame, report: DataFrame) -> DataFrame:
    """origin, instance, field, canonical for every field of every instance (schema-sized).

    A name found anywhere holds in an instance unless two fields of that instance that stand side by side in one of its exports would
    become one by it; such an instance keeps its own names for those fields, so what is a rename elsewhere never merges two fields here.
    """
    present = profile.filter("field IS NOT NULL").select("origin", "instance", "export_no", "field").distinct()
    named = present.join(F.broadcast(canonical_names(report)), ["origin", "field"], "left").select("origin", "instance", "export_no", "field", F.coalesce("canonical", "field").alias("canonical"))
    at = ["origin", "instance", "canonical"]
    sides = named.groupBy(*at, "export_no").agg(F.count(F.lit(1)).alias("n")).groupBy(*at).agg(F.max("n").alias("most"))
    every = named.select(*at, "field").distinct().alias("a").join(sides.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in at])
    return every.select("a.origin", "a.instance", "a.field", F.when(F.col("most") == 1, F.col("a.canonical")).otherwise(F.col("a.field")).alias("canonical"))


#: JSON type of a field to the type of its column; a field of several types is text.
WIDENED = {"number": "double", "boolean": "boolean", "string": "string"}


def unified_schema(profile: DataFrame, names: DataFrame) -> list[tuple[str, str]]:
    """(canonical name, column type) of every field, by name: a driver-side list as long as the schema, whatever the number of rows."""
    types = profile.select("origin", "instance", "field", "t").distinct()
    joined = types.alias("t").join(F.broadcast(names.alias("n")), F.col("t.origin").eqNullSafe(F.col("n.origin")) & F.col("t.instance").eqNullSafe(F.col("n.instance")) & (F.col("t.field") == F.col("n.field")))
    found = joined.groupBy("canonical").agg(F.array_sort(F.collect_set("t")).alias("types")).orderBy("canonical").toLocalIterator()
    return [(r["canonical"], WIDENED.get(r["types"][0], "string") if len(r["types"]) == 1 else "string") for r in found]


def unified(rows: DataFrame, report: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """One consistent table of all exports, a row for each of rows: its columns, and one column of the widened type for each field.

    Numbers become double, booleans boolean, strings their text; a field of several types, an object or an array becomes text (JSON, a string
    without quotes). Fields are named as in names_by_instance; where a row still holds two names of one field, the one that sorts first is
    taken for the canonical column and the other stays under its own name, a column of its own. Column names are the fields' names,
    with ``_2`` and so on behind where another column has the same name in any case of letters. No row is grouped, joined by key or merged.
    """
    columns = [c for c in rows.columns if c not in ("readable", "fields")]
    profile = cut(layouts(rows)) if fields is None else fields
    names = cut(names_by_instance(profile, report))
    schema = unified_schema(profile, names)
    maps = names.groupBy("origin", "instance").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "canonical")))).alias("__names"))
    r, m = rows.alias("r"), F.broadcast(maps.alias("m"))
    joined = r.join(m, F.col("r.origin").eqNullSafe(F.col("m.origin")) & F.col("r.instance").eqNullSafe(F.col("m.instance")), "left").select("r.*", "m.__names")
    entries = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), e["value"]["j"].alias("value"))))
    cells = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at("__names", e["field"]), e["field"]).alias("name"), e["field"].alias("field"), e["value"].alias("value")))
    listed = joined.select(*columns, F.inline(F.array(F.struct(cells.alias("__cells")))))
    named = listed.select(*columns, "__cells", F.inline(F.array(F.struct(F.transform("__cells", lambda c: c["name"]).alias("__of")))))
    own = F.transform("__cells", lambda c, i: F.struct(F.when(F.array_position("__of", c["name"]) == i + 1, c["name"]).otherwise(c["field"]).alias("key"), c["value"].alias("value")))
    keyed = named.select(*columns, F.inline(F.array(F.struct(F.map_from_entries(own).alias("__values")))))
    taken = {c.lower() for c in columns}
    out = []
    for name, kind in schema:
        alias, n = name, 1
        while alias.lower() in taken:
            n += 1
            alias = f"{name}_{n}"
        taken.add(alias.lower())
        out.append(_typed(F.try_element_at("__values", F.lit(name)), kind).alias(alias))
    return keyed.select(*columns, *out)


def _typed(text: Column, kind: str) -> Column:
    """A value given as JSON text, in the type of its column; JSON null is null."""
    parsed = F.when(text != "null", text)
    if kind != "string":
        return parsed.try_cast(kind)
    return F.when(parsed.startswith('"'), F.try_variant_get(F.try_parse_json(parsed), "$", "string")).otherwise(parsed)


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

