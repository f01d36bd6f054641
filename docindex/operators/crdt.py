"""Values with pending operations: counters, flags, sets and maps, as expressions over struct columns.

A counter is struct(value, increment), a flag struct(value, op), a set struct(values, adds, removes); `ctx` columns
hold the version that a change was made on. A map is a document column with `updated` and `removed` path arrays.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.operators.typespec import ANY, Spec

COUNTER = "struct<value:bigint,increment:bigint>"
FLAG = "struct<value:boolean,op:string>"


def _error(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


# Counters


def counter(value: Column | None = None, increment: Column | None = None) -> Column:
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    return F.struct((zero if value is None else value.cast("bigint")).alias("value"), (none if increment is None else increment.cast("bigint")).alias("increment"))


def counter_value(c: Column) -> Column:
    return c["value"] + F.coalesce(c["increment"], F.lit(0))


def increment(c: Column, by: Column | int = 1) -> Column:
    return counter(c["value"], F.coalesce(c["increment"], F.lit(0)) + by)


def decrement(c: Column, by: Column | int = 1) -> Column:
    return increment(c, -by if isinstance(by, int) else -by)


def counter_set(c: Column, amount: Column) -> Column:
    """The pending increment becomes what leads from the base to `amount`; none, where they are equal."""
    return counter(c["value"], F.nullif(amount - c["value"], F.lit(0).cast("bigint")))


def counter_op(c: Column) -> Column:
    """The increment to send, null when clean."""
    return F.nullif(c["increment"], F.lit(0).cast("bigint"))


# Flags


def flag(value: Column | None = None, op: Column | None = None) -> Column:
    return F.struct((F.lit(False) if value is None else value).alias("value"), (F.lit(None).cast("string") if op is None else op).alias("op"))


def new_flag(value: bool) -> Column:
    return flag(op=F.lit("enable" if value else "disable"))


def enable(f: Column) -> Column:
    return flag(f["value"], F.lit("enable"))


def disable(f: Column, ctx: Column) -> Column:
    """Without a context a flag can't have been seen enabled: it becomes a new one."""
    return F.when(ctx.isNull(), flag(F.lit(False), F.lit("disable"))).otherwise(flag(f["value"], F.lit("disable")))


def flag_set(f: Column, value: Column, ctx: Column) -> Column:
    return F.when(value, enable(f)).otherwise(disable(f, ctx))


def flag_value(f: Column) -> Column:
    return F.when(f["op"] == "enable", True).when(f["op"] == "disable", False).otherwise(f["value"])


# Sets


def _ordered(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def new_set(values: Column, kind: str = "string") -> Column:
    """A set whose elements are all to be added."""
    none = F.array().cast(f"array<{kind}>")
    return F.struct(none.alias("values"), _ordered(values).alias("adds"), none.alias("removes"))


def stored_set(values: Column, kind: str = "string") -> Column:
    none = F.array().cast(f"array<{kind}>")
    return F.struct(_ordered(values).alias("values"), none.alias("adds"), none.alias("removes"))


def _set(s: Column, adds: Column | None = None, removes: Column | None = None) -> Column:
    return F.struct(s["values"].alias("values"), _ordered(s["adds"] if adds is None else adds).alias("adds"), _ordered(s["removes"] if removes is None else removes).alias("removes"))


def set_value(s: Column) -> Column:
    """(values and adds) without removes, in order."""
    return _ordered(F.array_except(F.array_union(s["values"], s["adds"]), s["removes"]))


def set_fold(s: Column, start: Column, step) -> Column:
    """`step(acc, element)` over the elements in order."""
    return F.aggregate(set_value(s), start, step)


def set_size(s: Column) -> Column:
    return F.size(set_value(s))


def add_elements(s: Column, elements: Column) -> Column:
    return _set(s, adds=F.array_union(s["adds"], elements))


def del_elements(s: Column, elements: Column, ctx: Column) -> Column:
    guarded = F.when(ctx.isNull(), F.raise_error(F.lit("context_required"))).otherwise(elements)
    return _set(s, removes=F.array_union(s["removes"], guarded))


def set_elements(s: Column, elements: Column) -> Column:
    return _set(s, F.array_except(elements, s["values"]), F.array_except(s["values"], elements))


def subtract(s: Column, other: Column) -> Column:
    return F.array_except(set_value(s), F.array_union(other["values"], other["adds"]))


def is_element(s: Column, e: Column) -> Column:
    has = lambda c: F.array_contains(c, e)
    return (has(s["values"]) | has(s["adds"])) & ~has(s["removes"])


def is_original_element(s: Column, e: Column) -> Column:
    return F.array_contains(s["values"], e)


def union(a: Column, b: Column) -> Column:
    return _ordered(F.array_union(set_value(a), set_value(b)))


def intersection(a: Column, b: Column) -> Column:
    return _ordered(F.array_intersect(set_value(a), set_value(b)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(set_value(a), set_value(b))) == 0


def set_ops(s: Column) -> Column:
    """struct(remove_all, add_all), null when clean."""
    clean = (F.size(s["adds"]) == 0) & (F.size(s["removes"]) == 0)
    return F.when(~clean, F.struct(s["removes"].alias("remove_all"), s["adds"].alias("add_all")))


# Maps


def merge(doc: Column, kind: T.DataType, spec: Spec, patch: Column, patch_kind: T.DataType, removed: Sequence[str] = ()) -> Column:
    """`doc` with the present fields of `patch`: maps deeply, sets, counters, flags and registers replaced.

    `removed` names the fields of the first level that the patch has as undefined.
    """
    if ANY in spec:
        inner = spec[ANY]
        if inner[0] == "map" and isinstance(kind.valueType, (T.StructType, T.MapType)):
            pick = lambda _, a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(merge(a, kind.valueType, inner[1], b, patch_kind.valueType))
        else:
            pick = lambda _, a, b: F.coalesce(b, a)
        return F.when(patch.isNull(), doc).when(doc.isNull(), patch).otherwise(F.map_zip_with(doc, patch, pick))
    has = set(patch_kind.names)
    fields = []
    for f in kind.fields:
        old = doc[f.name]
        if f.name in removed:
            new = F.lit(None).cast(f.dataType)
        elif f.name not in has:
            new = old
        elif spec[f.name][0] == "map":
            new = F.when(patch[f.name].isNull(), old).otherwise(merge(old, f.dataType, spec[f.name][1], patch[f.name], patch_kind[f.name].dataType))
        elif spec[f.name][0] == "set":
            new = F.when(patch[f.name].isNull(), old).otherwise(_ordered(patch[f.name]))
        else:
            new = F.coalesce(patch[f.name], old)
        fields.append(new.alias(f.name))
    return F.struct(*fields)


ACTIONS = ("update", "set", "remove", "append", "add_element", "del_element", "enable", "disable", "increment", "decrement")


def patch_step(doc: Column, field: T.StructField, op: Column) -> Column:
    """The new value of one field after the op struct(path, action, value), of text `value`; others leave it."""
    old, kind = doc[field.name], field.dataType
    here = op["path"] == f"/{field.name}"
    typed = op["value"].cast("string") if isinstance(kind, T.ArrayType) else op["value"].cast(kind)
    cases: list[tuple[str, Column]] = [("remove", F.lit(None).cast(kind))]
    if isinstance(kind, T.ArrayType):
        one = F.array(op["value"].cast(kind.elementType))
        empty = F.coalesce(old, F.array().cast(kind))
        cases += [(a, _ordered(F.array_union(empty, one))) for a in ("append", "add_element")]
        cases += [("del_element", F.array_except(empty, one))]
    else:
        cases += [(a, typed) for a in ("update", "set")]
    if isinstance(kind, T.BooleanType):
        cases += [("enable", F.lit(True)), ("disable", F.lit(False))]
    if isinstance(kind, T.LongType):
        cases += [("increment", F.coalesce(old, F.lit(0).cast("bigint")) + 1), ("decrement", F.coalesce(old, F.lit(0).cast("bigint")) - 1)]
    chosen = reduce(lambda w, c: w.when(op["action"] == c[0], c[1]), cases[1:], F.when(op["action"] == cases[0][0], cases[0][1]))
    return F.when(here, chosen.otherwise(_error("badaction", kind.simpleString()))).otherwise(old).alias(field.name)


def patch_fold(doc: Column, kind: T.StructType, ops: Column) -> Column:
    """A flat document after all of `ops`, an array of struct(seq, path, action, value), in the order of seq."""
    return F.aggregate(F.array_sort(ops), doc, lambda d, op: F.struct(*[patch_step(d, f, op) for f in kind.fields]))


def _applied(old: Column, kind: T.DataType, op: Column) -> Column:
    """A value after an action on it."""
    raise_ = lambda what: _error(what, kind.simpleString())
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.when(op["action"].isin("update", "set"), F.from_json(op["value"], kind)).when(op["action"] == "remove", F.lit(None).cast(kind)).otherwise(raise_("badaction"))
    return patch_case(old, kind, op)


def patch_case(old: Column, kind: T.DataType, op: Column) -> Column:
    """A leaf after an action on it; an action that its datatype hasn't is `badaction`."""
    cases: list[tuple[tuple[str, ...], Column]] = []
    if isinstance(kind, T.ArrayType):
        one = F.array(op["value"].cast(kind.elementType))
        empty = F.coalesce(old, F.array().cast(kind))
        cases += [(("append", "add_element"), _ordered(F.array_union(empty, one))), (("del_element",), F.array_except(empty, one))]
        # `remove` with a value takes an element, without one the set; a text of several elements is JSON.
        cases += [(("remove",), F.when(op["value"].isNotNull(), F.array_except(empty, one))), (("update", "set"), _ordered(F.from_json(op["value"], kind)))]
    else:
        cases += [(("update", "set"), op["value"].cast(kind)), (("remove",), F.lit(None).cast(kind))]
    if isinstance(kind, T.BooleanType):
        cases += [(("enable",), F.lit(True)), (("disable",), F.lit(False))]
    if isinstance(kind, T.LongType):
        zero = F.coalesce(old, F.lit(0).cast("bigint"))
        cases += [(("increment",), zero + 1), (("decrement",), zero - 1)]
    chosen = reduce(lambda w, c: w.when(op["action"].isin(*c[0]), c[1]), cases[1:], F.when(op["action"].isin(*cases[0][0]), cases[0][1]))
    return chosen.otherwise(_error("badaction", kind.simpleString()))


def _patched(old: Column, kind: T.DataType, op: Column, depth: int) -> Column:
    """`old`, whose path is the first `depth` names of the op's, after the op."""
    name = F.get(op["names"], F.lit(depth))
    here = F.size(op["names"]) == depth
    if isinstance(kind, T.StructType):
        fields = [F.when(name == f.name, _patched(old[f.name], f.dataType, op, depth + 1)).otherwise(old[f.name]).alias(f.name) for f in kind.fields]
        inner = F.when(name.isin(*kind.names), F.struct(*fields)).otherwise(_error("missing_spec", kind.simpleString()))
    elif isinstance(kind, T.MapType):
        others = F.map_filter(F.coalesce(old, F.create_map().cast(kind)), lambda k, _: k != name)
        new = _patched(old[name], kind.valueType, op, depth + 1)
        inner = F.map_concat(others, F.when(new.isNull(), F.create_map().cast(kind)).otherwise(F.create_map(name, new)))
    else:
        inner = _error("badkey", kind.simpleString())
    return F.when(here, _applied(old, kind, op)).otherwise(inner) if depth else inner


def _set_paths(kind: T.DataType, at: str) -> list[str]:
    """Patterns of the paths of sets."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _set_paths(f.dataType, f"{at}/{re.escape(f.name)}")]
    if isinstance(kind, T.MapType):
        return _set_paths(kind.valueType, f"{at}/[^/]+")
    return [at] if isinstance(kind, T.ArrayType) else []


def patch(doc: Column, kind: T.StructType, ops: Column) -> Column:
    """struct(doc, updated, removed): a nested document after all of `ops`, in the order of seq, and what they changed.

    `ops` is an array of struct(seq, path, action, value); a path is `/a/b`, and goes through wildcard maps by key.
    A path that the type hasn't is `missing_spec`, one below a leaf `badkey`, an unfit action `badaction`.
    """
    none = F.array().cast("array<string>")
    named = F.transform(
        F.array_sort(ops),
        lambda o: F.struct(
            F.when(o["path"].startswith("/"), F.filter(F.split(F.rtrim(F.substring(o["path"], 2, 1 << 30), F.lit("/")), "/"), lambda x: F.length(x) > -1)).otherwise(_error("badpath", "array<string>")).alias("names"),
            o["action"].alias("action"),
            o["value"].alias("value"),
        ),
    )

    sets = "|".join(_set_paths(kind, "")) or "(?!)"

    def step(a: Column, o: Column) -> Column:
        text = F.concat(F.lit("/"), F.array_join(o["names"], "/"))
        path = F.array(text)
        gone = (o["action"] == "remove") & ~(o["value"].isNotNull() & text.rlike(f"^({sets})$"))
        return F.struct(
            _patched(a["doc"], kind, o, 0).alias("doc"),
            F.when(gone, F.array_except(a["updated"], path)).otherwise(F.array_union(a["updated"], path)).alias("updated"),
            F.when(gone, F.array_union(a["removed"], path)).otherwise(F.array_except(a["removed"], path)).alias("removed"),
        )

    start = F.struct(doc.cast(kind).alias("doc"), none.alias("updated"), none.alias("removed"))
    return F.aggregate(named, start, step, lambda a: F.struct(a["doc"].alias("doc"), F.array_sort(a["updated"]).alias("updated"), F.array_sort(a["removed"]).alias("removed")))


def changed_paths(old: Column, new: Column, kind: T.StructType, prefix: str = "") -> tuple[list[Column], list[Column]]:
    """(updated, removed): for each leaf of `kind` its path where it changed, null elsewhere."""
    updated, removed = [], []
    for f in kind.fields:
        path = f"{prefix}/{f.name}"
        if isinstance(f.dataType, T.StructType):
            u, r = changed_paths(old[f.name], new[f.name], f.dataType, path)
            updated += u
            removed += r
        else:
            a, b = old[f.name], new[f.name]
            updated.append(F.when(b.isNotNull() & ~a.eqNullSafe(b), F.lit(path)))
            removed.append(F.when(a.isNotNull() & b.isNull(), F.lit(path)))
    return updated, removed


def changed_key_paths(old: Column, new: Column, kind: T.StructType) -> Column:
    """struct(updated, removed) of leaf paths."""
    updated, removed = changed_paths(old, new, kind)
    return F.struct(F.array_compact(F.array(*updated)).alias("updated"), F.array_compact(F.array(*removed)).alias("removed"))


def has_changes(updated: Column, removed: Column) -> Column:
    return (F.size(updated) + F.size(removed)) > 0
