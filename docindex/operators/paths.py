"""Access to nested documents by key or path; null stands for an absent value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = str | Sequence[str]
_NONE = object()


def parts(path: Path) -> list[str]:
    got = [path] if isinstance(path, str) else list(path)
    if not got or not all(isinstance(p, str) for p in got):
        raise ValueError(f"badarg: {path!r}")
    return got


def at(term: Column, path: Path) -> Column:
    """The value at a path through structs and maps; null where it is absent."""
    for p in parts(path):
        term = term[p]
    return term


def get(term: Column, path: Path, default=_NONE, kind: str | None = None) -> Column:
    """The value at a path; where it is absent the default, without which `badkey` is raised."""
    value = at(term, path)
    if default is _NONE:
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"badkey: {'/'.join(parts(path))}")))
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(value, other.cast(kind) if kind else other)


def find(term: Column, path: Path) -> Column:
    """struct(found, value)."""
    value = at(term, path)
    return F.struct(value.isNotNull().alias("found"), value.alias("value"))


def collect(term: Column, paths: Sequence[Path], default=_NONE, on_badkey: str = "error") -> Column:
    """The values at several paths as an array, in their order."""
    if on_badkey == "skip":
        return F.array_compact(F.array(*[at(term, p) for p in paths]))
    return F.array(*[get(term, p, default) for p in paths])


def collect_map(term: Column, paths: Sequence[Path]) -> Column:
    """The values at several paths as a struct that nests like the paths."""
    tree: dict = {}
    for path in map(parts, paths):
        node = tree
        for p in path[:-1]:
            node = node.setdefault(p, {})
        node[path[-1]] = path

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else at(term, v)).alias(k) for k, v in node.items()])

    return build(tree)


def put(term: Column, kind: T.DataType, path: Path, value: Column) -> Column:
    """`term` of type `kind` with `value` at a path; absent containers on the way are made."""
    first, *rest = parts(path)
    if isinstance(kind, T.MapType):
        inner = put(term[first], kind.valueType, rest, value) if rest else value
        others = F.map_filter(F.coalesce(term, F.create_map().cast(kind)), lambda k, _: k != first)
        return F.map_concat(others, F.create_map(F.lit(first), inner.cast(kind.valueType)))
    if not isinstance(kind, T.StructType):
        raise ValueError(f"badarg: {first!r} in {kind.simpleString()}")
    fields = {f.name: term[f.name] for f in kind.fields}
    inner = put(term[first], kind[first].dataType if first in fields else T.StructType([]), rest, value) if rest else value
    return F.struct(*[c.alias(n) for n, c in (fields | {first: inner}).items()])


def keys(term: Column, kind: T.DataType) -> Column:
    """The present keys, in order of name."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_keys(term))
    return F.array_compact(F.array(*[F.when(term[n].isNotNull(), F.lit(n)) for n in sorted(kind.names)]))


def size(term: Column, kind: T.DataType) -> Column:
    return F.size(keys(term, kind))


def fold(term: Column, start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """`step(acc, key, value)` over a map in order of key."""
    ordered = F.array_sort(F.map_entries(term), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.aggregate(ordered, start, lambda a, e: step(a, e["key"], e["value"]))


def value(term: Column) -> Column:
    """The document as plain JSON text."""
    return F.to_json(term)


def dirty_fetch(values: Column, updates: Column, removes: Column, key: str) -> Column:
    """Reads what was written: a removed key raises, an updated value wins over the stored one."""
    found = F.coalesce(updates[key], values[key])
    gone = F.array_contains(F.coalesce(removes, F.array().cast("array<string>")), key)
    return F.when(gone | found.isNull(), F.raise_error(F.lit(f"badkey: {key}"))).otherwise(found)


def dirty_keys(values: Column, updates: Column, removes: Column) -> Column:
    kept = F.array_except(F.map_keys(values), F.coalesce(removes, F.array().cast("array<string>")))
    return F.array_sort(F.array_union(kept, F.map_keys(updates)))
