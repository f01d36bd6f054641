"""Edits of a document that keep their own record: what was updated, what was removed, and on which context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.operators import paths
from docindex.operators.paths import Path, parts


def _text(path: Path) -> str:
    return "/" + "/".join(parts(path))


def _type_at(kind: T.DataType, path: list[str]) -> T.DataType | None:
    for p in path:
        if isinstance(kind, T.MapType):
            kind = kind.valueType
        elif isinstance(kind, T.StructType) and p in kind.names:
            kind = kind[p].dataType
        else:
            return None
    return kind


def _leaves(doc: Column, kind: T.StructType) -> dict:
    """The fields of a struct as a tree of columns; maps are leaves."""
    return {f.name: _leaves(doc[f.name], f.dataType) if isinstance(f.dataType, T.StructType) else doc[f.name] for f in kind.fields}


def _build(tree: dict) -> Column:
    return F.struct(*[(_build(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


def _replaced(tree: dict, at: list[str], value: Column) -> dict:
    first, *rest = at
    return tree | {first: _replaced(tree[first], rest, value) if rest else value}


@dataclass(frozen=True)
class Document:
    """A document of a known type with its pending changes; every edit gives a new one.

    It is held as one expression for each field, so a chain of edits grows only the fields it touches. `updated` and
    `removed` are arrays of paths. `ctx` is the version the document was read at, null for one that never was
    stored; nested values inherit it.
    """

    fields: dict
    kind: T.StructType
    updated: Column
    removed: Column
    ctx: Column

    @classmethod
    def stored(cls, doc: Column, kind: T.StructType, ctx: Column | None = None) -> Document:
        none = F.array().cast("array<string>")
        return cls(_leaves(doc, kind), kind, none, none, F.lit(None).cast("bigint") if ctx is None else ctx)

    @classmethod
    def of(cls, df: DataFrame, column: str, ctx: Column | None = None) -> Document:
        return cls.stored(F.col(column), df.schema[column].dataType, ctx)

    @property
    def doc(self) -> Column:
        return _build(self.fields)

    def with_context(self, ctx: Column) -> Document:
        return replace(self, ctx=ctx)

    def _place(self, path: Path) -> tuple[list[str], list[str], object]:
        """(path of the field that holds it, the rest inside a map, the field)."""
        at = parts(path)
        if _type_at(self.kind, at) is None:
            raise KeyError(f"missing_spec: {_text(path)}")
        node, n = self.fields, 0
        while n < len(at) and isinstance(node, dict):
            node, n = node[at[n]], n + 1
        return at[:n], at[n:], node

    def at(self, path: Path) -> Column:
        """The value at a path, null where it is absent."""
        _, rest, node = self._place(path)
        value = _build(node) if isinstance(node, dict) else node
        return paths.at(value, rest) if rest else value

    def get(self, path: Path, default: Column | None = None) -> Column:
        value = self.at(path)
        return F.coalesce(value, F.raise_error(F.lit(f"badkey: {_text(path)}")) if default is None else default)

    def _with(self, path: Path, value: Column) -> dict:
        head, rest, node = self._place(path)
        if isinstance(node, dict):
            kind = _type_at(self.kind, head)
            return _replaced(self.fields, head, _leaves(value, kind))
        return _replaced(self.fields, head, paths.put(node, _type_at(self.kind, head), rest, value) if rest else value)

    def _changed(self, path: Path, value: Column, changes: Column | None = None) -> Document:
        """The new value, recorded where `changes` holds: elsewhere it is the old one."""
        name = F.array(F.lit(_text(path)))
        record = name if changes is None else F.when(changes, name).otherwise(F.array().cast("array<string>"))
        return replace(self, fields=self._with(path, value), updated=F.array_union(self.updated, record))

    def set(self, path: Path, value: Column | Callable[[Column], Column] | None) -> Document:
        """Upserts; no change where the value is equal; a function gets the old value; None removes."""
        if value is None:
            return self.remove(path)
        old = self.at(path)
        new = value if isinstance(value, Column) else value(old)
        return self._changed(path, new, ~old.eqNullSafe(new))

    def remove(self, path: Path) -> Document:
        """Drops the value and records it; a value that was stored needs a context."""
        kind = _type_at(self.kind, parts(path))
        name = F.lit(_text(path))
        known = self.ctx.isNotNull() | F.array_contains(self.updated, name)
        gone = F.when(known, F.lit(None).cast(kind)).otherwise(F.raise_error(F.lit("context_required")).cast(kind))
        return replace(self, fields=self._with(path, gone), updated=F.array_remove(self.updated, name), removed=F.array_union(self.removed, F.array(name)))

    def update(self, values: dict, path: tuple[str, ...] = ()) -> Document:
        """Bulk edits by a nested dict: None removes, a dict goes deeper, sets are replaced, other values upserted."""
        done = self
        for name, value in values.items():
            at = (*path, name)
            if isinstance(value, dict):
                done = done.update(value, at)
            elif value is not None and isinstance(_type_at(self.kind, list(at)), T.ArrayType):
                done = done.set_elements(list(at), value)
            else:
                done = done.set(list(at), value)
        return done

    def _empty_or(self, path: Path) -> Column:
        kind = _type_at(self.kind, parts(path))
        return F.coalesce(self.at(path), F.array().cast(kind))

    def add_elements(self, path: Path, elements: Column) -> Document:
        return self.set(path, F.array_sort(F.array_union(self._empty_or(path), elements)))

    def del_elements(self, path: Path, elements: Column) -> Document:
        """Elements of an absent set are recorded as removed all the same: the set becomes an empty one."""
        return self._changed(path, F.array_except(self._empty_or(path), elements))

    def set_elements(self, path: Path, elements: Column) -> Document:
        return self.set(path, F.array_sort(F.array_distinct(elements)))

    def enable(self, path: Path) -> Document:
        return self.set(path, F.lit(True))

    def disable(self, path: Path) -> Document:
        return self.set(path, F.lit(False))

    def increment(self, path: Path, by: Column | int = 1) -> Document:
        return self._changed(path, F.coalesce(self.at(path), F.lit(0).cast("bigint")) + by)

    def decrement(self, path: Path, by: Column | int = 1) -> Document:
        return self.increment(path, -by)

    def has_changes(self) -> Column:
        return (F.size(self.updated) + F.size(self.removed)) > 0

    def changed_key_paths(self) -> Column:
        return F.struct(F.array_sort(self.updated).alias("updated"), F.array_sort(self.removed).alias("removed"))

    def status(self, path: Path) -> Column:
        """none, updated or removed; the default of an absent value is `none` too."""
        name = F.lit(_text(path))
        return F.when(F.array_contains(self.removed, name) & ~F.array_contains(self.updated, name), "removed").when(F.array_contains(self.updated, name), "updated").otherwise("none")


def entry(kind: str, field: str, value) -> Column:
    """A literal entry of a document: struct(type, field, value)."""
    return F.struct(F.lit(kind).alias("type"), F.lit(field).alias("field"), F.lit(value).alias("value"))
