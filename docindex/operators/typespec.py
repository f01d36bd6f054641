"""Type specifications of documents: validation, registry, and compilation to Spark schemas."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.functions.codec import TYPES, decode, encode

ANY = "_"
DATATYPES = ("map", "set", "counter", "flag", "register")
Spec = Mapping[str, tuple]


class InvalidSpec(ValueError):
    """All errors of a specification, in `errors`."""

    def __init__(self, errors: list[str]):
        super().__init__(f"invalid_spec: {errors}")
        self.errors = errors


def _errors(spec, at: str) -> list[str]:
    if not isinstance(spec, Mapping):
        return [f"{at or '/'}: not a specification"]
    found = []
    if ANY in spec and len(spec) > 1:
        found.append(f"{at}/{ANY}: must be the only entry")
    for key, entry in spec.items():
        here = f"{at}/{key}"
        if not isinstance(key, str):
            found.append(f"{here}: key isn't text")
        elif not (isinstance(entry, tuple) and len(entry) == 2 and entry[0] in DATATYPES):
            found.append(f"{here}: no datatype")
        elif entry[0] == "map":
            found += _errors(entry[1], here)
        elif entry[0] == "set" and not (isinstance(entry[1], tuple) or entry[1] in TYPES):
            found.append(f"{here}: element type")
        elif entry[0] == "counter" and entry[1] != "integer" or entry[0] == "flag" and entry[1] != "boolean":
            found.append(f"{here}: inner type")
    return found


def validate(spec: Spec) -> Spec:
    if errors := _errors(spec, ""):
        raise InvalidSpec(errors)
    return spec


def is_valid(spec) -> bool:
    return not _errors(spec, "")


_registry: dict[str, Spec] = {}


def spec_ref(spec: Spec) -> str:
    """A digest of the specification; custom codecs count by their names."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=lambda f: getattr(f, "__qualname__", str(f))).encode()).hexdigest()


def register(spec: Spec, ref: str | None = None) -> str:
    ref = ref or spec_ref(spec)
    _registry[ref] = validate(spec)
    return ref


def unregister(ref: str) -> None:
    _registry.pop(ref, None)


def registered(ref: str) -> Spec:
    if ref not in _registry:
        raise KeyError(f"unknown specification {ref!r}")
    return _registry[ref]


def expand(spec: Spec, keys) -> dict[str, tuple]:
    """The entry of each of `keys`; a wildcard stands for all."""
    if ANY in spec:
        return {k: spec[ANY] for k in keys}
    if missing := [k for k in keys if k not in spec]:
        raise KeyError(f"missing_spec: {missing}")
    return {k: spec[k] for k in keys}


def path_type(spec: Spec, path: list[str]) -> tuple:
    """(datatype, inner) at a path."""
    entry = spec.get(path[0], spec.get(ANY))
    if entry is None:
        raise KeyError(f"missing_spec: {path[0]!r}")
    if len(path) == 1:
        return entry
    if entry[0] != "map":
        raise KeyError(f"badkey: {path[1:]}")
    return path_type(entry[1], path[1:])


def data_type(entry: tuple, text: bool = False) -> T.DataType:
    """The Spark type of an entry; with `text`, of its undecoded form, whose registers are strings."""
    kind, inner = entry
    if kind == "map":
        return schema(inner, text)
    leaf = T.StringType() if text or isinstance(inner, tuple) else TYPES.get(inner, T.StringType())
    return {"register": leaf, "set": T.ArrayType(leaf), "counter": T.LongType(), "flag": T.BooleanType()}[kind]


def schema(spec: Spec, text: bool = False) -> T.DataType:
    """Fixed keys are a struct, a wildcard is a map."""
    if ANY in spec:
        return T.MapType(T.StringType(), data_type(spec[ANY], text))
    return T.StructType([T.StructField(k, data_type(e, text)) for k, e in spec.items()])


def _convert(c: Column, entry: tuple, leaf, element) -> Column:
    kind, inner = entry
    if kind == "map":
        if ANY in inner:
            return F.transform_values(c, lambda _, v: _convert(v, inner[ANY], leaf, element))
        return F.when(c.isNotNull(), F.struct(*[_convert(c.getField(k), e, leaf, element).alias(k) for k, e in inner.items()]))
    if kind == "register":
        return leaf(c, inner)
    if kind == "set":
        return element(F.transform(c, lambda x: leaf(x, inner)))
    return c


def from_text(c: Column, spec: Spec, strict: bool = True) -> Column:
    """A document of text registers, decoded; sets become sorted and distinct."""
    return _convert(c, ("map", spec), lambda x, t: decode(x, t, strict), lambda s: F.array_sort(F.array_distinct(s)))


def to_text(c: Column, spec: Spec) -> Column:
    return _convert(c, ("map", spec), encode, lambda s: s)


def inferred(value) -> tuple:
    """The entry of a plain value: a dict is a map, a list a set, a bool a flag, an int a counter, others registers."""
    if isinstance(value, dict):
        if bad := [k for k in value if not isinstance(k, str)]:
            raise KeyError(f"badkey: {bad[0]!r}")
        return "map", {k: inferred(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple, set)):
        one = next(iter(value), "")
        return "set", "boolean" if isinstance(one, bool) else "integer" if isinstance(one, int) else "float" if isinstance(one, float) else "binary"
    if isinstance(value, bool):
        return "flag", "boolean"
    if isinstance(value, int):
        return "counter", "integer"
    return "register", "float" if isinstance(value, float) else "binary"


def check_fields(df: DataFrame, spec: Spec, missing_spec: str = "error") -> DataFrame:
    """`df` with the specified columns only; a column without an entry raises, unless it is to be ignored."""
    extra = [c for c in df.columns if c not in spec and ANY not in spec]
    if extra and missing_spec != "ignore":
        raise KeyError(f"missing_spec: {extra}")
    for field in df.schema.fields:
        if field.name in spec and field.dataType != (wanted := data_type(spec[field.name])):
            raise TypeError(f"datatype_mismatch: {field.name}: {wanted.simpleString()}, not {field.dataType.simpleString()}")
    return df.select(*[c for c in df.columns if c not in extra])


def _checked(c: Column, kind: T.DataType, entry: tuple, missing_spec: str, at: str) -> Column:
    wanted = data_type(entry)
    if entry[0] != "map":
        if kind != wanted:
            raise TypeError(f"datatype_mismatch: {at}: {wanted.simpleString()}, not {kind.simpleString()}")
        return F.array_sort(F.array_distinct(c)) if entry[0] == "set" else c
    inner = entry[1]
    if ANY in inner:
        if not isinstance(kind, T.MapType):
            raise TypeError(f"datatype_mismatch: {at}: a map of any keys, not {kind.simpleString()}")
        return F.transform_values(c, lambda _, v: _checked(v, kind.valueType, inner[ANY], missing_spec, f"{at}/{ANY}"))
    if not isinstance(kind, T.StructType):
        raise TypeError(f"datatype_mismatch: {at}: {wanted.simpleString()}, not {kind.simpleString()}")
    if missing_spec != "ignore" and (extra := [n for n in kind.names if n not in inner]):
        raise KeyError(f"missing_spec: {[f'{at}/{n}' for n in extra]}")
    fields = [(_checked(c[k], kind[k].dataType, e, missing_spec, f"{at}/{k}") if k in kind.names else F.lit(None).cast(data_type(e))).alias(k) for k, e in inner.items()]
    return F.when(c.isNotNull(), F.struct(*fields))


def _leaf_paths(c: Column, entry: tuple, at: Column) -> list[Column]:
    """Arrays of the paths of the present leaves."""
    if entry[0] != "map":
        return [F.when(c.isNotNull(), F.array(at))]
    if ANY in entry[1]:
        below = lambda k: _leaf_paths(c[k], entry[1][ANY], F.concat(at, F.lit("/"), k))
        return [F.flatten(F.transform(F.map_keys(c), lambda k: F.flatten(F.array_compact(F.array(*below(k))))))]
    return [p for k, e in entry[1].items() for p in _leaf_paths(c[k], e, F.concat(at, F.lit(f"/{k}")))]


def new_map(c: Column, kind: T.DataType, spec: Spec, ctx: Column | None = None, missing_spec: str = "error") -> Column:
    """struct(doc, updated, removed, ctx): a document of a specification, all of whose present leaves count as updated.

    Fields that the specification hasn't raise `missing_spec` at any depth, unless they are to be ignored; values of
    another type are a `datatype_mismatch`.
    """
    doc = _checked(c, kind, ("map", validate(spec)), missing_spec, "")
    paths = F.array_sort(F.flatten(F.array_compact(F.array(*_leaf_paths(doc, ("map", spec), F.lit(""))))))
    return F.struct(doc.alias("doc"), paths.alias("updated"), F.array().cast("array<string>").alias("removed"), (F.lit(None).cast("bigint") if ctx is None else ctx).alias("ctx"))


def new_inferred(value: dict) -> Column:
    """The same of a plain dict, with an inferred specification; undefined values are dropped."""
    entry = inferred(value)
    return new_map(_literal(value, entry), data_type(entry), entry[1])


def _literal(value, entry: tuple) -> Column:
    if entry[0] == "map":
        return F.struct(*[_literal(value[k], e).alias(k) for k, e in entry[1].items()])
    if entry[0] == "set":
        return F.array(*map(F.lit, value)).cast(data_type(entry))
    return F.lit(value).cast(data_type(entry))


def datatype_of(kind: T.DataType) -> str:
    """The datatype that a Spark type stands for."""
    if isinstance(kind, (T.StructType, T.MapType)):
        return "map"
    return "set" if isinstance(kind, T.ArrayType) else "flag" if isinstance(kind, T.BooleanType) else "register"


def is_type(kind: T.DataType, datatype: str) -> bool:
    return datatype_of(kind) == datatype or datatype == "counter" and isinstance(kind, T.LongType)
