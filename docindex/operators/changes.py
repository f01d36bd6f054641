"""Change detection and the normalisation of index actions. The truth tables are data; expressions come from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UPDATED, REMOVED, ERROR = "none", "updated", "removed", "error"

#: (op, summary) -> what is emitted, for inserts and deletes.
SINGLE = {("insert", UPDATED): "insert", ("delete", NONE): "delete", ("delete", UPDATED): "badaction"}
#: (old summary, new summary) -> (kind of action on old, on new); a summary decides by SINGLE where it is named.
PAIRS = {
    (ERROR, ERROR): (None, None),
    (NONE, NONE): (None, None),
    (ERROR, NONE): (None, "insert"),
    (ERROR, UPDATED): (None, "insert"),
    (NONE, ERROR): ("delete", None),
    (UPDATED, ERROR): ("delete", None),
    (NONE, UPDATED): ("always delete", "insert"),
}


def change_status(in_values: Column, in_updates: Column, in_removes: Column, has_removes: Column, default: Column, named: Sequence = (NONE, UPDATED, REMOVED)) -> Column:
    """none, updated, removed (or what they are `named`) or the default, from where a key is found."""
    none, updated, removed = map(F.lit, named)
    return (
        F.when(in_values & ~in_updates & ~in_removes, none)
        .when(in_values, updated)
        .when(in_removes, removed)
        .when(in_updates & has_removes, updated)
        .otherwise(default)
    )


def field_status(data: Column, meta: Column, key: str, error=ERROR, named: Sequence = (NONE, UPDATED, REMOVED)) -> Column:
    """The status of a field of a document with meta struct(updated, removed, typed)."""
    removes = F.coalesce(meta["removed"], F.array().cast("array<string>"))
    updates = F.coalesce(meta["updated"], F.array().cast("array<string>"))
    return change_status(data[key].isNotNull(), F.array_contains(updates, key), F.array_contains(removes, key), F.size(removes) > 0, F.lit(error), named)


#: Summaries in order of weight: a document has that of its heaviest field.
SUMMARIES = (NONE, UPDATED, ERROR)


def change_summary(op: str, data: Column, meta: Column, keys: Sequence[str], force: bool = False) -> Column:
    """none, updated or error of a document, from its distinguished keys, as a position in SUMMARIES.

    Each status is named once, and as a number: expressions that repeat them grow too large to be compiled.
    """
    if force:
        return F.lit(SUMMARIES.index(NONE if op == "delete" else UPDATED))
    weights = [field_status(data, meta, k, 2, (0, 1, 2)) for k in keys]
    heaviest = F.greatest(*weights) if len(weights) > 1 else weights[0]
    return F.when(data.isNull() | ~F.coalesce(meta["typed"], F.lit(False)), F.lit(2)).otherwise(heaviest)


OPS = ("insert", "delete", "update")


def emitted(op: str, old: str, new: str) -> list[tuple[int, str]]:
    """(part, kind) of what an action emits, by the truth tables; `old` and `new` are summaries."""
    if op == "insert":
        kinds = (None, SINGLE.get((op, new)))
    elif op == "delete":
        kinds = (SINGLE.get((op, old)), None)
    elif (old, new) in PAIRS:
        first, second = PAIRS[old, new]
        kinds = ("delete" if first == "always delete" else SINGLE.get((first, old)), SINGLE.get((second, new)))
    else:
        kinds = ("badaction", "badaction")
    return [(part, kind) for part, kind in enumerate(kinds) if kind]


def normalise(actions: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """(seq, part, kind, data): the inserts and deletes that `actions` stand for.

    `actions` has seq, op (insert, delete, update), old, new, old_meta, new_meta; a single insert has its document
    in `new`, a single delete in `old`. An update without `old` is an insert. `part` orders the two of an update.
    """
    insert = (F.col("op") == "insert") | (F.col("op") == "update") & F.col("old").isNull()
    op = F.when(insert, 0).when(F.col("op") == "delete", 1).otherwise(2)
    of = lambda op, side: change_summary(op, F.col(side), F.col(f"{side}_meta"), keys, force)
    # One look into a constant array, of which only what is emitted becomes rows; the documents aren't copied into it.
    rows = [[F.struct(F.lit(p).alias("part"), F.lit(k).alias("kind")) for p, k in emitted(o, a, b)] for o in OPS for a in SUMMARIES for b in SUMMARIES]
    table = F.array(*[F.array(*r).cast("array<struct<part:int,kind:string>>") for r in rows])
    found = actions.select("seq", "old", "new", F.explode(F.get(table, op * 9 + of("delete", "old") * 3 + of("insert", "new"))).alias("e"))
    kind = F.when(F.col("e.kind") == "badaction", F.raise_error(F.lit("badaction")).cast("string")).otherwise(F.col("e.kind"))
    return found.select("seq", "e.part", kind.alias("kind"), F.when(F.col("e.part") == 0, F.col("old")).otherwise(F.col("new")).alias("data"))


def pair_snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Update actions (key, op, old, new, and metas) from two snapshots of a table with equal columns."""
    fields = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("_a"), F.struct(*old.columns).alias("old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*new.columns).alias("new"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    none = F.array().cast("array<string>")
    # array_remove is compiled, array_compact a function of higher order, which is interpreted. No field has this name.
    nothing = "\0"
    named = lambda test: F.array_remove(F.array(*[F.when(test(F.col(f"old.{c}"), F.col(f"new.{c}")), F.lit(c)).otherwise(nothing) for c in fields]), nothing)
    changed = named(lambda o, n: ~o.eqNullSafe(n) & n.isNotNull())
    removed = named(lambda o, n: o.isNotNull() & n.isNull())
    meta = lambda u, r: F.struct(u.alias("updated"), r.alias("removed"), F.lit(True).alias("typed"))
    op = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("update")
    whole = F.array(*[F.lit(c) for c in [key, *fields]])
    return joined.select(F.coalesce("_a", "_b").alias(key), op.alias("op"), "old", "new", meta(none, none).alias("old_meta"), meta(F.when(F.col("_a").isNull(), whole).otherwise(changed), removed).alias("new_meta"))
