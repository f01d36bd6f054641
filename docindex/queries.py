"""The registered queries: each applies the engine's operators to the test tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.functions import codec, keys
from docindex.operators import changes, crdt, merge, paths, typespec
from docindex.operators.documents import Document
from docindex.plans import catalog
from docindex.plans.index import HashIndex, RingIndex, SimpleIndex, join_base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as text: the keys of an index are strings."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


# Index definitions over the test tables

BY_CUSTOMER = HashIndex("orders_by_status_customer", "orders", ("o_orderstatus", "o_custkey"), ("o_orderkey", "o_orderpriority"), partition_by=("o_orderstatus", "o_custkey"), cardinality="many")
BY_KEY = HashIndex("orders_by_key", "orders", ("o_orderkey",), ("o_custkey", "o_orderpriority"), partition_by=("o_orderkey",))
BY_BRAND = HashIndex("parts_by_brand", "parts", ("p_brand",), ("p_partkey", "p_type"), partition_by=("p_brand",), partitions=32, cardinality="many")
BY_SEGMENT = HashIndex("customers_by_segment", "customers", ("c_mktsegment", "c_custkey"), ("c_nationkey",), partition_by=("c_mktsegment",), aggregate_by=("c_mktsegment",))
BY_SEGMENT_NATION = HashIndex("customers_by_segment_nation", "customers", ("c_mktsegment", "c_nationkey"), ("c_custkey",), partition_by=("c_mktsegment",), aggregate_by=("c_mktsegment",), cardinality="many")
SIMPLE = SimpleIndex("things_by_customer", "orders", ("o_custkey",), ("o_orderkey",))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_type")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_mktsegment")


def some_customer(spark: SparkSession, sf_dir: str) -> str:
    """The least customer with an order, which exists at any scale."""
    return str(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").agg(F.min("o_custkey")).first()[0])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer through the covering index, joined back to their rows."""
    pattern = {"o_orderstatus": "F", "o_custkey": some_customer(spark, sf_dir)}
    found = BY_CUSTOMER.match(BY_CUSTOMER.build(orders(spark, sf_dir)), pattern)
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return join_base(found, base, "o_orderkey", "o_orderkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")


@query
def index_base_join(spark, sf_dir):
    return flagship(spark, sf_dir).select("o_orderkey", "o_custkey", "c_name", "o_totalprice")


# Paths and codecs

CUSTOMER_SPEC = {"id": ("register", "integer"), "info": ("map", {"segment": ("register", "binary"), "name": ("register", "binary")}), "balance": ("register", "float")}


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name")).alias("info"),
        F.col("c_acctbal").alias("balance"),
    )
    return table(spark, sf_dir, "customer").select(doc.alias("doc"))


@query
def kv_get_path(spark, sf_dir):
    doc = F.col("doc")
    return customer_docs(spark, sf_dir).select(paths.get(doc, "id").alias("id"), paths.get(doc, ["info", "segment"]).alias("segment"))


@query
def kv_get_default(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", paths.get(props, "k", "none").alias("k"), paths.get(props, "zz", "none").alias("zz"))


@query
def kv_find(spark, sf_dir):
    found = paths.find(F.col("doc"), ["info", "name"])
    return customer_docs(spark, sf_dir).select(F.col("doc.id").alias("id"), found["found"].alias("found"), found["value"].alias("value"))


@query
def kv_put_path(spark, sf_dir):
    docs = customer_docs(spark, sf_dir)
    new = paths.put(F.col("doc"), docs.schema["doc"].dataType, ["info", "name"], F.upper("doc.info.segment"))
    return docs.select(new.alias("d")).select(F.col("d.id").alias("id"), F.col("d.info.segment").alias("segment"), F.col("d.info.name").alias("name"))


@query
def map_collect(spark, sf_dir):
    got = paths.collect(F.col("doc"), [["info", "segment"], ["info", "name"]], on_badkey="skip")
    tree = paths.collect_map(F.col("doc"), [["info", "segment"], ["id"]])
    return customer_docs(spark, sf_dir).select(F.array_join(got, "|").alias("collected"), tree["info"]["segment"].alias("segment"), tree["id"].alias("id"))


@query
def map_keys(spark, sf_dir):
    docs = customer_docs(spark, sf_dir)
    kind = docs.schema["doc"].dataType["info"].dataType
    return docs.select(F.col("doc.id").alias("id"), F.array_join(paths.keys(F.col("doc.info"), kind), ",").alias("names"), paths.size(F.col("doc.info"), kind).cast("long").alias("n"))


@query
def kv_fold(spark, sf_dir):
    props = F.create_map(F.lit("a"), F.col("c_custkey"), F.lit("b"), F.col("c_nationkey").cast("long"))
    total = paths.fold(props, F.lit(0).cast("long"), lambda a, _, v: a * 31 + v)
    return table(spark, sf_dir, "customer").select("c_custkey", total.alias("folded"))


@query
def dirty_fetch(spark, sf_dir):
    values = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    updates = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("status"), F.lit("U"))).otherwise(F.create_map().cast("map<string,string>"))
    removes = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("priority"))).otherwise(F.array().cast("array<string>"))
    got = paths.dirty_fetch(values, updates, removes, "status")
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("status"), F.array_join(paths.dirty_keys(values, updates, removes), ",").alias("names"))


@query
def map_wildcard(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))  # as many entries as event types
    spec = {typespec.ANY: ("counter", "integer")}
    kept = maps.select("user_id", F.col("counts").cast(typespec.schema(spec)).alias("counts"))
    return kept.select("user_id", F.explode("counts").alias("event_type", "n"))


@query
def codec_decode(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "x1").otherwise(F.col("o_custkey").cast("string"))
    yes = F.when(F.col("o_orderkey") % 3 == 0, "true").when(F.col("o_orderkey") % 3 == 1, "false").otherwise("")
    real = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).otherwise("")
    dec = lambda c, k: codec.decode(c, k, strict=False)
    return table(spark, sf_dir, "orders").select("o_orderkey", dec(raw, "integer").alias("n"), dec(yes, "boolean").alias("b"), dec(real, "float").alias("x"))


@query
def codec_encode(spark, sf_dir):
    high = F.col("o_totalprice") > 100_000
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.encode(F.col("o_custkey"), "integer").alias("n"), codec.encode(F.when(F.col("o_orderkey") % 4 != 0, high), "boolean").alias("b"))


@query
def register_base(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.from_base(F.lower(F.hex("o_orderkey")), 16).alias("from_hex"))


@query
def typed_document(spark, sf_dir):
    """A document of text registers, decoded by its specification."""
    spec = {"id": ("register", "integer"), "ok": ("register", "boolean"), "tags": ("set", "integer"), "at": ("map", {"price": ("register", "float")})}
    raw = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("ok"),
        F.array(F.lit("3"), (F.col("o_custkey") % 4).cast("string"), F.lit("3")).alias("tags"),
        F.struct(F.concat(F.col("o_custkey").cast("string"), F.lit(".25")).alias("price")).alias("at"),
    )
    doc = table(spark, sf_dir, "orders").select(typespec.from_text(raw, typespec.validate(spec)).alias("d"))
    return doc.select("d.id", "d.ok", F.array_join(F.col("d.tags").cast("array<string>"), ",").alias("tags"), F.col("d.at.price").alias("price"))


# Keys and hashing


@query
def gen_key(spark, sf_dir):
    key = keys.gen_key([F.col("p_brand"), F.col("p_type")])
    back = keys.split_key(key, ["brand", "type"])
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("joined"), back["type"].alias("type"))


@query
def jump_hash(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k).select(k, keys.jump_bucket(k, 8).alias("b8"), keys.jump_bucket(k, 128).alias("b128"))


@query
def string_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", keys.string_hash(F.col("p_brand")).alias("h"))


@query
def partition_ids(spark, sf_dir):
    both = [(p, i, o) for o in ("asc", "desc") for i, p in enumerate(BY_KEY.partition_identifiers(o))]
    return spark.createDataFrame(both, "identifier string, pos long, sort string")


@query
def partition_sizes(spark, sf_dir):
    sizes = BY_BRAND.build(parts(spark, sf_dir)).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
    return BY_BRAND.partition_meta(spark).join(sizes, "partition_id", "left").select("partition_id", "identifier", F.coalesce("n", F.lit(0)).alias("n"))


@query
def partition_name_simple(spark, sf_dir):
    col = {"o_custkey": F.col("o_custkey")}
    return orders(spark, sf_dir).select("o_orderkey", SIMPLE.route(col).alias("partition"))


# Matching


@query
def hash_one_match(spark, sf_dir):
    return BY_KEY.match(BY_KEY.build(orders(spark, sf_dir)), {"o_orderkey": "7"})


@query
def hash_many_match(spark, sf_dir):
    return BY_BRAND.match(BY_BRAND.build(parts(spark, sf_dir)), {"p_brand": "Brand#11"})


@query
def hash_agg_scan(spark, sf_dir):
    return BY_SEGMENT.match(BY_SEGMENT.build(customers(spark, sf_dir)), {"c_mktsegment": "BUILDING"})


@query
def hash_agg_full(spark, sf_dir):
    one = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").agg(F.min("c_custkey")).first()[0]
    return BY_SEGMENT.match(BY_SEGMENT.build(customers(spark, sf_dir)), {"c_mktsegment": "BUILDING", "c_custkey": str(one)})


@query
def hash_agg_full_many(spark, sf_dir):
    return BY_SEGMENT_NATION.match(BY_SEGMENT_NATION.build(customers(spark, sf_dir)), {"c_mktsegment": "BUILDING", "c_nationkey": "7"})


@query
def simple_match(spark, sf_dir):
    return SIMPLE.match(SIMPLE.build(orders(spark, sf_dir)), {"o_custkey": "5"})


@query
def batch_match(spark, sf_dir):
    """All customers that have a balance over 9000, as patterns."""
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").cast("string").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.col("c_name").alias("asked_by"))
    return BY_CUSTOMER.match_many(BY_CUSTOMER.build(orders(spark, sf_dir)), wanted).select("asked_by", "o_custkey", "o_orderkey", "o_orderpriority")


@query
def index_semi_join(spark, sf_dir):
    found = SIMPLE.build(orders(spark, sf_dir))
    return join_base(found, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "left_semi")


@query
def keyset_page(spark, sf_dir):
    """The second page of fifty."""
    entries = BY_KEY.build(orders(spark, sf_dir))
    last = BY_KEY.page(entries, 50).agg(F.max(F.struct("agg_key", "index_key", "value"))).first()[0]
    return BY_KEY.page(entries, 50, last.asDict()).select("index_key", "value")


# Cardinality and folds


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an operation log."""
    kind = (
        F.when(F.col("event_type") == "click", "increment").when(F.col("event_type") == "error", "decrement").when(F.col("event_type") == "view", "add_element")
        .when(F.col("event_type") == "purchase", "del_element").otherwise("enable")
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", kind.alias("op"), F.get_json_object("props", "$.k").alias("k"))


def delta() -> Column:
    return F.when(F.col("op") == "increment", 1).when(F.col("op") == "decrement", -1).otherwise(0)


@query
def lww_register(spark, sf_dir):
    return merge.last_wins(event_ops(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"])


@query
def cardinality_one(spark, sf_dir):
    index = HashIndex("last", "orders", ("o_custkey",), ("o_orderkey",), partition_by=("o_custkey",))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderkey").alias("seq"))
    return index.build(rows, ["seq"]).select("o_custkey", "o_orderkey")


@query
def cardinality_many(spark, sf_dir):
    return BY_SEGMENT_NATION.build(customers(spark, sf_dir)).select("c_mktsegment", "c_nationkey", "c_custkey")


@query
def counter_fold(spark, sf_dir):
    return merge.counter_fold(event_ops(spark, sf_dir), ["user_id"], delta())


@query
def counter_running(spark, sf_dir):
    return merge.counter_running(event_ops(spark, sf_dir), ["user_id"], ["ts", "event_id"], delta()).select("event_id", "user_id", "running")


@query
def counter_set(spark, sf_dir):
    c = crdt.counter(F.col("c_custkey") % 7)
    to = F.col("c_custkey") % 5
    return table(spark, sf_dir, "customer").select("c_custkey", crdt.counter_op(crdt.counter_set(c, to)).alias("increment"), crdt.counter_value(crdt.counter_set(c, to)).alias("value"))


@query
def counter_ops(spark, sf_dir):
    c = crdt.decrement(crdt.increment(crdt.counter(F.col("c_custkey")), 5), 2)
    return table(spark, sf_dir, "customer").select("c_custkey", crdt.counter_value(c).alias("value"), c["value"].alias("original"), crdt.counter_op(c).alias("op"))


@query
def flag_fold(spark, sf_dir):
    ops = event_ops(spark, sf_dir).where(F.col("op").isin("enable", "decrement"))
    last = merge.last_wins(ops, ["user_id"], ["ts", "event_id"], ["op"])
    f = crdt.flag(F.lit(False), F.when(F.col("op") == "enable", "enable").otherwise("disable"))
    return last.select("user_id", crdt.flag_value(f).alias("value"))


@query
def flag_ops(spark, sf_dir):
    ctx = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    f = crdt.flag_set(crdt.flag(F.lit(True)), F.col("c_custkey") % 3 == 0, ctx)
    return table(spark, sf_dir, "customer").select("c_custkey", crdt.flag_value(f).alias("value"), f["value"].alias("original"), f["op"].alias("op"))


@query
def set_fold(spark, sf_dir):
    ops = event_ops(spark, sf_dir).where(F.col("op").isin("add_element", "del_element"))
    return merge.set_fold(ops, ["user_id"], "k", ["ts", "event_id"], "op")


@query
def set_merge_add_wins(spark, sf_dir):
    """A remove has observed what came at least 1000 events before it."""
    ops = event_ops(spark, sf_dir).select("user_id", "k", "op", F.col("event_id").alias("seq"), (F.col("event_id") - 1000).alias("ctx"))
    return merge.set_merge(ops.where("op = 'add_element'"), ops.where("op = 'del_element'"), ["user_id", "k"])


@query
def set_elements_diff(spark, sf_dir):
    views = event_ops(spark, sf_dir).where("op = 'add_element'")
    first, second = views.where(F.dayofmonth("ts") <= 15), views.where(F.dayofmonth("ts") > 15)
    return merge.set_difference(first.select("user_id", "k").distinct(), second.select("user_id", "k").distinct())


def tag_sets() -> tuple[Column, Column]:
    """Two small sets by customer."""
    n = F.col("c_custkey")
    a = crdt.add_elements(crdt.stored_set(F.array(n % 3, n % 5, F.lit(9)), "bigint"), F.array(n % 7))
    b = crdt.stored_set(F.array(n % 4, n % 5), "bigint")
    return a, b


def joined(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


@query
def set_subtract(spark, sf_dir):
    a, b = tag_sets()
    return table(spark, sf_dir, "customer").select("c_custkey", joined(F.array_sort(crdt.subtract(a, b))).alias("rest"), crdt.set_size(a).cast("long").alias("n"))


@query
def set_algebra(spark, sf_dir):
    a, b = tag_sets()
    return table(spark, sf_dir, "customer").select("c_custkey", joined(crdt.union(a, b)).alias("both"), joined(crdt.intersection(a, b)).alias("common"), crdt.is_subset(b, a).alias("subset"))


@query
def set_membership(spark, sf_dir):
    a, _ = tag_sets()
    a = crdt.del_elements(a, F.array(F.col("c_custkey") % 2), F.lit(1))
    e = F.lit(1).cast("bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", crdt.is_element(a, e).alias("effective"), crdt.is_original_element(a, e).alias("original"))


# Changes


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and a later state: of every ten keys one row is gone, one new, one lost its priority, two have a new status."""
    old = orders(spark, sf_dir)
    n = F.col("o_orderkey").cast("long") % 10
    new = old.where(n != 0).select(
        F.when(n == 4, F.concat(F.lit("9"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_custkey",
        F.when(n.isin(2, 3), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(n != 1, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return old, new


@query
def has_changes(spark, sf_dir):
    pairs = changes.pair_snapshots(*snapshots(spark, sf_dir), "o_orderkey").where("op = 'update'")
    return pairs.select("o_orderkey", crdt.has_changes(F.col("new_meta.updated"), F.col("new_meta.removed")).alias("changed"))


@query
def change_status(spark, sf_dir):
    pairs = changes.pair_snapshots(*snapshots(spark, sf_dir), "o_orderkey").where("new is not null")
    status = lambda c: changes.field_status(F.col("new"), F.col("new_meta"), c).alias(c)
    return pairs.select("o_orderkey", status("o_custkey"), status("o_orderstatus"), status("o_orderpriority"))


@query
def changed_key_paths(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    nest = lambda df, name: df.select("o_orderkey", F.struct(F.col("o_custkey"), F.struct("o_orderstatus", "o_orderpriority").alias("state")).alias(name))
    both = nest(old, "old").join(nest(new, "new"), "o_orderkey")
    got = crdt.changed_key_paths(F.col("old"), F.col("new"), both.schema["old"].dataType)
    rows = both.select("o_orderkey", got.alias("c"))
    return rows.select("o_orderkey", F.lit("updated").alias("kind"), F.explode("c.updated").alias("path")).unionAll(rows.select("o_orderkey", F.lit("removed").alias("kind"), F.explode("c.removed").alias("path")))


@query
def op_rows(spark, sf_dir):
    """The operations that lead from one snapshot to the next, removes first."""
    old, new = snapshots(spark, sf_dir)
    kind = T.StructType([f for f in old.schema.fields if f.name != "o_orderkey"])
    fields = kind.names
    both = old.select("o_orderkey", F.struct(*fields).alias("old")).join(new.select("o_orderkey", F.struct(*fields).alias("new")), "o_orderkey")
    values = F.create_map(*[x for f in fields for x in (F.lit(f"/{f}"), F.col(f"new.{f}"))])
    return merge.op_rows(both, "o_orderkey", crdt.changed_key_paths(F.col("old"), F.col("new"), kind), values)


def made_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with every case of the truth table that emits or ignores, by key modulus."""
    n = F.col("o_orderkey") % 7
    doc = F.struct(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    missing = F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.lit(None).cast("string").alias("o_custkey"), F.col("o_orderstatus").alias("o_orderstatus"))
    meta = lambda updated, typed=True: F.struct((F.array(F.lit("o_custkey")) if updated else F.array().cast("array<string>")).alias("updated"), F.array().cast("array<string>").alias("removed"), F.lit(typed).alias("typed"))
    op = F.when(n <= 1, "insert").when(n <= 3, "delete").otherwise("update")
    old = F.when(n == 6, missing).when(n >= 2, doc)
    new = F.when(n.isin(0, 1, 4, 5, 6), doc)
    old_meta = F.when(n == 3, meta(False, False)).otherwise(meta(False))
    new_meta = F.when(n.isin(0, 4, 6), meta(True)).otherwise(meta(False))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), op.alias("op"), old.alias("old"), new.alias("new"), old_meta.alias("old_meta"), new_meta.alias("new_meta"))


@query
def normalise_actions(spark, sf_dir):
    emitted = changes.normalise(made_actions(spark, sf_dir), ["o_orderkey", "o_custkey"])
    return emitted.groupBy((F.col("seq") % 7).alias("rule"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def index_apply_delta(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    actions = changes.pair_snapshots(old, new, "o_orderkey").withColumn("seq", F.col("o_orderkey").cast("long"))
    entries = BY_CUSTOMER.apply(BY_CUSTOMER.build(old), BY_CUSTOMER.delta(actions))
    return entries.select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority")


@query
def index_rebuild(spark, sf_dir):
    _, new = snapshots(spark, sf_dir)
    return BY_CUSTOMER.build(new.dropna()).select("index_key", "value")


@query
def map_update_merge(spark, sf_dir):
    spec = {"id": ("register", "integer"), "info": ("map", {"segment": ("register", "binary"), "name": ("register", "binary")}), "balance": ("register", "float")}
    docs = customer_docs(spark, sf_dir)
    n = F.col("doc.id")
    patch = F.struct(F.struct(F.when(n % 2 == 0, "NEW").alias("segment")).alias("info"), F.when(n % 3 == 0, F.lit(1.5)).alias("balance"))
    patched = docs.withColumn("patch", patch)
    merged = crdt.merge(F.col("doc"), docs.schema["doc"].dataType, spec, F.col("patch"), patched.schema["patch"].dataType)
    gone = crdt.merge(F.col("doc"), docs.schema["doc"].dataType, spec, F.col("patch"), patched.schema["patch"].dataType, removed=("balance",))
    d = patched.select(F.when(n % 5 == 0, gone).otherwise(merged).alias("d"))
    return d.select("d.id", "d.info.segment", "d.info.name", "d.balance")


@query
def patch_fold(spark, sf_dir):
    """Four ordered actions on each customer's document."""
    n = F.col("c_custkey")
    doc = F.struct(F.col("c_name").alias("name"), (n % 2 == 0).alias("active"), n.alias("visits"), F.array(F.lit("a")).alias("tags"))
    op = lambda seq, path, action, value: F.struct(F.lit(seq).alias("seq"), F.lit(path).alias("path"), F.lit(action).alias("action"), F.lit(value).cast("string").alias("value"))
    ops = F.array(op(3, "/visits", "increment", None), op(1, "/tags", "add_element", "b"), op(2, "/visits", "set", "10"), op(4, "/tags", "del_element", "a"), op(5, "/active", "enable", None), op(6, "/name", "remove", None))
    docs = table(spark, sf_dir, "customer").select(n, doc.alias("doc"))
    d = docs.select("c_custkey", crdt.patch_fold(F.col("doc"), docs.schema["doc"].dataType, ops).alias("d"))
    return d.select("c_custkey", "d.name", "d.active", "d.visits", F.array_join("d.tags", ",").alias("tags"))


@query
def document_edits(spark, sf_dir):
    """A chain of recorded edits on each customer's document."""
    n = F.col("c_custkey")
    doc = F.struct(F.col("c_name").alias("name"), n.alias("visits"), F.array(F.lit("b")).alias("tags"), F.struct(F.lit(False).alias("seen"), F.col("c_mktsegment").alias("segment")).alias("info"))
    docs = table(spark, sf_dir, "customer").select(n, doc.alias("doc"))
    d = Document.of(docs, "doc", ctx=n)
    d = d.set("name", F.when(n % 2 == 0, F.col("doc.name")).otherwise("other")).increment("visits", 5).add_elements("tags", F.array(F.lit("a")))
    d = d.enable(["info", "seen"]).del_elements("tags", F.array(F.lit("b"))).remove(["info", "segment"]).set("visits", lambda v: v * 2)
    paths_ = d.changed_key_paths()
    return docs.select(
        "c_custkey", d.get("name").alias("name"), d.get("visits").alias("visits"), F.array_join(d.get("tags"), ",").alias("tags"), d.get(["info", "seen"]).alias("seen"),
        F.array_join(paths_["updated"], " ").alias("updated"), F.array_join(paths_["removed"], " ").alias("removed"), d.status(["info", "segment"]).alias("status"), d.has_changes().alias("changed"),
    )


# Catalog and rings


@query
def ring_index(spark, sf_dir):
    """The events of a user in one slot of a ring of sixteen days."""
    ring = RingIndex("by_day", "events", ("user_id",), ("event_id", "event_type"), timestamp_field="ts", slots=16)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type", "ts")
    one = table(spark, sf_dir, "events").where("event_id = 0").select("user_id", ring.slot(F.col("ts")).alias("slot")).first()
    return ring.match(ring.build(rows), {"user_id": str(one["user_id"]), "slot": str(one["slot"])})


@query
def keyset_page_desc(spark, sf_dir):
    return BY_BRAND.page(BY_BRAND.build(parts(spark, sf_dir)), 20, descending=True).select("index_key", "value")


@query
def catalog_indices(spark, sf_dir):
    collection = catalog.Collection("orders", "orders")
    for i in (BY_CUSTOMER, SIMPLE, BY_KEY):
        collection = collection.add_index(i)
    return collection.frame(spark).select("collection", "index_name", "index_type", F.get_json_object("config", "$.bucket_prefix").alias("bucket_prefix"))


@query
def ring_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", keys.ring_day(F.col("ts"), 12).alias("slot"))


@query
def ring_week(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", keys.ring_week(F.col("ts"), 3, datetime.datetime(2024, 1, 29)).alias("slot"))


from docindex import stored_queries  # noqa: E402, F401  (registers its queries)
