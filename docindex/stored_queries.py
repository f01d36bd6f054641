"""Registered queries over stored documents and stored indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.functions import keys
from docindex.operators import changes, crdt, paths, typespec
from docindex.operators.documents import Document, entry
from docindex.plans.catalog import Collection, Manager
from docindex.plans.index import HashIndex, RingIndex, from_json
from docindex.queries import BY_BRAND, BY_CUSTOMER, BY_KEY, BY_SEGMENT_NATION, SIMPLE, customer_docs, customers, joined, orders, parts, query, snapshots, table, tag_sets
from docindex.sources.store import Cache, NotFound, Options, execute, get_connection, scratch_store
from docindex.streaming import maintain


def stored_orders(spark: SparkSession, sf_dir: str):
    store = scratch_store(spark)
    store.put("docs", "orders", orders(spark, sf_dir), "o_orderkey")
    return store


def managed(spark: SparkSession, base: DataFrame, *indices) -> tuple[Manager, Collection]:
    """A manager whose store has the indices of `base`."""
    manager, collection = Manager(scratch_store(spark)), Collection("docs", "docs")
    with manager.workflow():
        for index in indices:
            collection = manager.create_index(index, collection, base)
    return manager, collection


def order_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first snapshot, and the actions that lead to the second."""
    old, new = snapshots(spark, sf_dir)
    return old, changes.pair_snapshots(old, new, "o_orderkey").withColumn("seq", F.col("o_orderkey").cast("long"))


# Documents


@query
def store_get(spark, sf_dir):
    return stored_orders(spark, sf_dir).get("docs", "orders", "7", "o_orderkey")


@query
def store_put(spark, sf_dir):
    """Two updates of a fifth of the keys in one request; the later one is stored."""
    store = stored_orders(spark, sf_dir)
    some = orders(spark, sf_dir).where((F.col("o_orderkey") % 5) == 2)
    both = some.withColumns({"o_orderstatus": F.lit("X"), "at": F.lit(1)}).unionByName(some.withColumns({"o_orderstatus": F.lit("Y"), "at": F.lit(2)}))
    store.put("docs", "orders", both, "o_orderkey", order=["at"])
    return store.documents("docs", "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.coalesce("at", F.lit(0)).alias("at"))


@query
def store_put_return_body(spark, sf_dir):
    store = stored_orders(spark, sf_dir)
    some = orders(spark, sf_dir).where((F.col("o_orderkey") % 50) == 0).withColumn("o_orderstatus", F.lit("Z"))
    return store.put("docs", "orders", some, "o_orderkey", return_body=True, timeout=1000)


@query
def store_delete(spark, sf_dir):
    store = stored_orders(spark, sf_dir)
    store.delete("docs", "orders", orders(spark, sf_dir).where((F.col("o_orderkey") % 3) == 0), "o_orderkey")
    return store.documents("docs", "orders")


@query
def execute_fun(spark, sf_dir):
    return execute(lambda s: table(s, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), spark, telemetry_name="statuses")


@query
def connection(spark, sf_dir):
    return table(get_connection(spark), sf_dir, "nation").select("n_nationkey", "n_name")


@query
def request_options(spark, sf_dir):
    """What is left of options that a request doesn't take, for each customer segment's timeout."""
    made = Options.validated("put", {"timeout": 500, "r": "quorum", "unknown": 1}, "relaxed").request()
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct().select("c_mktsegment", F.explode(F.create_map(*[F.lit(str(x)) for kv in sorted(made.items()) for x in kv])).alias("option", "value"))


# Collections and workflows


@query
def collection_io(spark, sf_dir):
    """A stored collection, fetched, changed and stored again, with the size of each index's data."""
    manager, collection = managed(spark, orders(spark, sf_dir), BY_CUSTOMER, SIMPLE, BY_KEY)
    manager.save(manager.fetch("docs", "docs").delete_index(BY_KEY.name))
    found = manager.fetch("docs", "docs")
    sizes = [manager.entries(i).agg(F.lit(i.name).alias("index_name"), F.count(F.lit(1)).alias("n")) for i in found.indices()]
    rows = sizes[0].unionAll(sizes[1])
    return found.frame(spark).join(rows, "index_name").select("collection", "index_name", "index_type", "n")


@query
def collection_guards(spark, sf_dir):
    """Which indices a collection has, and that one to be deleted takes no more changes."""
    manager, collection = managed(spark, customers(spark, sf_dir), BY_SEGMENT_NATION)
    refused = False
    with manager.workflow():
        manager.delete(collection)
        try:
            manager.drop_index(BY_SEGMENT_NATION.name, collection)
        except KeyError:
            refused = True
    gone = manager.lookup("docs", "docs") is None
    names = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 0, BY_SEGMENT_NATION.name).otherwise(F.col("n_name")).alias("name"))
    return names.select("name", F.col("name").isin(collection.index_names()).alias("is_index"), F.lit(refused).alias("refused"), F.lit(gone).alias("gone"))


@query
def workflow_steps(spark, sf_dir):
    """The order in which work runs: data before the catalog to create, the catalog before data to drop."""
    old, actions = order_actions(spark, sf_dir)
    manager, collection = managed(spark, old, BY_CUSTOMER)
    with manager.workflow():
        both = manager.create_index(SIMPLE, collection, old)
        manager.update_indices(actions, [BY_CUSTOMER.name], both)
        manager.drop_index(BY_CUSTOMER.name, both)
        steps = manager.steps()
    return spark.createDataFrame(list(enumerate(steps)), "pos long, step string").withColumn("n", F.lit(manager.entries(SIMPLE).count()))


@query
def workflow_status(spark, sf_dir):
    """Work in the background: its status, and what it built."""
    manager = Manager(scratch_store(spark))
    work = manager.submit(lambda m: m.create_index(BY_BRAND, Collection("docs", "docs"), parts(spark, sf_dir)))
    work.wait(600)
    failed = manager.submit(lambda m: m.drop_index("none", work.wait()))
    try:
        failed.wait(600)
    except KeyError:
        pass
    return manager.entries(BY_BRAND).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumns({"built": F.lit(work.status()), "other": F.lit(failed.status())})


# Stored indices


@query
def stored_hash_match(spark, sf_dir):
    manager, _ = managed(spark, parts(spark, sf_dir), BY_BRAND)
    return manager.match(BY_BRAND, {"p_brand": "Brand#11"})


@query
def stored_simple_match(spark, sf_dir):
    manager, _ = managed(spark, orders(spark, sf_dir), SIMPLE)
    return manager.match(SIMPLE, {"o_custkey": "5"})


@query
def match_order(spark, sf_dir):
    """The positions of a match's rows: values come in descending order."""
    manager, _ = managed(spark, parts(spark, sf_dir), BY_BRAND)
    rows = manager.match(BY_BRAND, {"p_brand": "Brand#23"}).collect()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, p_partkey string, p_type string")


@query
def stored_hash_update(spark, sf_dir):
    old, actions = order_actions(spark, sf_dir)
    manager, collection = managed(spark, old, BY_CUSTOMER)
    manager.update_indices(actions, [BY_CUSTOMER.name], collection)
    return manager.entries(BY_CUSTOMER).select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority")


@query
def stored_simple_update(spark, sf_dir):
    old, actions = order_actions(spark, sf_dir)
    manager, collection = managed(spark, old, SIMPLE)
    manager.update_all_indices(actions, collection)
    return manager.entries(SIMPLE).select("partition_id", "o_custkey", "o_orderkey")


@query
def stored_rebuild(spark, sf_dir):
    """Rows that lack a key are counted and left out."""
    old, new = snapshots(spark, sf_dir)
    manager, collection = managed(spark, old, BY_CUSTOMER)
    counts = manager.rebuild_index(BY_CUSTOMER.name, collection, new)
    return manager.entries(BY_CUSTOMER).select("index_key", "value").withColumns({k: F.lit(v).cast("bigint") for k, v in counts.items()})


@query
def stored_drop(spark, sf_dir):
    """What is left of two indices after one was dropped."""
    manager, collection = managed(spark, orders(spark, sf_dir), BY_CUSTOMER, SIMPLE)
    manager.drop_indices([BY_CUSTOMER.name], collection)
    has = {}
    for index in (BY_CUSTOMER, SIMPLE):
        try:
            has[index.name] = manager.entries(index).count()
        except NotFound:
            has[index.name] = -1
    kept = manager.fetch("docs", "docs")
    return spark.createDataFrame([(n, kept.is_index(n), k) for n, k in has.items()], "index_name string, listed boolean, n long")


@query
def partition_fetch(spark, sf_dir):
    """All entries of the partition that a brand is in."""
    manager, _ = managed(spark, parts(spark, sf_dir), BY_BRAND)
    return manager.partition(BY_BRAND, f"{BY_BRAND.identifier_prefix}_{BY_BRAND.route_values({'p_brand': 'Brand#11'})}").select("partition_id", "index_key", "value")


@query
def partition_drop(spark, sf_dir):
    manager, _ = managed(spark, parts(spark, sf_dir), BY_BRAND)
    manager.drop_partition(BY_BRAND, f"{BY_BRAND.identifier_prefix}_{BY_BRAND.route_values({'p_brand': 'Brand#11'})}")
    return manager.entries(BY_BRAND).select("partition_id", "index_key", "value")


@query
def partition_cache(spark, sf_dir):
    """A partition from the cache, before and after it changed."""
    manager, collection = Manager(scratch_store(spark, cache=Cache(entries=4))), Collection("docs", "docs")
    collection = manager.create_index(BY_BRAND, collection, parts(spark, sf_dir))
    name = f"{BY_BRAND.identifier_prefix}_{BY_BRAND.route_values({'p_brand': 'Brand#11'})}"
    first = manager.partition(BY_BRAND, name)
    same = manager.partition(BY_BRAND, name) is first
    manager.rebuild_index(BY_BRAND.name, collection, parts(spark, sf_dir).where(F.col("p_partkey").cast("long") % 2 == 0))
    return manager.partition(BY_BRAND, name).select("index_key", "value").withColumn("held", F.lit(same))


@query
def partition_times(spark, sf_dir):
    """Every partition with its number of entries; empty ones were never written."""
    manager, _ = managed(spark, parts(spark, sf_dir), BY_BRAND)
    return manager.partition_meta(BY_BRAND).select("partition_id", "identifier", "n", (F.col("created_ts") <= F.col("last_updated_ts")).alias("ordered"))


@query
def index_config(spark, sf_dir):
    """The definition of an index read back from its stored form, applied to the table."""
    index = from_json(BY_SEGMENT_NATION.to_json())
    rows = index.build(customers(spark, sf_dir)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("c_mktsegment", "n", F.lit(index.bucket).alias("bucket"), F.lit(index.type).alias("type"), F.lit(",".join(index.distinguished)).alias("distinguished"), F.lit(index.cardinality).alias("cardinality"))


@query
def index_fold(spark, sf_dir):
    manager, _ = managed(spark, orders(spark, sf_dir), BY_KEY)
    return BY_KEY.fold(manager.entries(BY_KEY), n=F.count(F.lit(1)), first=F.min("index_key"), last=F.max("index_key"))


@query
def index_cursor(spark, sf_dir):
    """The first sixty entries, in pages of twenty-five."""
    manager, _ = managed(spark, orders(spark, sf_dir), BY_KEY)
    cursor, seen = BY_KEY.cursor(manager.entries(BY_KEY), 25), []
    while not cursor.done and len(seen) < 60:
        seen.append((len(seen), cursor.key[1], cursor.values["o_custkey"]))
        cursor.move()
    return spark.createDataFrame(seen, "pos long, o_orderkey string, o_custkey string")


@query
def actions_by_partition(spark, sf_dir):
    """The size of each partition's group of a batch."""
    _, actions = order_actions(spark, sf_dir)
    index = HashIndex("by_status", "orders", ("o_orderstatus", "o_orderkey"), partition_by=("o_orderstatus",), aggregate_by=("o_orderstatus",), partitions=16)
    return index.by_partition(index.delta(actions)).groupBy("partition_id", "kind").agg(F.count(F.lit(1)).alias("n"))


RING = RingIndex("by_day", "events", ("user_id",), ("event_id", "event_type"), timestamp_field="ts", slots=16)


def ring_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type", "ts")


@query
def ring_update(spark, sf_dir):
    """A ring in the store after errors were deleted."""
    rows = ring_rows(spark, sf_dir)
    manager, collection = managed(spark, rows, RING)
    meta = F.struct(F.array().cast("array<string>").alias("updated"), F.array().cast("array<string>").alias("removed"), F.lit(True).alias("typed"))
    doc = F.struct(*rows.columns)
    gone = rows.where("event_type = 'error'").select(F.col("event_id").cast("long").alias("seq"), F.lit("delete").alias("op"), doc.alias("old"), F.lit(None).cast(rows.select(doc.alias("d")).schema["d"].dataType).alias("new"), meta.alias("old_meta"), meta.alias("new_meta"))
    manager.update_all_indices(gone, collection)
    return manager.entries(RING).select("partition_id", "user_id", "event_id", "event_type")


@query
def ring_match_many(spark, sf_dir):
    """Slot three of the ring for each customer who is a user."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.lit("3").alias("slot"), F.col("c_name").alias("asked_by"))
    return RING.match_many(RING.build(ring_rows(spark, sf_dir)), wanted).select("asked_by", "event_id", "event_type")


# Typed documents


@query
def patch_nested(spark, sf_dir):
    """Ordered actions on nested documents with a wildcard map; what they changed comes with them."""
    n = F.col("c_custkey")
    kind = T._parse_datatype_string("name string, visits bigint, active boolean, tags array<string>, at struct<nation:bigint,segment:string>, services map<string,struct<note:string,on:boolean>>")
    doc = F.struct(F.col("c_name").alias("name"), n.alias("visits"), (n % 2 == 0).alias("active"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.struct(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("at"), F.create_map(F.lit("s1"), F.struct(F.lit("x").alias("note"), F.lit(False).alias("on"))).alias("services"))
    op = lambda seq, path, action, value=None: F.struct(F.lit(seq).alias("seq"), F.lit(path).alias("path"), F.lit(action).alias("action"), F.lit(value).cast("string").alias("value"))
    ops = F.array(op(1, "/at/segment", "update", "NEW"), op(3, "/visits", "increment"), op(2, "/visits", "set", "10"), op(4, "/tags", "add_element", "c"), op(5, "/tags", "del_element", "a"), op(6, "/active", "disable"), op(7, "/services/s1/on", "enable"), op(8, "/services/s2/note", "set", "y"), op(9, "/at/nation", "remove"))
    d = table(spark, sf_dir, "customer").select(n, crdt.patch(doc, kind, ops).alias("d"))
    at = F.col("d.doc")
    return d.select(
        "c_custkey", at["name"].alias("name"), at["visits"].alias("visits"), at["active"].alias("active"), F.array_join(at["tags"], ",").alias("tags"), at["at"]["segment"].alias("segment"), at["at"]["nation"].alias("nation"),
        at["services"]["s1"]["on"].alias("s1_on"), at["services"]["s2"]["note"].alias("s2_note"), F.array_join("d.updated", " ").alias("updated"), F.array_join("d.removed", " ").alias("removed"),
    )


CUSTOMER = {"id": ("register", "integer"), "info": ("map", {"segment": ("register", "binary"), "name": ("register", "binary")}), "balance": ("register", "float")}


@query
def typed_new(spark, sf_dir):
    """New documents of a specification: all that they have counts as updated."""
    docs = customer_docs(spark, sf_dir)
    made = typespec.new_map(F.col("doc"), docs.schema["doc"].dataType, CUSTOMER, ctx=F.col("doc.id"))
    return docs.select(made.alias("m")).select("m.doc.id", "m.doc.info.name", "m.ctx", F.array_join("m.updated", " ").alias("updated"), F.size("m.removed").cast("long").alias("removed"))


@query
def inferred_new(spark, sf_dir):
    """A plain value's inferred document beside each region."""
    made = typespec.new_inferred({"hits": 3, "on": True, "tags": ["b", "a", "b"], "at": {"name": "x", "none": None}})
    return table(spark, sf_dir, "region").select("r_regionkey", made.alias("m")).select("r_regionkey", "m.doc.hits", "m.doc.on", F.array_join("m.doc.tags", ",").alias("tags"), "m.doc.at.name", F.array_join("m.updated", " ").alias("updated"))


@query
def document_update(spark, sf_dir):
    """Bulk edits with a nested removal, recorded."""
    docs = customer_docs(spark, sf_dir)
    d = Document.of(docs, "doc", ctx=F.col("doc.id")).update({"balance": F.lit(1.5), "info": {"segment": F.lit("NEW"), "name": None}})
    d = d.with_context(F.col("doc.id") + 1)
    changed = d.changed_key_paths()
    return docs.select(d.at("id").alias("id"), d.at(["info", "segment"]).alias("segment"), d.at(["info", "name"]).alias("name"), d.at("balance").alias("balance"), d.ctx.alias("ctx"), F.array_join(changed["updated"], " ").alias("updated"), F.array_join(changed["removed"], " ").alias("removed"))


@query
def document_sets(spark, sf_dir):
    n = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(n, F.struct(F.array((n % 3), (n % 5)).alias("tags")).alias("doc"))
    d = Document.of(docs, "doc", ctx=n).set_elements("tags", F.array(n % 2, n % 4, n % 2))
    return docs.select("c_custkey", joined(d.at("tags")).alias("tags"), d.status("tags").alias("status"))


@query
def map_value(spark, sf_dir):
    return customer_docs(spark, sf_dir).select(F.col("doc.id").alias("id"), F.get_json_object(paths.value(F.col("doc")), "$.info.segment").alias("segment"), entry("register", "id", "v")["type"].alias("entry"))


@query
def spec_types(spark, sf_dir):
    """The datatype of each path of a registered specification, wildcards expanded by the names of regions."""
    ref = typespec.register({"id": ("register", "integer"), "by_region": ("map", {"_": ("map", {"n": ("counter", "integer"), "on": ("flag", "boolean")})}), "tags": ("set", "binary")})
    spec = typespec.registered(ref)
    regions = [r[0] for r in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]  # five
    found = [("id",), ("tags",), *[("by_region", r, f) for r in typespec.expand(spec["by_region"][1], regions) for f in ("n", "on")]]
    typespec.unregister(ref)
    return spark.createDataFrame([("/" + "/".join(p), typespec.path_type(spec, list(p))[0], typespec.data_type(typespec.path_type(spec, list(p))).simpleString()) for p in found], "path string, datatype string, type string")


@query
def type_predicates(spark, sf_dir):
    """Which datatype each column of a document is."""
    kind = customer_docs(spark, sf_dir).schema["doc"].dataType
    rows = [(f.name, typespec.datatype_of(f.dataType), typespec.is_type(f.dataType, "counter")) for f in kind.fields]
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.lit(b).alias("datatype"), F.lit(c).alias("counter")) for a, b, c in rows])).alias("e")).select("r_regionkey", "e.*")


@query
def set_ops(spark, sf_dir):
    """The operations of changed sets, and a fold of their elements."""
    a, _ = tag_sets()
    changed = crdt.set_elements(a, F.array(F.col("c_custkey") % 3, F.lit(8).cast("bigint")))
    ops = crdt.set_ops(changed)
    total = crdt.set_fold(changed, F.lit(0).cast("bigint"), lambda x, e: x * 10 + e)
    return table(spark, sf_dir, "customer").select("c_custkey", joined(ops["add_all"]).alias("adds"), joined(ops["remove_all"]).alias("removes"), total.alias("folded"))


@query
def names_and_paths(spark, sf_dir):
    """Bucket names, key names and patch paths beside each region's name."""
    name = F.col("r_name")
    return table(spark, sf_dir, "region").select(
        "r_regionkey", F.lit(keys.data_bucket("docs")).alias("data"), F.lit(keys.collection_bucket("docs")).alias("collection"), F.lit(keys.to_key(("id", "integer"))).alias("key"),
        F.lit("|".join(keys.parse_patch_path("/a/b//"))).alias("path"), keys.identifier("p", name).alias("identifier"),
    )


# Streams


@query
def stream_maintain(spark, sf_dir):
    """A stored index kept by a stream of actions."""
    old, actions = order_actions(spark, sf_dir)
    manager, collection = managed(spark, old, BY_CUSTOMER)
    at = f"{manager.store.root}/stream"
    actions.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(actions.schema).parquet(f"{at}/in")
    maintain.maintain(stream, manager, collection, f"{at}/checkpoint").awaitTermination()
    return manager.entries(BY_CUSTOMER).select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority")


@query
def stream_counters(spark, sf_dir):
    """Running counts by a stream over the events."""
    root = scratch_store(spark).root
    rows = table(spark, sf_dir, "events").select("event_type", F.length("event_type").alias("n"))
    rows.write.parquet(f"{root}/in")
    counted = maintain.counters(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), ["event_type"], F.col("n"))
    name = "counted_" + root[-32:]
    counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
