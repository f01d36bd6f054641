import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.functions import codec, keys
from docindex.operators import changes, crdt, merge, paths, typespec
from docindex.operators.documents import Document, entry
from docindex.plans.catalog import AlreadyExists, BadIndex, Collection, Manager
from docindex.plans.index import BadPattern, HashIndex, MissingPatternKey, RingIndex, SimpleIndex, from_json
from docindex.sources.store import Cache, Config, Conflict, DatatypeMismatch, NotFound, Options, Store, execute
from docindex.streaming import maintain


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_jump_hash_is_consistent(spark):
    rng = random.Random(1)
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.getrandbits(63) for _ in range(200))]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    for buckets in (1, 2, 7, 8, 128, 1000):
        got = {r[0]: r[1] for r in frame.select("n", keys.jump_bucket(F.col("n"), buckets)).collect()}
        assert got == {n: keys.jump_bucket_value(n, buckets) for n in numbers}
    for n in numbers:  # a bucket more moves keys to the new bucket only
        for buckets in range(1, 20):
            a, b = keys.jump_bucket_value(n, buckets), keys.jump_bucket_value(n, buckets + 1)
            assert b in (a, buckets)
    # Published properties of the function, and a fixed point of the algorithm.
    assert [keys.jump_bucket_value(k, 1) for k in range(5)] == [0] * 5


def test_keys(spark):
    r = one(spark, keys.gen_key([F.lit("A"), F.lit("É")]).alias("a"), keys.gen_key([F.lit("A"), F.lit("b")], True).alias("b"), keys.gen_key([F.lit("a"), F.lit(None).cast("string")], strict=False).alias("c"))
    assert (r.a, r.b, r.c) == ("a\x19é", "A\x19b", None)
    with pytest.raises(Exception, match="badkey"):
        one(spark, keys.gen_key([F.lit(None).cast("string")]))
    assert keys.parse_patch_path("/a/b//") == ["a", "b"]
    with pytest.raises(ValueError):
        keys.parse_patch_path("a")
    assert keys.to_key(("a", "t")) == "a"
    with pytest.raises(KeyError):
        keys.to_key(1)
    assert keys.data_bucket("x") == "x-index_data" and keys.collection_bucket("x") == "x-index_collection"
    week = spark.sql("SELECT timestamp'2024-01-29 10:00' a, timestamp'2023-12-01 10:00' b").select(*[keys.ring_week(F.col(c), 3, datetime.datetime(2024, 1, 30)).alias(c) for c in "ab"]).first()
    assert (week.a, week.b) == (5 % 3, None)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [("", "binary", ""), ("", "integer", None), ("12", "integer", 12), ("1.5", "float", 1.5), ("1", "float", "error"), ("true", "boolean", True), ("True", "boolean", "error"), ("x", "integer", "error"), ("a", "atom", "a"), ("ab", "list", "ab")],
)
def test_decode(spark, text, kind, value):
    if value == "error":
        assert one(spark, codec.decode(F.lit(text), kind, strict=False).alias("v")).v is None
        with pytest.raises(Exception, match="badarg"):
            one(spark, codec.decode(F.lit(text), kind))
    else:
        assert one(spark, codec.decode(F.lit(text), kind).alias("v")).v == value


def test_codecs(spark):
    custom = (F.upper, F.lower)
    r = one(spark, codec.encode(F.lit(True), "boolean").alias("a"), codec.encode(F.lit(None).cast("long"), "integer").alias("b"), codec.decode(F.lit("AB"), custom).alias("c"), codec.from_base(F.lit("zz"), 36).alias("d"), codec.decode(F.lit("x"), "existing_atom", domain=["x"]).alias("e"))
    assert tuple(r) == ("true", "", "ab", 35 * 37, "x")
    with pytest.raises(ValueError, match="badtype"):
        codec.decode(F.lit("a"), "pid")


def test_specs():
    with pytest.raises(typespec.InvalidSpec) as e:
        typespec.validate({"a": ("set", "pid"), "b": ("counter", "float"), "c": "x", "_": ("flag", "boolean")})
    assert len(e.value.errors) == 4
    spec = {"a": ("register", "integer"), "m": ("map", {"_": ("set", "binary")})}
    ref = typespec.register(spec)
    assert typespec.registered(ref) == spec and ref == typespec.spec_ref(dict(reversed(spec.items())))
    typespec.unregister(ref)
    with pytest.raises(KeyError):
        typespec.registered(ref)
    assert typespec.path_type(spec, ["m", "x"]) == ("set", "binary")
    assert typespec.schema(spec).simpleString() == "struct<a:bigint,m:map<string,array<string>>>"
    assert typespec.expand({"_": ("flag", "boolean")}, ["x", "y"]) == {"x": ("flag", "boolean"), "y": ("flag", "boolean")}
    assert typespec.inferred({"a": 1, "b": [1], "c": True, "d": "x", "e": None, "f": {"g": 1.5}}) == (
        "map", {"a": ("counter", "integer"), "b": ("set", "integer"), "c": ("flag", "boolean"), "d": ("register", "binary"), "f": ("map", {"g": ("register", "float")})},
    )


def test_check_fields(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    with pytest.raises(KeyError, match="missing_spec"):
        typespec.check_fields(df, {"a": ("counter", "integer")})
    assert typespec.check_fields(df, {"a": ("counter", "integer")}, "ignore").columns == ["a"]
    with pytest.raises(TypeError, match="datatype_mismatch"):
        typespec.check_fields(df, {"a": ("register", "binary"), "b": ("register", "binary")})


def test_paths(spark):
    doc = F.struct(F.lit(1).alias("a"), F.create_map(F.lit("k"), F.lit(2)).alias("m"))
    df = spark.range(1).select(doc.alias("d"))
    kind = df.schema["d"].dataType
    r = df.select(
        paths.get(F.col("d"), ["m", "k"]).alias("x"),
        paths.get(F.col("d"), ["m", "z"], 9).alias("y"),
        paths.put(F.col("d"), kind, ["m", "z"], F.lit(5)).alias("p"),
        paths.put(F.col("d"), kind, ["n", "o"], F.lit(7)).alias("q"),
        paths.keys(F.col("d"), kind).alias("k"),
        paths.collect(F.col("d"), ["a", ["m", "q"]], on_badkey="skip").alias("c"),
    ).first()
    assert (r.x, r.y, r.k, r.c) == (2, 9, ["a", "m"], [1])
    assert r.p.m == {"k": 2, "z": 5} and r.q.n.o == 7 and r.q.a == 1
    with pytest.raises(Exception, match="badkey"):
        df.select(paths.get(F.col("d"), ["m", "z"])).collect()
    with pytest.raises(ValueError, match="badarg"):
        paths.get(F.col("d"), [])


def test_counter(spark):
    c = crdt.counter(F.lit(10))
    up = crdt.increment(crdt.increment(c), 5)
    r = one(spark, crdt.counter_value(up).alias("a"), crdt.counter_op(c).alias("b"), crdt.counter_op(crdt.counter_set(c, F.lit(7).cast("long"))).alias("c"), crdt.counter_op(crdt.counter_set(c, F.lit(10).cast("long"))).alias("d"), crdt.counter_value(crdt.decrement(up, 20)).alias("e"))
    assert tuple(r) == (16, None, -3, None, -4)


def test_flag(spark):
    f = crdt.flag(F.lit(True))
    none, seen = F.lit(None).cast("long"), F.lit(1).cast("long")
    r = one(spark, crdt.flag_value(crdt.disable(f, seen)).alias("a"), crdt.disable(f, none).alias("b"), crdt.flag_value(crdt.enable(f)).alias("c"), crdt.new_flag(False)["op"].alias("d"), crdt.flag_value(crdt.flag()).alias("e"))
    assert r.a is False and r.b.value is False and r.b.op == "disable" and r.c is True and r.d == "disable" and r.e is False


def test_set(spark):
    s = crdt.stored_set(F.array(F.lit("b"), F.lit("a"), F.lit("a")))
    added = crdt.add_elements(s, F.array(F.lit("c")))
    gone = crdt.del_elements(added, F.array(F.lit("a")), F.lit(1))
    back = crdt.add_elements(gone, F.array(F.lit("a")))
    to = crdt.set_elements(s, F.array(F.lit("b"), F.lit("z")))
    r = one(spark, crdt.set_value(gone).alias("a"), crdt.set_size(added).alias("b"), crdt.set_value(back).alias("c"), crdt.set_ops(to).alias("d"), crdt.set_ops(s).alias("e"), crdt.is_element(gone, F.lit("a")).alias("f"), crdt.is_original_element(gone, F.lit("a")).alias("g"))
    assert (r.a, r.b, r.c) == (["b", "c"], 3, ["b", "c"])
    assert (r.d.remove_all, r.d.add_all, r.e, r.f, r.g) == (["a"], ["z"], None, False, True)
    with pytest.raises(Exception, match="context_required"):
        one(spark, crdt.set_value(crdt.del_elements(s, F.array(F.lit("a")), F.lit(None).cast("int"))))


def test_merge_of_wildcards(spark):
    spec = {"_": ("map", {"_": ("counter", "integer")})}
    m = T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))
    df = spark.createDataFrame([({"a": {"x": 1, "y": 2}, "b": {"z": 3}}, {"a": {"y": 5}, "c": {"q": 1}})], T.StructType([T.StructField("d", m), T.StructField("p", m)]))
    got = df.select(crdt.merge(F.col("d"), m, spec, F.col("p"), m).alias("v")).first().v
    assert got == {"a": {"x": 1, "y": 5}, "b": {"z": 3}, "c": {"q": 1}}


def test_patch_rejects_unknown(spark):
    kind = T.StructType().add("a", "long")
    ops = F.array(F.struct(F.lit(1).alias("seq"), F.lit("/a").alias("path"), F.lit("explode").alias("action"), F.lit("1").alias("value")))
    with pytest.raises(Exception, match="badaction"):
        one(spark, crdt.patch_fold(F.struct(F.lit(1).cast("long").alias("a")), kind, ops))


def test_document_edits(spark):
    df = spark.range(1).select(F.struct(F.lit("x").alias("a"), F.create_map(F.lit("k"), F.lit(1)).alias("m"), F.array().cast("array<string>").alias("s")).alias("d"))
    d = Document.of(df, "d", ctx=F.lit(1))
    with pytest.raises(KeyError, match="missing_spec"):
        d.set("zz", F.lit(1))
    same = d.set("a", F.lit("x"))
    put = d.set(["m", "q"], F.lit(2)).set("a", None).add_elements("s", F.array(F.lit("e"), F.lit("e")))
    r = df.select(same.has_changes().alias("same"), put.doc.alias("doc"), put.changed_key_paths().alias("p"), put.status("a").alias("st"), put.status("s").alias("su"), d.status("a").alias("no")).first()
    assert not r.same and r.doc.m == {"k": 1, "q": 2} and r.doc.a is None and r.doc.s == ["e"]
    assert (r.p.updated, r.p.removed, r.st, r.su, r.no) == (["/m/q", "/s"], ["/a"], "removed", "updated", "none")
    with pytest.raises(Exception, match="context_required"):
        df.select(Document.of(df, "d").remove("a").doc).collect()
    fresh = Document.of(df, "d").set("a", F.lit("y")).remove("a")
    assert df.select(fresh.doc.alias("doc")).first().doc.a is None
    with pytest.raises(Exception, match="badkey"):
        df.select(d.get(["m", "none"])).collect()
    assert tuple(one(spark, entry("register", "a", "v").alias("e")).e) == ("register", "a", "v")


def test_ring_index(spark):
    rows = spark.sql("SELECT 'u' u, 'e' || id e, timestamp'2024-01-01' + make_dt_interval(cast(id as int)) ts FROM range(40)")
    ring = RingIndex("r", "b", ("u",), ("e",), timestamp_field="ts", slots=16)
    day = datetime.date(2024, 1, 3).toordinal() - datetime.date(1970, 1, 1).toordinal()
    got = {r.e for r in ring.match(ring.build(rows), {"u": "U", "slot": str(day % 16)}).collect()}
    assert got == {"e2", "e18", "e34"} and from_json(ring.to_json()) == ring
    week = RingIndex("r", "b", ("u",), ("e",), timestamp_field="ts", slots=2, unit="week", now="2024-02-05")
    assert week.build(rows).count() == 14  # the fourteen days up to now
    with pytest.raises(ValueError):
        RingIndex("r", "b", ("u",), timestamp_field="ts", slots=12)


def test_concurrent_adds_win(spark):
    adds = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "a", 5)], "k string, e string, seq long")
    removes = spark.createDataFrame([("s", "a", 3), ("s", "b", 3)], "k string, e string, ctx long")
    assert [tuple(r) for r in merge.set_merge(adds, removes, ["k", "e"]).collect()] == [("s", "a")]


@pytest.mark.parametrize(
    ("v", "u", "r", "has", "status"),
    [(1, 0, 0, 0, "none"), (1, 1, 0, 0, "updated"), (1, 0, 1, 1, "updated"), (1, 1, 1, 1, "updated"), (0, 0, 1, 1, "removed"), (0, 1, 1, 1, "removed"), (0, 1, 0, 1, "updated"), (0, 0, 0, 1, "d"), (0, 1, 0, 0, "d"), (0, 0, 0, 0, "d")],
)
def test_change_status(spark, v, u, r, has, status):
    got = changes.change_status(*[F.lit(bool(x)) for x in (v, u, r, has)], F.lit("d"))
    assert one(spark, got.alias("s")).s == status


SUMMARY = {"none": ({"k": "1"}, [], True), "updated": ({"k": "1"}, ["k"], True), "error": ({"k": None}, [], True), "plain": ({"k": "1"}, [], False)}
ACTIONS = "seq long, op string, old struct<k:string>, new struct<k:string>, old_meta struct<updated:array<string>,removed:array<string>,typed:boolean>, new_meta struct<updated:array<string>,removed:array<string>,typed:boolean>"


def action(spark, op, old, new):
    doc = lambda s: None if s is None else (SUMMARY[s][0]["k"],)
    meta = lambda s: None if s is None else (SUMMARY[s][1], [], SUMMARY[s][2])
    return spark.createDataFrame([(1, op, doc(old), doc(new), meta(old), meta(new))], ACTIONS)


@pytest.mark.parametrize(
    ("op", "old", "new", "kinds"),
    [
        ("insert", None, "updated", ["insert"]), ("insert", None, "none", []), ("insert", None, "error", []), ("insert", None, "plain", []),
        ("delete", "none", None, ["delete"]), ("delete", "error", None, []), ("delete", "updated", None, "badaction"),
        ("update", None, "updated", ["insert"]), ("update", "error", "error", []), ("update", "none", "none", []), ("update", "error", "updated", ["insert"]),
        ("update", "error", "none", []), ("update", "none", "error", ["delete"]), ("update", "updated", "error", "badaction"), ("update", "none", "updated", ["delete", "insert"]),
        ("update", "updated", "none", "badaction"), ("update", "updated", "updated", "badaction"),
    ],
)
def test_normalise(spark, op, old, new, kinds):
    emitted = changes.normalise(action(spark, op, old, new), ["k"])
    if kinds == "badaction":
        with pytest.raises(Exception, match="badaction"):
            emitted.collect()
    else:
        assert [r.kind for r in emitted.orderBy("part").collect()] == kinds


def test_force(spark):
    plain = changes.normalise(action(spark, "insert", None, "plain"), ["k"], force=True)
    assert [r.kind for r in plain.collect()] == ["insert"]


def test_invalid_indices():
    base = {"name": "i", "bucket_prefix": "b"}
    for wrong in (
        {"index_by": ()}, {"index_by": ("a",)}, {"index_by": ("a", "b"), "partition_by": ("a",), "aggregate_by": ("b",)}, {"index_by": ("a",), "partition_by": ("a",), "aggregate_by": ("a",)},
        {"index_by": ("a",), "partition_by": ("a",), "cardinality": "two"}, {"index_by": ("a",), "partition_by": ("a",), "partitions": 0},
    ):
        with pytest.raises(ValueError, match="invalid_configuration"):
            HashIndex(**base, **wrong)
    with pytest.raises(ValueError):
        SimpleIndex(**base, index_by=())


USERS = HashIndex("users", "users", ("post_code", "email"), ("user_id", "account_id"), partition_by=("post_code",), aggregate_by=("post_code",))


def users(spark, n=5000):
    rows = spark.range(2 * n).select(((F.col("id") % 2) + 1).cast("string").alias("post_code"), (F.col("id") / 2).cast("long").cast("string").alias("n"))
    return rows.select(F.concat(F.lit("PC"), "post_code").alias("post_code"), F.concat("n", F.lit("@example.com")).alias("email"), F.concat(F.lit("U"), "n").alias("user_id"), F.concat(F.lit("A"), "n").alias("account_id"))


def test_match_aggregate(spark):
    entries = USERS.build(users(spark))
    whole = USERS.match(entries, {"post_code": "PC1"})
    assert whole.count() == 5000 and whole.columns == ["post_code", "email", "user_id", "account_id"]
    keys_desc = [r.email for r in whole.collect()]
    assert keys_desc == sorted(keys_desc, reverse=True)
    full = USERS.match(entries, {"post_code": "PC1", "email": "1@example.com"})
    assert [r.asDict() for r in full.collect()] == [{"post_code": "pc1", "user_id": "u1", "account_id": "a1"}]
    assert USERS.match(entries, {"post_code": "PC9"}).isEmpty()
    with pytest.raises(MissingPatternKey):
        USERS.match(entries, {"email": "1@example.com"})


def test_match_patterns(spark):
    both = HashIndex("i", "b", ("a", "b"), ("c",), partition_by=("b",), aggregate_by=("a",))
    plain = HashIndex("i", "b", ("a",), ("c",), partition_by=("b",), cardinality="many", case_sensitive=True)
    rows = spark.createDataFrame([("A", "B", "C"), ("A", "B", "D"), ("A", "B", "D")], "a string, b string, c string")
    with pytest.raises(BadPattern):
        both.match(both.build(rows), {"b": "B"})
    with pytest.raises(BadPattern):
        plain.match(plain.build(rows), {"b": "B"})
    assert [r.c for r in plain.match(plain.build(rows), {"a": "A", "b": "B"}).collect()] == ["D", "C"]
    with pytest.raises(TypeError):
        plain.build(rows.withColumn("c", F.lit(1)))


def test_index_json():
    for i in (USERS, SimpleIndex("s", "b", (("a", "integer"),), ("c",))):
        assert from_json(i.to_json()) == i
    assert USERS.partition_identifiers("desc") == USERS.partition_identifiers()[::-1]
    assert USERS.number_of_partitions() == 8 and USERS.index_by == ("email",) and USERS.distinguished == ("post_code", "email", "user_id", "account_id")


THINGS = "seq long, op string, old struct<id:string,account_id:string>, new struct<id:string,account_id:string>, old_meta struct<updated:array<string>,removed:array<string>,typed:boolean>, new_meta struct<updated:array<string>,removed:array<string>,typed:boolean>"
CLEAN, CHANGED = ([], [], True), (["account_id"], [], True)


def things(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], THINGS)


def test_simple_index_scenario(spark):
    index = SimpleIndex("things", "t", ("account_id",), ("id",))
    doc = lambda i, a=1: (f"thing:{a}_{i}", f"acc:{a}")
    base = spark.createDataFrame([doc(i) for i in range(1, 701)], "id string, account_id string")
    entries = index.build(base)
    count = lambda e, a=1: index.match(e, {"account_id": f"acc:{a}"}).count()
    assert count(entries) == 700 and index.match(entries, {"account_id": "acc:1"}).first().id == "thing:1_1"
    act = lambda e, *rows: index.apply(e, index.delta(things(spark, *rows)))
    entries = act(entries, ("delete", doc(1), None, CLEAN, None))
    assert count(entries) == 699
    entries = act(entries, ("insert", None, doc(1), None, CLEAN), ("delete", doc(2), None, CLEAN, None))
    assert count(entries) == 698  # an unchanged insert is nothing
    entries = act(entries, ("update", doc(3), ("thing:1_3", "acc:2"), CLEAN, CHANGED))
    assert (count(entries), count(entries, 2)) == (697, 1)
    entries = act(entries, ("update", ("thing:1_3", "acc:2"), ("thing:1_3", None), CLEAN, ([], ["account_id"], True)))
    assert (count(entries), count(entries, 2)) == (697, 0)
    # Within a batch the last action on an identity decides.
    entries = act(entries, ("delete", doc(4), None, CLEAN, None), ("insert", None, doc(4), None, CHANGED), ("delete", doc(5), None, CLEAN, None))
    assert count(entries) == 696
    with pytest.raises(Exception, match="badaction"):
        index.delta(things(spark, ("delete", doc(6), None, CHANGED, None))).collect()


def test_identification_removed(spark):
    index = HashIndex("by_id", "a", ("type", "number"), ("account",), partition_by=("type", "number"), partitions=128)
    rows = spark.createDataFrame([("DNI", str(i), f"acc{i}") for i in range(1, 11)], "type string, number string, account string")
    entries = index.build(rows)
    assert index.match(entries, {"type": "DNI", "number": "1"}).collect()[0].account == "acc1"
    schema = THINGS.replace("id:string,account_id:string", "type:string,number:string,account:string")
    gone = spark.createDataFrame([(1, "update", ("DNI", "1", "acc1"), (None, None, "acc1"), CLEAN, ([], ["type", "number"], True))], schema)
    after = index.apply(entries, index.delta(gone))
    assert index.match(after, {"type": "DNI", "number": "1"}).isEmpty() and after.count() == 9


def test_pages(spark):
    entries = USERS.build(users(spark, 20))
    seen, after = [], None
    while rows := USERS.page(entries, 7, after).collect():
        seen += rows
        after = {k: rows[-1][k] for k in ("agg_key", "index_key", "value")}
    assert len(seen) == 40 == len({(r.agg_key, r.index_key) for r in seen})


def test_catalog_and_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    manager = Manager(store)
    base = users(spark, 50)
    collection = manager.create_index(USERS, Collection("users", "users"), base)
    with pytest.raises(AlreadyExists):
        manager.create_index(USERS, collection, base)
    simple = SimpleIndex("by_account", "users", ("account_id",), ("user_id",))
    with manager.workflow():
        collection = manager.create_index(simple, collection, base)
        assert manager.steps() == ["write by_account", "save users"]
    assert manager.fetch("users", "users").index_names() == ["by_account", "users"]
    with pytest.raises(BadIndex):
        collection.index("none")
    found = manager.match(USERS, {"post_code": "PC2", "email": "3@example.com"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_id" in plan
    assert found.first().user_id == "u3"
    schema = THINGS.replace("id:string,account_id:string", "post_code:string,email:string,user_id:string,account_id:string")
    new = ("PC1", "new@example.com", "U99", "A9")
    batch = spark.createDataFrame([(1, "insert", None, new, None, (["email", "account_id"], [], True))], schema)
    assert manager.update_all_indices(batch, collection) == ["by_account", "users"]
    assert manager.match(simple, {"account_id": "A9"}).count() == 2
    assert manager.update_all_indices(batch.where("false"), collection) == []
    with pytest.raises(RuntimeError), manager.workflow():
        manager.drop_all_indices(collection)
        raise RuntimeError
    assert manager.lookup("users", "users").size == 2
    manager.rebuild_index("by_account", collection, base)
    assert manager.match(simple, {"account_id": "A9"}).count() == 1
    collection = manager.drop_index("by_account", collection)
    with pytest.raises(NotFound):
        manager.entries(simple)
    manager.delete(collection)
    assert manager.lookup("users", "users") is None


def test_background_cache_and_times(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", Cache(entries=1))
    manager = Manager(store)
    work = manager.submit(lambda m: m.create_index(USERS, Collection("users", "users"), users(spark, 5)))
    assert work.wait(120).index_names() == ["users"] and work.status() == "completed"
    failed = manager.submit(lambda m: m.drop_index("none", work.wait()))
    with pytest.raises(BadIndex):
        failed.wait(60)
    assert failed.status() == "failed"
    meta = manager.partition_meta(USERS).collect()
    assert len(meta) == 8 and sum(r.n for r in meta) == 10 and all(r.created_ts <= r.last_updated_ts for r in meta if r.n)
    at = manager._data(USERS)
    first = store.read(*at, force_refresh=False)
    assert store.read(*at, force_refresh=False) is first and first.is_cached
    manager.rebuild_index("users", work.wait(), users(spark, 6))
    assert store.read(*at, force_refresh=False).count() == 12 and not first.is_cached


def test_documents(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    frame = lambda *rows: spark.createDataFrame(rows, "key string, v long")
    store.put("t", "b", frame(("a", 1), ("b", 2)))
    back = store.put("t", "b", frame(("a", 3)), return_body=True)
    assert back.first().v == 3 and store.get("t", "b", "b").first().v == 2
    store.delete("t", "b", frame(("a", 0)))
    with pytest.raises(NotFound):
        store.get("t", "b", "a")
    with pytest.raises(ValueError, match="badarg"):
        Options.of({"unknown": 1})
    assert Options.of({"r": "quorum", "timeout": 5}).timeout_ms == 5


def test_streams(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    manager = Manager(store)
    index = SimpleIndex("things", "t", ("account_id",), ("id",))
    base = spark.createDataFrame([("t1", "a")], "id string, account_id string")
    collection = manager.create_index(index, Collection("things", "t"), base)
    rows = things(spark, ("insert", None, ("t2", "a"), None, CHANGED), ("delete", ("t1", "a"), None, CLEAN, None))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    maintain.maintain(stream, manager, collection, f"{tmp_path}/cp").awaitTermination()
    assert [r.id for r in manager.match(index, {"account_id": "a"}).collect()] == ["t2"]
    ops = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = maintain.counters(ops, ["op"], F.lit(1)).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.op: r.value for r in spark.table("counted").collect()} == {"insert": 1, "delete": 1}
    assert maintain.ring(spark.readStream.format("rate").load(), "timestamp", 2, ["value"]).isStreaming


PATCH_KIND = (
    T.StructType().add("id", "string").add("n", "long").add("tags", T.ArrayType(T.StringType())).add("at", T.StructType().add("a", "string").add("f", "boolean"))
    .add("m", T.MapType(T.StringType(), T.StructType().add("x", "long")))
)


def patched(spark, *ops):
    doc = F.from_json(F.lit('{"id": "i", "n": 1, "tags": ["a", "b"], "at": {"a": "v", "f": true}, "m": {"k": {"x": 1}}}'), PATCH_KIND)
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(p).alias("path"), F.lit(a).alias("action"), F.lit(v).cast("string").alias("value")) for i, (p, a, v) in enumerate(ops)])
    return one(spark, crdt.patch(doc, PATCH_KIND, rows).alias("r")).r


def test_patch_nested(spark):
    r = patched(spark, ("/at/a", "set", "w"), ("/m/k/x", "increment", None), ("/m/new/x", "decrement", None), ("/tags", "remove", "a"), ("/n", "remove", None), ("/id", "update", "j"), ("/id/", "remove", None))
    assert (r.doc.at.a, r.doc.m["k"].x, r.doc.m["new"].x, r.doc.tags, r.doc.n, r.doc.id) == ("w", 2, -1, ["b"], None, None)
    assert (r.updated, r.removed) == (["/at/a", "/m/k/x", "/m/new/x", "/tags"], ["/id", "/n"])
    r = patched(spark, ("/m/k", "remove", None), ("/tags", "remove", None), ("/at", "update", '{"a": "q", "f": false}'))
    assert (r.doc.m, r.doc.tags, r.doc.at.a, r.removed) == ({}, None, "q", ["/m/k", "/tags"])


@pytest.mark.parametrize(("op", "error"), [(("/zz", "set", "1"), "missing_spec"), (("/at/zz", "set", "1"), "missing_spec"), (("/n/a", "set", "1"), "badkey"), (("/n", "enable", None), "badaction"), (("n", "set", "1"), "badpath")])
def test_patch_errors(spark, op, error):
    with pytest.raises(Exception, match=error):
        patched(spark, op)


def test_new_map_checks_at_any_depth(spark):
    spec = {"a": ("map", {"b": ("register", "integer")}), "m": ("map", {"_": ("set", "binary")})}
    kind = T._parse_datatype_string("a struct<b:bigint,zz:string>, m map<string,array<string>>")
    doc = F.from_json(F.lit('{"a": {"b": 1, "zz": "x"}, "m": {"k": ["y", "x", "y"]}}'), kind)
    with pytest.raises(KeyError, match="missing_spec.*/a/zz"):
        typespec.new_map(doc, kind, spec)
    r = one(spark, typespec.new_map(doc, kind, spec, missing_spec="ignore").alias("r")).r
    assert r.doc.asDict(True) == {"a": {"b": 1}, "m": {"k": ["x", "y"]}} and r.updated == ["/a/b", "/m/k"] and r.removed == []
    with pytest.raises(TypeError, match="datatype_mismatch: /a/b"):
        typespec.new_map(doc, kind, {"a": ("map", {"b": ("flag", "boolean")})}, missing_spec="ignore")


def test_build_skips_incomplete_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), (None, "2"), ("b", None)], "k string, v string")
    index = HashIndex("i", "b", ("k",), ("v",), partition_by=("k",))
    assert [r.k for r in index.build(rows).collect()] == ["a"]
    manager = Manager(Store(spark, f"file://{tmp_path}"))
    collection = manager.create_index(index, Collection("c", "b"), rows)
    assert manager.rebuild_index("i", collection, rows) == {"succeeded": 1, "failed": 2}


def test_ring_takes_deltas_and_patterns(spark, tmp_path):
    rows = spark.sql("SELECT 'u' || id % 2 u, 'e' || id e, timestamp'2024-01-01' + make_dt_interval(cast(id as int)) ts FROM range(4)")
    ring = RingIndex("r", "b", ("u",), ("e",), timestamp_field="ts", slots=16)
    wanted = rows.select("u", ring.slot(F.col("ts")).cast("string").alias("slot"))
    assert sorted(r.e for r in ring.match_many(ring.build(rows), wanted).collect()) == ["e0", "e1", "e2", "e3"]
    with pytest.raises(MissingPatternKey):
        ring.match(ring.build(rows), {"slot": "1"})


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", slices=4)
    frame = lambda *rows: spark.createDataFrame(rows, "key string, v long")
    store.put("t", "b", frame(*[(f"k{i}", i) for i in range(40)]))
    before = store.documents("t", "b")
    with pytest.raises(ValueError, match="several rows"):
        store.put("t", "b", frame(("k1", 5), ("k1", 6)))
    first = store._manifest("t", "b")
    store.put("t", "b", frame(("k1", 5), ("k1", 6)), order=["v"])
    assert store.get("t", "b", "k1").first().v == 6 and store.documents("t", "b").count() == 40
    assert before.where("key = 'k1'").first().v == 1  # a plan of the last version still reads its files
    with pytest.raises(Conflict):
        store.publish("t", "b", first, first["version"])
    second = store._manifest("t", "b")
    assert len([k for k, p in second["parts"].items() if first["parts"][k] != p]) == 1  # one slice was rewritten
    assert [f.endswith("crc") for f in os.listdir(f"{tmp_path}/t/b/_manifests") if not f.isdigit()] in ([], [True], [True, True])


def test_partitions_and_requests(spark, tmp_path):
    manager = Manager(Store(spark, f"file://{tmp_path}"))
    manager.create_index(USERS, Collection("users", "users"), users(spark, 5))
    with pytest.raises(NotFound, match="partition_not_found"):
        manager.partition(USERS, "users_partition_99")
    with pytest.raises(ValueError, match="badarg"):
        Options.validated("delete", {"return_body": True})
    assert Options.validated("delete", {"return_body": True, "r": 1}, "relaxed").request() == {"timeout": 60_000, "return_body": False, "r": 1}
    config = Config.of(spark, bucket_slices="8", cache="true")
    config.set("cache_entries", 2)
    assert (config.get("bucket_slices"), config.store(spark, "/x").cache.entries, config.store(spark, "/x").slices) == (8, 2, 8)
    with pytest.raises(KeyError):
        config.get("none")
    with pytest.raises(DatatypeMismatch):
        execute(lambda s: s.sql("SELECT cast('x' AS int)").collect(), spark)


def test_cursor(spark):
    entries = USERS.build(users(spark, 5))
    for descending in (False, True):
        cursor, seen = USERS.cursor(entries, 3, descending=descending), []
        while not cursor.done:
            seen.append(cursor.key)
            cursor.move()
        assert len(seen) == 10 and seen == sorted(seen, reverse=descending)
    assert USERS.cursor(entries.where("false")).done


def test_normalised_actions_name_each_status_once(spark, tmp_path):
    """Repeated expressions made methods that the JVM doesn't compile."""
    things(spark, ("insert", None, ("t2", "a"), None, CHANGED), ("update", ("t1", "a"), ("t3", "a"), CLEAN, CHANGED)).write.parquet(f"{tmp_path}/in")
    got = changes.normalise(spark.read.parquet(f"{tmp_path}/in"), ["id", "account_id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_contains") <= 16
    assert sorted((r.part, r.kind, r.data.id) for r in got.collect()) == [(0, "delete", "t1"), (1, "insert", "t2"), (1, "insert", "t3")]


def test_stored_index_takes_one_shuffle(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    manager, plans = Manager(store), []
    index = HashIndex("h", "t", ("account_id",), ("id",), partition_by=("account_id",), partitions=1, cardinality="many")
    stage = store.stage

    def staged(df, *args):
        if args[1].startswith("t-index_data"):
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0])
        return stage(df, *args)

    monkeypatch.setattr(store, "stage", staged)
    base = spark.range(2000).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("id"), F.lit("A").alias("account_id"))
    collection = manager.create_index(index, Collection("h", "t"), base.unionAll(base))
    # Many actions on one identity, of which the last decides, and one on another.
    rows = [("insert" if i % 2 else "delete", None if i % 2 else ("t1", "a"), ("t1", "a") if i % 2 else None, None if i % 2 else CLEAN, CHANGED if i % 2 else None) for i in range(51)]
    manager.update_all_indices(things(spark, *rows, ("insert", None, ("t9999", "a"), None, CHANGED)), collection)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1]
    got = {r.id for r in manager.entries(index).collect()}
    assert got == {f"t{i}" for i in range(2000)} - {"t1"} | {"t9999"} and manager.entries(index).count() == 2000
