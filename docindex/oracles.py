"""SQL with the results that the registered queries must have, written against the tables alone."""

from __future__ import annotations

_OPS = """
ops AS (SELECT event_id, ts, user_id, value, json_extract_string(props, '$.k') AS k,
  CASE event_type WHEN 'click' THEN 'increment' WHEN 'error' THEN 'decrement' WHEN 'view' THEN 'add_element' WHEN 'purchase' THEN 'del_element' ELSE 'enable' END AS op,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS delta FROM events)
"""

_SNAPSHOTS = """
old AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority, o_orderkey % 10 AS n FROM orders),
new AS (SELECT CASE WHEN n = 4 THEN '9' || o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN n IN (2, 3) THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN n <> 1 THEN o_orderpriority END AS o_orderpriority FROM old WHERE n <> 0)
"""


def _jump(buckets: int) -> str:
    """(k, b) for numbers k of a table `nums`."""
    return f"""
w{buckets}(k, state, b, j) AS (
  SELECT k, k::HUGEINT, -1::BIGINT, 0::BIGINT FROM nums
  UNION ALL
  SELECT k, s, j, floor((j + 1) * (2147483648::DOUBLE / ((s // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT k, j, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM w{buckets} WHERE j < {buckets}))
"""


_HASH = "('0x' || substr(md5({}), 1, 7))::BIGINT"

ORACLES: dict[str, str] = {
    "index_base_join": """
SELECT o_orderkey, o_custkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'F')""",
    "kv_get_path": "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer",
    "kv_get_default": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.zz'), 'none') AS zz FROM events",
    "kv_find": "SELECT c_custkey AS id, c_custkey % 3 <> 0 AS found, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS value FROM customer",
    "kv_put_path": "SELECT c_custkey AS id, c_mktsegment AS segment, upper(c_mktsegment) AS name FROM customer",
    "map_collect": "SELECT c_mktsegment || CASE WHEN c_custkey % 3 <> 0 THEN '|' || c_name ELSE '' END AS collected, c_mktsegment AS segment, c_custkey AS id FROM customer",
    "map_keys": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'name,segment' ELSE 'segment' END AS names, CASE WHEN c_custkey % 3 <> 0 THEN 2 ELSE 1 END::BIGINT AS n FROM customer",
    "kv_fold": "SELECT c_custkey, (c_custkey * 31 + c_nationkey)::BIGINT AS folded FROM customer",
    "dirty_fetch": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'status' ELSE 'priority,status' END AS names FROM orders""",
    "map_wildcard": "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
    "codec_decode": """
SELECT o_orderkey, try_cast(nullif(CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x1' ELSE o_custkey::VARCHAR END, '') AS BIGINT) AS n,
       CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b,
       CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 0.5::DOUBLE END AS x FROM orders""",
    "codec_encode": "SELECT o_orderkey, o_custkey::VARCHAR AS n, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_totalprice > 100000)::VARCHAR END AS b FROM orders",
    "register_base": "SELECT o_orderkey, o_orderkey AS from_hex FROM orders",
    "typed_document": """
SELECT o_orderkey AS id, o_orderstatus = 'F' AS ok, CASE o_custkey % 4 WHEN 3 THEN '3' ELSE (o_custkey % 4) || ',3' END AS tags, o_custkey + 0.25::DOUBLE AS price FROM orders""",
    "gen_key": "SELECT p_partkey, lower(p_brand) || chr(25) || lower(p_type) AS joined, lower(p_type) AS type FROM part",
    "jump_hash": f"""
WITH RECURSIVE nums AS (SELECT o_orderkey AS k FROM orders), {_jump(8)}, {_jump(128)}
SELECT a.k AS o_orderkey, a.b::INTEGER AS b8, c.b::INTEGER AS b128 FROM w8 a JOIN w128 c ON a.k = c.k WHERE a.j >= 8 AND c.j >= 128""",
    "string_hash": f"SELECT p_partkey, {_HASH.format('p_brand')} AS h FROM part",
    "partition_ids": """
SELECT 'orders_by_key_partition_' || i AS identifier, i::BIGINT AS pos, 'asc' AS sort FROM range(8) t(i)
UNION ALL SELECT 'orders_by_key_partition_' || (7 - i), i::BIGINT, 'desc' FROM range(8) t(i)""",
    "partition_sizes": f"""
WITH RECURSIVE nums AS (SELECT DISTINCT {_HASH.format('lower(p_brand)')} AS k FROM part), {_jump(32)},
n AS (SELECT b, count(*) AS n FROM part JOIN w32 ON {_HASH.format('lower(p_brand)')} = k WHERE j >= 32 GROUP BY b)
SELECT i::INTEGER AS partition_id, 'parts_by_brand_partition_' || i AS identifier, coalesce(n, 0)::BIGINT AS n FROM range(32) t(i) LEFT JOIN n ON b = i""",
    "partition_name_simple": "SELECT o_orderkey::VARCHAR AS o_orderkey, 'things_by_customer_partition_' || o_custkey AS partition FROM orders",
    "hash_one_match": "SELECT o_custkey::VARCHAR AS o_custkey, lower(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey = 7",
    "hash_many_match": "SELECT p_partkey::VARCHAR AS p_partkey, lower(p_type) AS p_type FROM part WHERE lower(p_brand) = 'brand#11'",
    "hash_agg_scan": "SELECT lower(c_mktsegment) AS c_mktsegment, c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "hash_agg_full": "SELECT lower(c_mktsegment) AS c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')",
    "hash_agg_full_many": "SELECT lower(c_mktsegment) AS c_mktsegment, c_custkey::VARCHAR AS c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
    "simple_match": "SELECT o_orderkey::VARCHAR AS o_orderkey FROM orders WHERE o_custkey = 5",
    "batch_match": """
SELECT c_name AS asked_by, o_custkey::VARCHAR AS o_custkey, o_orderkey::VARCHAR AS o_orderkey, lower(o_orderpriority) AS o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 9000 AND o_orderstatus = 'F'""",
    "index_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "keyset_page": """
SELECT o_orderkey::VARCHAR AS index_key, o_custkey || chr(25) || lower(o_orderpriority) AS value FROM orders ORDER BY o_orderkey::VARCHAR LIMIT 50 OFFSET 50""",
    "lww_register": "SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY user_id",
    "cardinality_one": "SELECT o_custkey::VARCHAR AS o_custkey, max(o_orderkey)::VARCHAR AS o_orderkey FROM orders GROUP BY o_custkey",
    "cardinality_many": "SELECT DISTINCT lower(c_mktsegment) AS c_mktsegment, c_nationkey::VARCHAR AS c_nationkey, c_custkey::VARCHAR AS c_custkey FROM customer",
    "counter_fold": f"WITH {_OPS} SELECT user_id, sum(delta)::BIGINT AS value FROM ops GROUP BY user_id",
    "counter_running": f"WITH {_OPS} SELECT event_id, user_id, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM ops",
    "counter_set": "SELECT c_custkey, nullif(c_custkey % 5 - c_custkey % 7, 0)::BIGINT AS increment, (c_custkey % 5)::BIGINT AS value FROM customer",
    "counter_ops": "SELECT c_custkey, c_custkey + 3 AS value, c_custkey AS original, 3::BIGINT AS op FROM customer",
    "flag_fold": "SELECT user_id, arg_max(event_type, ts) = 'signup' AS value FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id",
    "flag_ops": """
SELECT c_custkey, c_custkey % 3 = 0 AS value, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 THEN false ELSE true END AS original,
       CASE WHEN c_custkey % 3 = 0 THEN 'enable' ELSE 'disable' END AS op FROM customer""",
    "set_fold": f"""
WITH {_OPS}, last AS (SELECT user_id, k, arg_max(op, ts) AS op FROM ops WHERE op IN ('add_element', 'del_element') GROUP BY user_id, k)
SELECT user_id, k FROM last WHERE op = 'add_element'""",
    "set_merge_add_wins": f"""
WITH {_OPS} SELECT DISTINCT user_id, k FROM ops a WHERE op = 'add_element'
AND NOT EXISTS (SELECT 1 FROM ops r WHERE r.op = 'del_element' AND r.user_id = a.user_id AND r.k = a.k AND a.event_id <= r.event_id - 1000)""",
    "set_elements_diff": f"""
WITH {_OPS}, a AS (SELECT DISTINCT user_id, k FROM ops WHERE op = 'add_element' AND day(ts) <= 15), b AS (SELECT DISTINCT user_id, k FROM ops WHERE op = 'add_element' AND day(ts) > 15)
SELECT *, 'add' AS op FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'remove' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "set_subtract": """
WITH s AS (SELECT c_custkey AS n, list_distinct([n % 3, n % 5, 9, n % 7]) AS a, [n % 4, n % 5] AS b FROM customer)
SELECT n AS c_custkey, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ','), '') AS rest, len(a)::BIGINT AS n FROM s""",
    "set_algebra": """
WITH s AS (SELECT c_custkey AS n, list_distinct([n % 3, n % 5, 9, n % 7]) AS a, list_distinct([n % 4, n % 5]) AS b FROM customer)
SELECT n AS c_custkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, coalesce(array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ','), '') AS common,
       len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM s""",
    "set_membership": """
SELECT c_custkey, (c_custkey % 3 = 1 OR c_custkey % 5 = 1 OR c_custkey % 7 = 1) AND c_custkey % 2 <> 1 AS effective, c_custkey % 3 = 1 OR c_custkey % 5 = 1 AS original FROM customer""",
    "has_changes": f"""
WITH {_SNAPSHOTS} SELECT o.o_orderkey, (o.o_custkey, o.o_orderstatus, o.o_orderpriority) IS DISTINCT FROM (w.o_custkey, w.o_orderstatus, w.o_orderpriority) AS changed
FROM old o JOIN new w ON o.o_orderkey = w.o_orderkey""",
    "change_status": f"""
WITH {_SNAPSHOTS} SELECT w.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'updated' WHEN o.o_custkey <> w.o_custkey THEN 'updated' ELSE 'none' END AS o_custkey,
       CASE WHEN o.o_orderkey IS NULL OR o.o_orderstatus <> w.o_orderstatus THEN 'updated' ELSE 'none' END AS o_orderstatus,
       CASE WHEN w.o_orderpriority IS NULL AND o.o_orderpriority IS NOT NULL THEN 'removed' WHEN w.o_orderpriority IS NULL THEN 'error' WHEN o.o_orderkey IS NULL OR o.o_orderpriority IS DISTINCT FROM w.o_orderpriority THEN 'updated' ELSE 'none' END AS o_orderpriority
FROM new w LEFT JOIN old o ON o.o_orderkey = w.o_orderkey""",
    "changed_key_paths": f"""
WITH {_SNAPSHOTS}, j AS (SELECT o.o_orderkey, o AS a, w AS b FROM old o JOIN new w ON o.o_orderkey = w.o_orderkey)
SELECT o_orderkey, 'updated' AS kind, '/o_custkey' AS path FROM j WHERE a.o_custkey <> b.o_custkey
UNION ALL SELECT o_orderkey, 'updated', '/state/o_orderstatus' FROM j WHERE a.o_orderstatus <> b.o_orderstatus
UNION ALL SELECT o_orderkey, 'updated', '/state/o_orderpriority' FROM j WHERE b.o_orderpriority IS NOT NULL AND a.o_orderpriority IS DISTINCT FROM b.o_orderpriority
UNION ALL SELECT o_orderkey, 'removed', '/state/o_orderpriority' FROM j WHERE a.o_orderpriority IS NOT NULL AND b.o_orderpriority IS NULL""",
    "op_rows": f"""
WITH {_SNAPSHOTS}, j AS (SELECT o.o_orderkey, o AS a, w AS b FROM old o JOIN new w ON o.o_orderkey = w.o_orderkey),
r AS (SELECT o_orderkey, 0 AS g, 'remove' AS op, '/o_orderpriority' AS path, NULL::VARCHAR AS value FROM j WHERE a.o_orderpriority IS NOT NULL AND b.o_orderpriority IS NULL
      UNION ALL SELECT o_orderkey, 1, 'update', '/o_custkey', b.o_custkey FROM j WHERE a.o_custkey <> b.o_custkey
      UNION ALL SELECT o_orderkey, 2, 'update', '/o_orderstatus', b.o_orderstatus FROM j WHERE a.o_orderstatus <> b.o_orderstatus
      UNION ALL SELECT o_orderkey, 3, 'update', '/o_orderpriority', b.o_orderpriority FROM j WHERE b.o_orderpriority IS NOT NULL AND a.o_orderpriority IS DISTINCT FROM b.o_orderpriority)
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY g) - 1)::INTEGER AS seq, op, path, value FROM r""",
    "normalise_actions": """
WITH r AS (SELECT o_orderkey % 7 AS rule, count(*)::BIGINT AS n FROM orders GROUP BY 1)
SELECT rule::BIGINT AS rule, CASE WHEN rule IN (0, 6) THEN 'insert' ELSE 'delete' END AS kind, n FROM r WHERE rule IN (0, 2, 4, 6)
UNION ALL SELECT rule::BIGINT, 'insert', n FROM r WHERE rule = 4""",
    "index_apply_delta": f"WITH {_SNAPSHOTS} SELECT lower(o_orderstatus) AS o_orderstatus, o_custkey, o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM new WHERE o_orderpriority IS NOT NULL",
    "index_rebuild": f"WITH {_SNAPSHOTS} SELECT lower(o_orderstatus) || chr(25) || o_custkey AS index_key, o_orderkey || chr(25) || lower(o_orderpriority) AS value FROM new WHERE o_orderpriority IS NOT NULL",
    "map_update_merge": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 1.5::DOUBLE ELSE c_acctbal END AS balance FROM customer""",
    "patch_fold": "SELECT c_custkey, NULL::VARCHAR AS name, true AS active, 11::BIGINT AS visits, 'b' AS tags FROM customer",
    "catalog_indices": """
SELECT * FROM (VALUES ('orders', 'orders_by_key', 'HashIndex', 'orders'), ('orders', 'orders_by_status_customer', 'HashIndex', 'orders'), ('orders', 'things_by_customer', 'SimpleIndex', 'orders'))
t(collection, index_name, index_type, bucket_prefix)""",
    "ring_day": "SELECT event_id, ((epoch(ts)::BIGINT // 86400) % 12)::INTEGER AS slot FROM (SELECT event_id, date_trunc('day', ts) AS ts FROM events)",
    "ring_week": "SELECT event_id, CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-29') BETWEEN 0 AND 20 THEN (weekofyear(ts) % 3)::INTEGER END AS slot FROM events",
    "document_edits": """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'other' END AS name, (c_custkey + 5) * 2 AS visits, 'a' AS tags, true AS seen,
       '/info/seen' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' /name' END || ' /tags /visits' AS updated, '/info/segment' AS removed, 'removed' AS status, true AS changed FROM customer""",
    "ring_index": """
SELECT event_id::VARCHAR AS event_id, event_type FROM events
WHERE user_id = (SELECT user_id FROM events WHERE event_id = 0) AND date_diff('day', DATE '1970-01-01', ts::DATE) % 16 = (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) % 16 FROM events WHERE event_id = 0)""",
    "keyset_page_desc": """
SELECT lower(p_brand) AS index_key, p_partkey || chr(25) || lower(p_type) AS value FROM part ORDER BY index_key DESC, value DESC LIMIT 20""",
}

_PART_BUCKET = f"""
WITH RECURSIVE nums AS (SELECT DISTINCT {_HASH.format('lower(p_brand)')} AS k FROM part), {_jump(32)},
p AS (SELECT b::INTEGER AS partition_id, lower(p_brand) AS index_key, p_partkey || chr(25) || lower(p_type) AS value, p_partkey FROM part JOIN w32 ON {_HASH.format('lower(p_brand)')} = k WHERE j >= 32),
one AS (SELECT DISTINCT partition_id AS id FROM p WHERE index_key = 'brand#11')
"""

_NEW_ENTRIES = "SELECT lower(o_orderstatus) AS o_orderstatus, o_custkey, o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM new WHERE o_orderpriority IS NOT NULL"
_TEXTS = "o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, {} AS o_orderstatus, o_orderpriority"

#: Queries over stored documents and stored indices.
ORACLES |= {
    "store_get": f"SELECT {_TEXTS.format('o_orderstatus')} FROM orders WHERE o_orderkey = 7",
    "store_put": f"SELECT {_TEXTS.format("CASE WHEN o_orderkey % 5 = 2 THEN 'Y' ELSE o_orderstatus END")}, CASE WHEN o_orderkey % 5 = 2 THEN 2 ELSE 0 END::INTEGER AS at FROM orders",
    "store_put_return_body": f"SELECT {_TEXTS.format("'Z'")} FROM orders WHERE o_orderkey % 50 = 0",
    "store_delete": f"SELECT {_TEXTS.format('o_orderstatus')} FROM orders WHERE o_orderkey % 3 <> 0",
    "execute_fun": "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY o_orderstatus",
    "connection": "SELECT n_nationkey, n_name FROM nation",
    "request_options": "SELECT DISTINCT c_mktsegment, option, value FROM customer, (VALUES ('r', 'quorum'), ('return_body', 'False'), ('timeout', '500')) t(option, value)",
    "collection_io": """
SELECT 'docs' AS collection, 'orders_by_status_customer' AS index_name, 'HashIndex' AS index_type, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'docs', 'things_by_customer', 'SimpleIndex', count(*)::BIGINT FROM orders""",
    "collection_guards": "SELECT CASE WHEN n_nationkey = 0 THEN 'customers_by_segment_nation' ELSE n_name END AS name, n_nationkey = 0 AS is_index, true AS refused, true AS gone FROM nation",
    "workflow_steps": """
SELECT pos, step, n FROM (VALUES (0::BIGINT, 'write things_by_customer'), (1, 'save docs'), (2, 'write orders_by_status_customer'), (3, 'save docs'), (4, 'drop orders_by_status_customer')) t(pos, step), (SELECT count(*)::BIGINT AS n FROM orders)""",
    "workflow_status": "SELECT lower(p_brand) AS p_brand, count(*)::BIGINT AS n, 'completed' AS built, 'failed' AS other FROM part GROUP BY 1",
    "stored_hash_match": ORACLES["hash_many_match"],
    "stored_simple_match": ORACLES["simple_match"],
    "match_order": "SELECT (row_number() OVER (ORDER BY p_partkey || chr(25) || lower(p_type) DESC) - 1)::BIGINT AS pos, p_partkey::VARCHAR AS p_partkey, lower(p_type) AS p_type FROM part WHERE p_brand = 'Brand#23'",
    "stored_hash_update": f"WITH {_SNAPSHOTS} {_NEW_ENTRIES}",
    "stored_simple_update": f"WITH {_SNAPSHOTS} SELECT 'things_by_customer_partition_' || o_custkey AS partition_id, o_custkey, o_orderkey FROM new",
    "stored_rebuild": f"""
WITH {_SNAPSHOTS} SELECT lower(o_orderstatus) || chr(25) || o_custkey AS index_key, o_orderkey || chr(25) || lower(o_orderpriority) AS value,
       (SELECT count(o_orderpriority) FROM new)::BIGINT AS succeeded, (SELECT count(*) - count(o_orderpriority) FROM new)::BIGINT AS failed FROM new WHERE o_orderpriority IS NOT NULL""",
    "stored_drop": "SELECT 'orders_by_status_customer' AS index_name, false AS listed, -1::BIGINT AS n UNION ALL SELECT 'things_by_customer', true, count(*)::BIGINT FROM orders",
    "partition_fetch": f"{_PART_BUCKET} SELECT partition_id, index_key, value FROM p, one WHERE partition_id = id",
    "partition_drop": f"{_PART_BUCKET} SELECT partition_id, index_key, value FROM p, one WHERE partition_id <> id",
    "partition_cache": f"{_PART_BUCKET} SELECT index_key, value, true AS held FROM p, one WHERE partition_id = id AND p_partkey % 2 = 0",
    "partition_times": f"""
{_PART_BUCKET}, n AS (SELECT partition_id AS b, count(*) AS n FROM p GROUP BY 1)
SELECT i::INTEGER AS partition_id, 'parts_by_brand_partition_' || i AS identifier, coalesce(n, 0)::BIGINT AS n, CASE WHEN n > 0 THEN true END AS ordered FROM range(32) t(i) LEFT JOIN n ON b = i""",
    "index_config": """
SELECT lower(c_mktsegment) AS c_mktsegment, count(DISTINCT (c_nationkey, c_custkey))::BIGINT AS n, 'customers-index_data' AS bucket, 'HashIndex' AS type, 'c_mktsegment,c_nationkey,c_custkey' AS distinguished, 'many' AS cardinality FROM customer GROUP BY 1""",
    "index_fold": "SELECT count(*)::BIGINT AS n, min(o_orderkey::VARCHAR) AS first, max(o_orderkey::VARCHAR) AS last FROM orders",
    "index_cursor": "SELECT (row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 1)::BIGINT AS pos, o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey FROM orders ORDER BY o_orderkey::VARCHAR LIMIT 60",
    "actions_by_partition": f"""
WITH RECURSIVE {_SNAPSHOTS}, nums AS (SELECT DISTINCT {_HASH.format('lower(s)')} AS k FROM (SELECT o_orderstatus AS s FROM orders UNION SELECT 'X')), {_jump(16)},
a AS (SELECT o.o_orderkey, o.o_orderstatus, w.o_orderkey IS NULL AS gone, w.o_orderstatus AS now FROM old o LEFT JOIN new w ON o.o_orderkey = w.o_orderkey),
e AS (SELECT o_orderstatus AS s, 'delete' AS kind FROM a WHERE gone OR o_orderstatus <> now UNION ALL SELECT now, 'insert' FROM a WHERE NOT gone AND o_orderstatus <> now
      UNION ALL SELECT o_orderstatus, 'insert' FROM new w WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.o_orderkey = w.o_orderkey))
SELECT b::INTEGER AS partition_id, kind, count(*)::BIGINT AS n FROM e JOIN w16 ON {_HASH.format('lower(s)')} = k WHERE j >= 16 GROUP BY 1, 2""",
    "ring_update": """
SELECT 'by_day_partition_' || (date_diff('day', DATE '1970-01-01', ts::DATE) % 16) AS partition_id, user_id::VARCHAR AS user_id, event_id::VARCHAR AS event_id, event_type FROM events WHERE event_type <> 'error'""",
    "ring_match_many": "SELECT c_name AS asked_by, event_id::VARCHAR AS event_id, event_type FROM events JOIN customer ON c_custkey = user_id WHERE date_diff('day', DATE '1970-01-01', ts::DATE) % 16 = 3",
    "patch_nested": """
SELECT c_custkey, c_name AS name, 11::BIGINT AS visits, false AS active, 'b,c' AS tags, 'NEW' AS segment, NULL::BIGINT AS nation, true AS s1_on, 'y' AS s2_note,
       '/active /at/segment /services/s1/on /services/s2/note /tags /visits' AS updated, '/at/nation' AS removed FROM customer""",
    "typed_new": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_custkey AS ctx, '/balance /id' || CASE WHEN c_custkey % 3 <> 0 THEN ' /info/name' ELSE '' END || ' /info/segment' AS updated, 0::BIGINT AS removed FROM customer""",
    "inferred_new": "SELECT r_regionkey, 3::BIGINT AS hits, true AS on, 'a,b' AS tags, 'x' AS name, '/at/name /hits /on /tags' AS updated FROM region",
    "document_update": """
SELECT c_custkey AS id, 'NEW' AS segment, NULL::VARCHAR AS name, 1.5::DOUBLE AS balance, c_custkey + 1 AS ctx, CASE WHEN c_acctbal = 1.5 THEN '' ELSE '/balance ' END || '/info/segment' AS updated, '/info/name' AS removed FROM customer""",
    "document_sets": """
WITH s AS (SELECT c_custkey AS n, array_to_string(list_sort(list_distinct([c_custkey % 2, c_custkey % 4])), ',') AS tags FROM customer)
SELECT n AS c_custkey, tags, CASE WHEN tags = (n % 3) || ',' || (n % 5) THEN 'none' ELSE 'updated' END AS status FROM s""",
    "map_value": "SELECT c_custkey AS id, c_mktsegment AS segment, 'register' AS entry FROM customer",
    "spec_types": """
SELECT '/by_region/' || r_name || '/n' AS path, 'counter' AS datatype, 'bigint' AS type FROM region UNION ALL SELECT '/by_region/' || r_name || '/on', 'flag', 'boolean' FROM region
UNION ALL SELECT '/id', 'register', 'bigint' UNION ALL SELECT '/tags', 'set', 'array<string>'""",
    "type_predicates": "SELECT r_regionkey, field, datatype, counter FROM region, (VALUES ('id', 'register', true), ('info', 'map', false), ('balance', 'register', false)) t(field, datatype, counter)",
    "set_ops": """
WITH s AS (SELECT c_custkey AS n, list_distinct([c_custkey % 3, c_custkey % 5, 9]) AS v, list_distinct([c_custkey % 3, 8]) AS w FROM customer)
SELECT n AS c_custkey, coalesce(array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(v, x))), ','), '') AS adds,
       coalesce(array_to_string(list_sort(list_filter(v, lambda x: NOT list_contains(w, x))), ','), '') AS removes, (n % 3) * 10 + 8 AS folded FROM s""",
    "names_and_paths": "SELECT r_regionkey, 'docs-index_data' AS data, 'docs-index_collection' AS collection, 'id' AS key, 'a|b' AS path, 'p_' || r_name AS identifier FROM region",
    "stream_maintain": f"WITH {_SNAPSHOTS} {_NEW_ENTRIES}",
    "stream_counters": "SELECT event_type, sum(length(event_type))::BIGINT AS value FROM events GROUP BY event_type",
}
