"""SQL that gives the same rows as the registered queries."""

from __future__ import annotations

_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "
_L = "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE "
_COUNTERS = "t AS (SELECT c_custkey AS user_id, 'click' AS event_type, row_number() OVER (ORDER BY c_custkey) AS _id FROM customer)"


def _increment(start: str, delta: str, kind: str, done: str = "{}") -> str:
    total = done.format(f"(CASE WHEN t._id IS NULL THEN 0 ELSE {start} END + coalesce(c.delta, 0))::{kind}")
    return f"""WITH {_COUNTERS},
c AS (SELECT user_id, event_type, sum({delta}) AS delta, max(event_id) AS last_id, min(event_id) AS first_id FROM events GROUP BY 1, 2),
f AS (SELECT c.user_id, c.event_type, 1000000000 + row_number() OVER (ORDER BY first_id) AS _id FROM c ANTI JOIN t USING (user_id, event_type))
SELECT coalesce(t._id, f._id) AS _id, coalesce(t.user_id, c.user_id) AS user_id, coalesce(t.event_type, c.event_type) AS event_type, {total} AS total, coalesce(c.last_id, -1) AS last_id
FROM c FULL JOIN t ON t.user_id = c.user_id AND t.event_type = c.event_type LEFT JOIN f ON f.user_id = c.user_id AND f.event_type = c.event_type"""


def _knn(distance: str, k: int, where: str = "TRUE") -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
d AS (SELECT vec_id, {distance} AS distance FROM v, q WHERE {where})
SELECT row_number() OVER (ORDER BY distance, vec_id) AS pos, vec_id, round(distance, 6) AS distance FROM d ORDER BY pos LIMIT {k}"""


_COSINE = "CASE WHEN list_inner_product(e, e) * list_inner_product(qe, qe) = 0 THEN 1.0 ELSE 1 - list_inner_product(e, qe) / sqrt(list_inner_product(e, e) * list_inner_product(qe, qe)) END"
_EUCLIDEAN = "list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_PART = "p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS _id, p_partkey, p_name AS name, p_size::BIGINT AS size, p_retailprice AS price, p_brand FROM part)"


_N = "n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS _id, n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS region FROM nation)"
_CUSTOMERS = "c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS _id, c_custkey AS key, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY c_custkey), -c_custkey, NULL, c_acctbal FROM customer)"
_COLLECTION = f"""WITH i AS (SELECT row_number() OVER (ORDER BY vec_id) AS _id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT vec_id, label, CASE WHEN _id = 3 THEN list_transform(e, lambda x: 0.5::DOUBLE) ELSE e END AS e, list_transform(e, lambda x: 0.25::DOUBLE) AS qe FROM i WHERE _id <> 2),
d AS (SELECT vec_id, {_EUCLIDEAN} AS distance FROM v WHERE label <= 4)
SELECT row_number() OVER (ORDER BY distance, vec_id) AS pos, vec_id, round(distance, 6) AS distance FROM d ORDER BY pos LIMIT 12"""


def _page(order: str, columns: str, tail: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS pos, {columns} FROM (SELECT * FROM {tail})"


ORACLE: dict[str, str] = {
    "find_eq": _O + "o_orderstatus = 'F'",
    "find_ne": _O + "o_orderstatus IS DISTINCT FROM 'F'",
    "find_lt": _O + "o_totalprice < 60000 OR o_totalprice IS NULL",
    "find_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10 OR p_size IS NULL",
    "find_gt": "SELECT p_partkey, p_size FROM part WHERE p_size > 40.5",
    "find_ge": _O + "o_totalprice >= 400000",
    "find_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "find_in_empty": "SELECT c_custkey, c_mktsegment FROM customer WHERE FALSE",
    "find_in_with_null": _L + "quality = 0 OR quality IS NULL",
    "find_is_null": _L + "quality IS NULL",
    "find_is_not_null": _L + "toxic IS NOT NULL",
    "find_eq_null": _L + "quality IS NULL",
    "find_ge_null": _L + "lang = 'en'",
    "find_ne_null_rows": _L + "quality IS DISTINCT FROM 1",
    "find_lt_null_rows": _L + "quality < 1 OR quality IS NULL",
    "find_type_mismatch": _L + "quality IS NULL",
    "find_unknown_column": _L + "lang = 'de'",
    "find_and": _O + "o_orderstatus = 'O' AND o_totalprice >= 200000 AND o_custkey < 700",
    "find_or_groups": _O + "o_custkey IS DISTINCT FROM 1 AND ((o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 20000))",
    "find_or_empty_group": _O + "o_orderstatus = 'P'",
    "find_keyset_or": _O + "o_custkey > 500 OR (o_custkey = 500 AND o_orderkey > 1000)",
    "find_sort_multi": _page("o_orderstatus, o_totalprice DESC, o_orderkey", "o_orderkey, o_orderstatus, o_totalprice", "orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 200"),
    "find_sort_nulls_asc": _page("quality ASC NULLS FIRST, lang DESC NULLS LAST, doc_id", "doc_id, quality", "documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS FIRST, lang DESC NULLS LAST, doc_id LIMIT 500 OFFSET (SELECT greatest(0, count(*) - 250) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL)"),
    "find_sort_nulls_desc": _page("quality DESC NULLS LAST, doc_id", "doc_id, quality", "documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500"),
    "find_sort_unknown": _page("o_orderkey", "o_orderkey", "orders ORDER BY o_orderkey LIMIT 50"),
    "find_offset_limit": _page("l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_orderkey", "l_orderkey, l_linenumber, l_extendedprice", "lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_orderkey LIMIT 100 OFFSET 50"),
    "find_with_total": "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_orderkey, total FROM (SELECT *, count(*) OVER () AS total FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10)",
    "get_by_id": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42",
    "multi_get": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 1, 99, 123456789)",
    "count_all": "SELECT count(*) AS n FROM lineitem",
    "count_eq": "SELECT count(*) AS n FROM events WHERE event_type = 'click'",
    "count_or_groups": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND (l_returnflag = 'R' OR (l_linestatus = 'O' AND (l_discount < 0.02 OR l_discount IS NULL)))",
    "scan_pk_page2_asc": _page("o_orderkey", "o_orderkey, o_custkey", "orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100"),
    "scan_pk_desc": _page("o_orderkey DESC", "o_orderkey, o_custkey", "orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 100"),
    "scan_index_asc": _page("o_custkey, o_orderkey", "o_orderkey, o_custkey", "orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 50) ORDER BY o_custkey, o_orderkey LIMIT 200"),
    "scan_index_desc_filtered": _page("o_custkey DESC, o_orderkey DESC", "o_orderkey, o_custkey", "orders WHERE o_orderstatus = 'F' AND (o_custkey < 900 OR (o_custkey = 900 AND o_orderkey < 5000)) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 150"),
    "scan_all_pages": "SELECT ((row_number() OVER (ORDER BY o_custkey DESC, o_orderkey DESC) - 1) // greatest(1, (SELECT (count(*) + 5) // 6 FROM orders)))::BIGINT AS page, o_orderkey, o_custkey FROM orders",
    "join_parent_children": "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey",
    "latest_n_per_parent": "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 5",
    "semi_join_ids": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "insert_many_ids": "SELECT 100 + row_number() OVER (ORDER BY user_id, event_id) AS _id, event_id, user_id FROM events",
    "update_where": "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN (o_totalprice < 50000 OR o_totalprice IS NULL) AND o_orderstatus IS DISTINCT FROM 'F' THEN '0-SET' ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "delete_where": "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS DISTINCT FROM 1",
    "upsert_set": "SELECT c_custkey AS _id, c_name, c_acctbal + 1 AS c_acctbal FROM customer UNION ALL SELECT 1000000000 + row_number() OVER (ORDER BY s_name), s_name, s_acctbal FROM supplier",
    "upsert_increment_int": _increment("10", "1", "BIGINT"),
    "upsert_increment_real": _increment("0.5", "value", "DOUBLE", "round({}, 6)"),
    "upsert_increment_mixed": _increment("0.5", "2", "DOUBLE"),
    "counter_wraps": "SELECT o_orderkey, (CASE WHEN s > 9223372036854775807::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS total FROM (SELECT o_orderkey, 9223372036854775807::HUGEINT - o_orderkey + o_custkey::HUGEINT * 1000 AS s FROM orders)",
    "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "add_column_default": f"WITH {_PART} SELECT _id, name, size, price, 'untagged' AS tag FROM p UNION ALL SELECT (SELECT count(*) FROM p) + row_number() OVER (ORDER BY p_partkey), p_name, p_size::BIGINT, p_retailprice, CASE WHEN p_size > 25 THEN p_brand END FROM part",
    "rename_column": f"WITH {_PART} SELECT _id, name, size AS extent, price FROM p",
    "drop_column": f"WITH {_PART} SELECT _id, name, price FROM p",
    "drop_readd_column": f"WITH {_PART} SELECT _id, name, price, (-1)::BIGINT AS size FROM p",
    "snapshot_mutations": f"WITH {_PART} SELECT _id, CASE WHEN size = 20 THEN 'twenty' ELSE name END AS name, size, CASE WHEN size <= 10 THEN 1.0::DOUBLE ELSE price END AS price FROM p WHERE NOT size > 40",
    "list_tables": "SELECT * FROM (VALUES ('edges', 3::BIGINT, 1::BIGINT), ('users', 2::BIGINT, 1::BIGINT)) t(name, n_columns, n_indexes)",
    "list_columns": "SELECT * FROM (VALUES (1::BIGINT, 'a', 'text'), (2::BIGINT, 'b', 'text'), (3::BIGINT, 'n', 'integer')) t(pos, name, type)",
    "list_indexes": "SELECT 'by_pair' AS name, 'a,b' AS columns, TRUE AS is_unique",
    "encrypt_roundtrip": "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer",
    "knn_cosine": _knn(_COSINE, 10),
    "knn_euclidean": _knn(_EUCLIDEAN, 10),
    "knn_dot": _knn("-list_inner_product(e, qe)", 10),
    "knn_filtered": _knn(_COSINE, 10, "label = 3"),
    "knn_selective_filter": _knn(_EUCLIDEAN, 5, "vec_id IN (7, 11, 13, 17, 19)"),
    "knn_batch": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, {_EUCLIDEAN} AS distance FROM v, q),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, round(distance, 6) AS distance FROM d) SELECT query_id, vec_id, rank, distance FROM r WHERE rank <= 10""",
    "db_find_page": f"WITH {_CUSTOMERS}, f AS (SELECT *, count(*) OVER () AS total FROM c WHERE balance > 0 AND (segment < 'F' OR segment IS NULL OR segment = 'MACHINERY') ORDER BY balance DESC, segment NULLS FIRST, _id LIMIT 40 OFFSET 15) SELECT row_number() OVER (ORDER BY balance DESC, segment NULLS FIRST, _id) AS pos, _id, key, segment, balance, total FROM f",
    "db_find_filtered": f"WITH {_CUSTOMERS} SELECT _id, segment FROM c WHERE _id > 10 AND segment IS DISTINCT FROM 'BUILDING'",
    "db_get": f"WITH {_N} SELECT * FROM n WHERE _id IN (2, 25) UNION ALL SELECT * FROM n WHERE _id IN (7, 3, 999)",
    "db_count": f"WITH {_CUSTOMERS} SELECT 'all' AS what, count(*) AS n FROM c UNION ALL SELECT 'filtered', count(*) FROM c WHERE segment <= 'BUILDING' OR segment IS NULL UNION ALL SELECT 'groups', count(*) FROM c WHERE key > -50 AND ((segment IS NULL AND balance < 100) OR segment = 'BUILDING') UNION ALL SELECT 'ids', count(*) FROM c WHERE _id IN (1, 2, 99999999)",
    "db_scan_batch": f"WITH {_N} SELECT 'id' AS what, (row_number() OVER (ORDER BY _id) - 1) // 4 AS page, _id FROM n UNION ALL SELECT 'index', (row_number() OVER (ORDER BY region DESC, _id DESC) - 1) // 4, _id FROM n WHERE region IS NOT NULL",
    "db_insert": f"WITH {_N} SELECT * FROM n UNION ALL SELECT (SELECT count(*) + 1 FROM n), 100, 'first', -1 UNION ALL SELECT 1000, 101, NULL, NULL UNION ALL SELECT 1001, NULL, 'third', 7",
    "db_update_delete": f"WITH {_N}, u AS (SELECT _id, key, CASE WHEN _id = 3 THEN 'three' ELSE name END AS name, CASE WHEN _id <> 3 THEN region END AS region FROM n WHERE _id NOT IN (5, 7)) SELECT _id, CASE WHEN region <= 1 OR region IS NULL THEN -1 ELSE key END AS key, name, region FROM u",
    "db_upsert": f"""WITH {_N}, s AS (SELECT _id, key, CASE key WHEN 3 THEN 'set' WHEN 4 THEN 'counted' ELSE name END AS name,
(CASE WHEN key = 4 AND region::HUGEINT + 9223372036854775807 > 9223372036854775807 THEN region::HUGEINT + 9223372036854775807 - 18446744073709551616 WHEN key = 4 THEN 9223372036854775807 ELSE region END) + CASE WHEN key IN (SELECT r_regionkey FROM region) THEN 2 ELSE 0 END AS region FROM n)
SELECT _id, key, name, region::BIGINT AS region FROM s UNION ALL SELECT (SELECT count(*) + 1 FROM n), 300, 'new', -1 UNION ALL SELECT (SELECT count(*) + 2 FROM n), 301, NULL, 5 UNION ALL SELECT (SELECT count(*) + 3 FROM n), 400, NULL, 2 * (SELECT count(*) FROM region)""",
    "db_transactions": f"WITH {_N} SELECT _id, key, CASE _id WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE name END AS name, region FROM n WHERE _id <> 3 UNION ALL SELECT (SELECT count(*) + 1 FROM n), 50, 'one', -1",
    "db_drops": "SELECT * FROM (VALUES ('table', 'nation'), ('index', 'b'), ('collection', 'w')) t(kind, name)",
    "db_collection": _COLLECTION,
    "db_collection_encrypted": _COLLECTION,
    "db_async": f"WITH {_N} SELECT _id, key, name, region + CASE WHEN key = 2 THEN 20 ELSE 0 END AS region FROM n WHERE _id <> 1 UNION ALL SELECT (SELECT count(*) + 1 FROM n), 60, 'xy', -1",
}
