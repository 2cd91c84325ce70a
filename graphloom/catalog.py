"""Registered queries over the test tables, each with the SQL that must give the same rows.

Keys start with the id of the capability they show.  ``CYPHER`` holds query
texts; ``OPERATIONS`` (in ``graphloom.catalog_operations``) holds calls of the
DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.planner import run
from graphloom.sources.tables import graph_from_tables

NEXT = "(SELECT p_partkey AS a, (p_partkey - 1 + k) % n + 1 AS b FROM part, (VALUES (1), (7)) t(k), (SELECT count(*) AS n FROM part) c)"
_WALK = "WITH RECURSIVE r AS (SELECT {start} AS s, {start} AS e, 0 AS d, [{start}] AS p{seed} UNION ALL SELECT s, b, d + 1, list_append(p, b) FROM r JOIN " + NEXT + " x ON x.a = r.e WHERE d < {hi} AND (d = 0 OR NOT list_contains(p, b)))"

# key: (query, SQL) or (query, SQL, parameters)
CYPHER: dict[str, tuple] = {
    # scans
    "S01_full_node_scan": ("MATCH (n) RETURN n.kind AS kind, count(*) AS n", "SELECT * FROM (SELECT 'Region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM pages UNION ALL SELECT 'Conversation', count(DISTINCT conv_id) FROM conversations)"),
    "S02_label_scan": ("MATCH (n:Nation) RETURN n.id AS id, n.n_name AS name", "SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation"),
    "S02_abstract_label": ("MATCH (p:Party) RETURN p.kind AS kind, count(p) AS n", "SELECT 'Customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier"),
    "S03_multi_label": ("MATCH (n:Region:Nation) RETURN n.id AS id", "SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation"),
    "S04_inline_property": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "S05_cartesian": ("MATCH (a:Region), (b:Region) RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "S06_edge_scan": ("MATCH ()-[r:IN_REGION]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "S07_single_row": ("RETURN 1 + 2 AS x, 'a' AS y", "SELECT 3::BIGINT AS x, 'a' AS y"),
    # projections, filters, predicates
    "P01_projection": ("MATCH (r:Region) RETURN r.r_name AS name, r.r_regionkey + 1 AS next", "SELECT r_name AS name, r_regionkey::BIGINT + 1 AS next FROM region"),
    "P02_with_star": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH *, n.n_nationkey AS k WHERE k > 3 RETURN r.r_name AS r, n.n_name AS n, k", "SELECT r_name AS r, n_name AS n, n_nationkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey > 3"),
    "P03_distinct": ("MATCH (p:Part) RETURN DISTINCT p.p_brand AS brand", "SELECT DISTINCT p_brand AS brand FROM part"),
    "P04_where": ("MATCH (p:Part) WHERE p.p_size > 10 AND p.p_size <= 20 AND p.p_brand <> 'Brand#1' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 10 AND p_size <= 20 AND p_brand <> 'Brand#1'"),
    "P05_with_stages": ("MATCH (p:Part) WITH p.p_brand AS brand, p.p_size * 2 AS s WITH brand, s + 1 AS s WHERE s > 50 RETURN brand, s", "SELECT p_brand AS brand, p_size::BIGINT * 2 + 1 AS s FROM part WHERE p_size * 2 + 1 > 50"),
    "P06_having": ("MATCH (p:Part) WITH p.p_brand AS brand, count(*) AS n WHERE n > 5 RETURN brand, n", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5"),
    "P07_special_properties": ("MATCH (n:Nation) RETURN n.id AS id, n.kind AS kind, n.nothing AS nothing", "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS kind, NULL::VARCHAR AS nothing FROM nation"),
    "P08_relationship_property": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.n_lines > 1 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.quantity AS q, r.kind AS kind", "SELECT l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS q, 'CONTAINS' AS kind FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2 HAVING count(*) > 1"),
    "P09_property_of_value": ("MATCH (r:Region) WITH collect(r) AS rs UNWIND rs AS x RETURN x.r_name AS name, x.id AS id", "SELECT r_name AS name, 'region:' || r_regionkey AS id FROM region"),
    "P10_comparisons": ("MATCH (o:Order) WHERE o.o_totalprice >= 200000 AND o.o_orderstatus <> 'F' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F'"),
    "P11_xor_not": ("MATCH (p:Part) WHERE (p.p_size > 25 XOR p.p_brand = 'Brand#3') AND NOT p.p_size = 30 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE ((p_size > 25) <> (p_brand = 'Brand#3')) AND NOT p_size = 30"),
    "P12_contains": ("MATCH (p:Part) WHERE p.p_name CONTAINS 'WIDGET' AND p.p_name STARTS WITH 'Cold' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(lower(p_name), 'widget') AND starts_with(lower(p_name), 'cold')"),
    "P12_ends_with": ("MATCH (p:Part) WHERE p.p_name ENDS WITH 't' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE ends_with(lower(p_name), 't')"),
    "P13_regex": ("MATCH (p:Part) WHERE p.p_name =~ '^cold.*' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, '^cold.*')"),
    "P14_is_null": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WITH n, s WHERE s IS NULL RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    "P15_in_list": ("MATCH (p:Part) WHERE p.p_size IN [1, 5, $x] RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9)", {"x": 9}),
    "P16_in_dynamic": ("MATCH (p:Part) WITH p, [p.p_size, 3] AS xs WHERE 3 IN xs AND p.p_size IN range(1, 10) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 1 AND 10"),
    "P17_in_collected": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n) AS ns MATCH (r)<-[:IN_REGION]-(m:Nation) WHERE m IN ns RETURN m.n_name AS name", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "P18_label_predicate": ("MATCH (x:Party)-[:IN_NATION]->(n:Nation) WHERE x:Supplier RETURN x.id AS id, n.n_name AS n", "SELECT 'supplier:' || s_suppkey AS id, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "P19_any_label": ("MATCH (x:Party) WHERE any(l IN labels(x) WHERE l = 'Supplier') RETURN x.id AS id", "SELECT 'supplier:' || s_suppkey AS id FROM supplier"),
    "P20_case": ("MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'middle' ELSE 'large' END AS size, CASE p.p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END AS one", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, CASE p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END::BIGINT AS one FROM part"),
    "P21_quantifiers": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.n_nationkey) AS ks RETURN r.r_name AS r, any(k IN ks WHERE k > 20) AS a, all(k IN ks WHERE k >= 0) AS b, none(k IN ks WHERE k > 30) AS c, single(k IN ks WHERE k < 5) AS d", "SELECT r_name AS r, bool_or(n_nationkey > 20) AS a, bool_and(n_nationkey >= 0) AS b, NOT bool_or(n_nationkey > 30) AS c, count(*) FILTER (n_nationkey < 5) = 1 AS d FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "P22_pattern_predicate": ("MATCH (n:Nation) WHERE (n)<-[:IN_NATION]-(:Supplier) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "P22_pattern_or": ("MATCH (n:Nation) WHERE (n)<-[:IN_NATION]-(:Supplier) OR n.n_nationkey < 3 RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) OR n_nationkey < 3"),
    "P23_exists_block": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 } RETURN c.c_name AS name", "SELECT c_name AS name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "P23_not_exists_query": ("MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' RETURN o } RETURN c.c_name AS name", "SELECT c_name AS name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "P24_exists_function": ("MATCH (n:Nation) WHERE exists((n)<-[:IN_NATION]-(:Supplier)) AND exists(n.n_name) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "P25_relationship_type": ("MATCH (a:Nation)-[r]->(b) WHERE type(r) = 'IN_REGION' RETURN a.n_name AS a, r.kind AS kind, b.id AS b", "SELECT n_name AS a, 'IN_REGION' AS kind, 'region:' || r_regionkey AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "P26_map_projection": ("MATCH (r:Region) WITH r {.r_name, key: r.r_regionkey} AS m RETURN m.r_name AS name, m.key AS key", "SELECT r_name AS name, r_regionkey AS key FROM region"),
    # joins
    "J01_outgoing": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderpriority = '1-URGENT' RETURN c.c_name AS c, o.o_orderkey AS o", "SELECT c_name AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'"),
    "J01_two_hops": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' RETURN n.n_name AS nation, count(c) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "J02_incoming": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "J03_undirected": ("MATCH (a:Part {p_partkey: 5})-[:NEXT]-(b:Part) RETURN b.p_partkey AS b", f"SELECT b FROM {NEXT} WHERE a = 5 UNION ALL SELECT a FROM {NEXT} WHERE b = 5"),
    "J04_connecting": ("MATCH (a:Part), (b:Part) WHERE a.p_partkey = 3 AND b.p_partkey < 20 MATCH (a)-[:NEXT]->(b) RETURN a.p_partkey AS a, b.p_partkey AS b", f"SELECT a, b FROM {NEXT} WHERE a = 3 AND b < 20"),
    "J04_connecting_all": ("MATCH (a:Part), (b:Part) MATCH (a)-[:NEXT]->(b) RETURN a.p_partkey AS a, b.p_partkey AS b", f"SELECT a, b FROM {NEXT} WHERE b IN (SELECT p_partkey FROM part)"),
    "J05_anchored_chain": ("MATCH (n:Nation {n_name: 'NATION_3'}) MATCH (r:Region)<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer) RETURN r.r_name AS r, c.c_name AS c", "SELECT r_name AS r, c_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'"),
    "J06_type_alternation": ("MATCH (n:Nation)-[r:IN_REGION|IN_NATION]-(x) RETURN n.n_name AS n, type(r) AS t, count(*) AS k", "SELECT n_name AS n, t, count(*) AS k FROM nation JOIN (SELECT n_nationkey AS nk, 'IN_REGION' AS t FROM nation UNION ALL SELECT c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT s_nationkey, 'IN_NATION' FROM supplier) ON nk = n_nationkey GROUP BY 1, 2"),
    "J06_relationship_map": ("MATCH (a:Part)-[:NEXT {step: 7}]->(b:Part) WHERE a.p_partkey < 10 RETURN a.p_partkey AS a, b.p_partkey AS b", "SELECT p_partkey AS a, (p_partkey - 1 + 7) % n + 1 AS b FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey < 10"),
    "J06_relationship_map_all": ("MATCH (a:Part)-[:NEXT {step: 7}]->(b:Part) RETURN a.p_partkey AS a, b.p_partkey AS b", "SELECT p_partkey AS a, (p_partkey - 1 + 7) % n + 1 AS b FROM part, (SELECT count(*) AS n FROM part) WHERE b IN (SELECT p_partkey FROM part)"),
    "J07_any_type": ("MATCH (n:Nation)-->(x) RETURN n.n_name AS n, x.id AS x", "SELECT n_name AS n, 'region:' || n_regionkey AS x FROM nation"),
    "J08_optional": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_name AS c, count(o) AS n, sum(o.o_totalprice) AS s", "SELECT c_name AS c, count(o_orderkey) AS n, sum(o_totalprice) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1"),
    "J09_optional_multi_hop": ("MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN r.r_name AS r, n.n_name AS n, s.s_name AS s", "SELECT r_name AS r, n_name AS n, s_name AS s FROM region LEFT JOIN (SELECT * FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000) ON n_regionkey = r_regionkey"),
    "J11_anti_join": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "J12_theta_join": ("MATCH (a:Part), (b:Part) WHERE a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND b.p_size = a.p_size RETURN a.p_partkey AS a, b.p_partkey AS b", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"),
    "J15_count_distinct": ("MATCH (r:Region) RETURN r.r_name AS region, COUNT { MATCH (r)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer) RETURN DISTINCT c.c_mktsegment } AS segments", "SELECT r_name AS region, count(DISTINCT c_mktsegment) AS segments FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name"),
    "J15_count_limit": ("MATCH (r:Region) RETURN r.r_name AS region, COUNT { MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n LIMIT 2 } AS two", "SELECT r_name AS region, least(2, count(n_nationkey)) AS two FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "J15_count_union": ("MATCH (r:Region) RETURN r.r_name AS region, COUNT { MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.n_name AS x UNION MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.n_name AS x } AS names", "SELECT r_name AS region, count(DISTINCT n_name) AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "P23_exists_skip": ("MATCH (n:Nation) WHERE EXISTS { MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN s SKIP 4 } RETURN n.n_name AS nation", "SELECT n_name AS nation FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 4"),
    "J17_call_limit": ("MATCH (r:Region) CALL { WITH r MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.n_name AS x LIMIT 1 } RETURN r.r_name AS region, x AS nation", "SELECT r_name AS region, min(n_name) AS nation FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "A08_avg_distinct": ("MATCH (p:Part) RETURN p.p_brand AS brand, avg(DISTINCT p.p_size) AS mean, stdev(DISTINCT p.p_size) AS spread, stdevp(DISTINCT p.p_size) AS spread_all", "SELECT p_brand AS brand, avg(DISTINCT p_size) AS mean, stddev(DISTINCT p_size) AS spread, stddev_pop(DISTINCT p_size) AS spread_all FROM part GROUP BY 1"),
    "F21_end_properties": ("MATCH (c:Customer)-[r:IN_NATION]->(n) RETURN endNode(r).n_name AS nation, count(startNode(r).c_name) AS customers, max(startNode(r).c_acctbal) AS most", "SELECT n_name AS nation, count(c_name) AS customers, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "G07_variable_relationships": ("MATCH p = (a:Part {p_partkey: 3})-[:NEXT*1..3]->(b:Part) RETURN length(p) AS hops, [x IN relationships(p) | x.type] AS kinds, count(*) AS paths", _WALK.format(start="3", seed="", hi=3) + " SELECT d AS hops, list_transform(range(0, d), lambda i: 'NEXT') AS kinds, count(*) AS paths FROM r WHERE d >= 1 GROUP BY 1, 2"),
    "J15_count_block": ("MATCH (n:Nation) RETURN n.n_name AS n, COUNT { (n)<-[:IN_NATION]-(:Supplier) } AS k", "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation"),
    "J16_pattern_comprehension": ("MATCH (n:Nation) WITH n.n_name AS n, [(n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 0 | s.s_suppkey] AS ss RETURN n, size(ss) AS k, reduce(t = 0, x IN ss | t + x) AS total", "SELECT n_name AS n, count(s_suppkey) AS k, coalesce(sum(s_suppkey), 0)::BIGINT AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1"),
    "J17_call_block": ("MATCH (r:Region) CALL { WITH r MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN count(n) AS k, max(n.n_nationkey) AS m } RETURN r.r_name AS r, k, m", "SELECT r_name AS r, count(*) AS k, max(n_nationkey) AS m FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "J19_optional_branches": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(c:Customer) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS n, count(DISTINCT c) AS c, count(DISTINCT s) AS s", "SELECT n_name AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation"),
    "J20_edge_reuse": ("MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey GROUP BY 1"),
    # paths
    "G01_variable_length": ("MATCH (a:Part)-[:NEXT*1..3]->(b:Part) WHERE a.p_partkey <= 20 RETURN a.p_partkey AS a, b.p_partkey AS b, count(*) AS n", _WALK.format(start="p_partkey", seed=" FROM part WHERE p_partkey <= 20", hi=3) + " SELECT s AS a, e AS b, count(*) AS n FROM r WHERE d >= 1 GROUP BY 1, 2"),
    "G01_exact_length": ("MATCH (a:Part {p_partkey: 1})-[:NEXT*3]->(b:Part) RETURN b.p_partkey AS b, count(*) AS n", _WALK.format(start="1", seed="", hi=3) + " SELECT e AS b, count(*) AS n FROM r WHERE d = 3 GROUP BY 1"),
    "G02_zero_length": ("MATCH (a:Part {p_partkey: 4})-[:NEXT*0..2]->(b:Part) RETURN b.p_partkey AS b, count(*) AS n", _WALK.format(start="4", seed="", hi=2) + " SELECT e AS b, count(*) AS n FROM r GROUP BY 1"),
    "G03_incoming_walk": ("MATCH (a:Part {p_partkey: 9})<-[:NEXT*1..2]-(b:Part) RETURN b.p_partkey AS b, count(*) AS n", _WALK.format(start="9", seed="", hi=2).replace("SELECT p_partkey AS a, (p_partkey - 1 + k) % n + 1 AS b", "SELECT p_partkey AS b, (p_partkey - 1 + k) % n + 1 AS a") + " SELECT e AS b, count(*) AS n FROM r WHERE d >= 1 GROUP BY 1"),
    "G03_undirected_walk": ("MATCH (a:Part {p_partkey: 9})-[:NEXT*1..2]-(b:Part) RETURN b.p_partkey AS b, count(*) AS n", f"WITH RECURSIVE u AS (SELECT a, b FROM {NEXT} UNION ALL SELECT b, a FROM {NEXT} WHERE a <> b), r AS (SELECT 9 AS e, 0 AS d, [9] AS p UNION ALL SELECT b, d + 1, list_append(p, b) FROM r JOIN u ON u.a = r.e WHERE d < 2 AND (d = 0 OR NOT list_contains(p, b))) SELECT e AS b, count(*) AS n FROM r WHERE d >= 1 GROUP BY 1"),
    "G05_path_length": ("MATCH p = (a:Part {p_partkey: 2})-[:NEXT*1..3]->(b:Part) RETURN length(p) AS l, count(*) AS n", _WALK.format(start="2", seed="", hi=3) + " SELECT d::BIGINT AS l, count(*) AS n FROM r WHERE d >= 1 GROUP BY 1"),
    "G06_path_nodes": ("MATCH p = (a:Part {p_partkey: 2})-[:NEXT*2..2]->(b:Part) RETURN nodes(p)[1] AS via, last(nodes(p)) AS e", _WALK.format(start="2", seed="", hi=2) + " SELECT 'part:' || p[2] AS via, 'part:' || e AS e FROM r WHERE d = 2"),
    "G07_path_relationships": ("MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, size(relationships(p)) AS k, length(p) AS l", "SELECT n_name AS n, 1::BIGINT AS k, 1::BIGINT AS l FROM nation"),
    "G08_shortest_path": ("MATCH p = shortestPath((a:Part {p_partkey: 1})-[:NEXT*1..4]->(b:Part)) RETURN b.p_partkey AS b, length(p) AS l, count(*) AS n", _WALK.format(start="1", seed="", hi=4) + " SELECT e AS b, d::BIGINT AS l, count(*) AS n FROM r WHERE d >= 1 AND e <> s QUALIFY d = min(d) OVER (PARTITION BY e) GROUP BY 1, 2".replace("QUALIFY d = min(d) OVER (PARTITION BY e) GROUP BY 1, 2", "AND d = (SELECT min(d) FROM r q WHERE q.e = r.e AND q.d >= 1) GROUP BY 1, 2")),
    # aggregation
    "A03_count_star": ("MATCH (p:Part) RETURN p.p_brand AS b, count(*) AS n", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1"),
    "A05_count_distinct": ("MATCH (p:Part) RETURN count(DISTINCT p.p_brand) AS b, count(DISTINCT p) AS p", "SELECT count(DISTINCT p_brand) AS b, count(*) AS p FROM part"),
    "A06_collect": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.n_name WITH r.r_name AS r, collect(n.n_nationkey) AS ks RETURN r, size(ks) AS k, reduce(t = 0, x IN ks | t + x) AS total", "SELECT r_name AS r, count(*) AS k, sum(n_nationkey)::BIGINT AS total FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "A07_collect_distinct": ("MATCH (p:Part) RETURN size(collect(DISTINCT p.p_brand)) AS n", "SELECT count(DISTINCT p_brand) AS n FROM part"),
    "A08_sum_avg_min_max": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi, count(o.o_totalprice) AS n, round(avg(o.o_totalprice), 2) AS mean", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1"),
    "A09_collect_slice": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, size(collect(n.n_name)[0..3]) AS k, count(n) * 2 + 1 AS m", "SELECT r_name AS r, least(3, count(*)) AS k, count(*) * 2 + 1 AS m FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "A10_agg_then_pattern": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, count(c) AS k WHERE k > 2 AND (n)<-[:IN_NATION]-(:Supplier) RETURN n.n_name AS n, k", "SELECT n_name AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1 HAVING count(*) > 2"),
    "A11_nested": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n, count(c) AS k RETURN max(k) AS hi, min(k) AS lo, count(*) AS n", "SELECT max(k) AS hi, min(k) AS lo, count(*) AS n FROM (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1)"),
    "A12_collect_filter": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, size([x IN collect(n.n_nationkey) WHERE x > 10 | x * 2]) AS k", "SELECT r_name AS r, count(*) FILTER (n_nationkey > 10) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "A14_triples": ("MATCH (a:Nation)-[r]->(b) RETURN a.kind AS a, type(r) AS t, b.kind AS b, count(*) AS n", "SELECT 'Nation' AS a, 'IN_REGION' AS t, 'Region' AS b, count(*) AS n FROM nation"),
    "A18_percentage": ("MATCH (c:Customer) RETURN round(100.0 * sum(CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END) / count(*), 1) AS share", "SELECT round(100.0::DOUBLE * sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / count(*), 1) AS share FROM customer"),
    "A19_interaction": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, c.c_mktsegment AS m, count(*) AS n", "SELECT r_name AS r, c_mktsegment AS m, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    # order and limits
    "O01_order": ("MATCH (n:Nation) RETURN n.n_name AS n, n.n_regionkey AS r ORDER BY n.n_nationkey DESC, n LIMIT 7".replace("n.n_regionkey AS r", "n.n_nationkey % 5 AS r"), "SELECT n_name AS n, n_nationkey::BIGINT % 5 AS r FROM nation ORDER BY n_nationkey DESC LIMIT 7"),
    "O02_skip_limit": ("MATCH (p:Part) RETURN p.p_partkey AS k ORDER BY k SKIP 10 LIMIT $n", "SELECT p_partkey AS k FROM part ORDER BY 1 LIMIT 5 OFFSET 10", {"n": 5}),
    "O03_with_limit": ("MATCH (o:Order) WITH o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10 MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_name AS c, o.o_orderkey AS o", "SELECT c_name AS c, o_orderkey AS o FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) JOIN customer ON c_custkey = o_custkey"),
    # set operations
    "U01_union_all": ("MATCH (c:Customer) WHERE c.c_acctbal > 9000 RETURN c.c_name AS x UNION ALL MATCH (s:Supplier) RETURN s.s_name AS x", "SELECT c_name AS x FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name FROM supplier"),
    "U02_union": ("MATCH (p:Part) RETURN p.p_brand AS x UNION MATCH (p:Part) RETURN p.p_type AS x", "SELECT p_brand AS x FROM part UNION SELECT p_type FROM part"),
    "U03_mixed_union": ("RETURN 1 AS x UNION ALL RETURN 1 AS x UNION RETURN 2 AS x UNION ALL RETURN 2 AS x", "SELECT * FROM (VALUES (1::BIGINT), (2), (2)) t(x)"),
    # lists
    "L01_unwind": ("UNWIND [3, 1, 2] AS x UNWIND range(1, x) AS y RETURN x, y", "SELECT x, unnest(range(1, x + 1)) AS y FROM (VALUES (3::BIGINT), (1), (2)) t(x)"),
    "L02_unwound_maps": ("UNWIND [{a: 1, b: 'x'}, {a: 2, b: 'y'}] AS m RETURN m.a AS a, m['b'] AS b", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, 'y')) t(a, b)"),
    "L04_index": ("WITH [10, 20, 30] AS l RETURN l[0] AS a, l[-1] AS b, l[7] AS c", "SELECT 10::BIGINT AS a, 30::BIGINT AS b, NULL::BIGINT AS c"),
    "L05_slice": ("MATCH (p:Part) WITH p, split(p.p_name, ' ') AS w RETURN p.p_partkey AS k, size(w[1..3]) AS n, w[0..1][0] AS first", "SELECT p_partkey AS k, len(string_split(p_name, ' ')[2:3])::BIGINT AS n, string_split(p_name, ' ')[1] AS first FROM part"),
    "L06_concatenation": ("MATCH (r:Region) RETURN size([r.r_name] + ['x', 'y'] + 'z') AS n, head([1] + [2]) AS h", "SELECT 4::BIGINT AS n, 1::BIGINT AS h FROM region"),
    "L07_comprehension": ("MATCH (p:Part) RETURN p.p_partkey AS k, size([x IN range(1, 50) WHERE x % p.p_size = 0 | x * x]) AS n", "SELECT p_partkey AS k, len(list_filter(range(1, 51), lambda x: x % p_size = 0))::BIGINT AS n FROM part"),
    "L08_reduce": ("MATCH (p:Part) RETURN p.p_partkey AS k, reduce(t = 1, x IN [1, 2, 3] | t * 2 + x * p.p_size) AS v", "SELECT p_partkey AS k, ((2 + p_size) * 2 + 2 * p_size) * 2 + 3 * p_size::BIGINT AS v FROM part"),
    "L09_range": ("RETURN size(range(1, 10)) AS a, last(range(0, 10, 3)) AS b, size(range(5, 1)) AS c, head(range(5, 1, -2)) AS d", "SELECT 10::BIGINT AS a, 9::BIGINT AS b, 0::BIGINT AS c, 5::BIGINT AS d"),
    "L11_tail": ("MATCH (p:Part) RETURN p.p_partkey AS k, size(tail(split(p.p_name, ' '))) AS n, last(split(p.p_name, ' ')) AS l", "SELECT p_partkey AS k, len(string_split(p_name, ' '))::BIGINT - 1 AS n, string_split(p_name, ' ')[-1] AS l FROM part"),
    "L13_size": ("MATCH (p:Part) RETURN p.p_partkey AS k, size(p.p_name) AS a, size([1, 2]) AS b", "SELECT p_partkey AS k, length(p_name) AS a, 2::BIGINT AS b FROM part"),
    "L14_keys": ("MATCH (r:Region) UNWIND keys(r) AS k RETURN DISTINCT k", "SELECT * FROM (VALUES ('r_regionkey'), ('r_name')) t(k)"),
    "L15_properties": ("MATCH (r:Region) WITH properties(r) AS p RETURN p.r_name AS name", "SELECT r_name AS name FROM region"),
    "L17_empty": ("WITH [] AS l, [1] AS m RETURN l = [] AS a, m = [] AS b, size(l) AS n", "SELECT true AS a, false AS b, 0::BIGINT AS n"),
    # functions
    "F01_case": ("MATCH (p:Part) RETURN p.p_partkey AS k, toUpper(p.p_name) AS u, toLower(p.p_type) AS l", "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_type) AS l FROM part"),
    "F02_trim": ("RETURN trim('  a ') AS a, ltrim('  a ') AS b, rtrim('  a ') AS c", "SELECT 'a' AS a, 'a ' AS b, '  a' AS c"),
    "F03_left_right": ("MATCH (p:Part) RETURN p.p_partkey AS k, left(p.p_name, 3) AS l, right(p.p_name, 3) AS r", "SELECT p_partkey AS k, left(p_name, 3) AS l, right(p_name, 3) AS r FROM part"),
    "F04_substring": ("MATCH (p:Part) RETURN p.p_partkey AS k, substring(p.p_name, 2) AS a, substring(p.p_name, 1, 4) AS b", "SELECT p_partkey AS k, substring(p_name, 3) AS a, substring(p_name, 2, 4) AS b FROM part"),
    "F05_replace": ("MATCH (p:Part) RETURN p.p_partkey AS k, replace(p.p_name, 'o', '0') AS a", "SELECT p_partkey AS k, replace(p_name, 'o', '0') AS a FROM part"),
    "F06_split": ("MATCH (p:Part) RETURN p.p_partkey AS k, size(split(p.p_type, '.')) AS n, split(p.p_name, ' ')[0] AS a", "SELECT p_partkey AS k, len(string_split(p_type, '.'))::BIGINT AS n, string_split(p_name, ' ')[1] AS a FROM part"),
    "F07_reverse": ("MATCH (r:Region) RETURN reverse(r.r_name) AS x, length(r.r_name) AS n", "SELECT reverse(r_name) AS x, length(r_name) AS n FROM region"),
    "F09_conversions": ("MATCH (p:Part) RETURN p.p_partkey AS k, toString(p.p_size) AS s, toInteger('12') AS i, toInteger('junk') AS j, toFloat('1.5') AS f, toBoolean('true') AS b, toBoolean('x') AS c", "SELECT p_partkey AS k, p_size::VARCHAR AS s, 12::BIGINT AS i, NULL::BIGINT AS j, 1.5::DOUBLE AS f, true AS b, NULL::BOOLEAN AS c FROM part"),
    "F13_coalesce": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS n, coalesce(s.s_name, 'none') AS s", "SELECT n_name AS n, coalesce(s_name, 'none') AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "F14_rounding": ("MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS c, floor(c.c_acctbal) AS f", "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer"),
    "F15_roots": ("MATCH (p:Part) RETURN p.p_partkey AS k, sqrt(p.p_size) AS s, p.p_size ^ 2 AS q", "SELECT p_partkey AS k, sqrt(p_size) AS s, pow(p_size, 2) AS q FROM part"),
    "F16_arithmetic": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 7 AS d, p.p_size % 7 AS m, p.p_size / 0 AS z, p.p_size % 0 AS y, -p.p_size AS n, p.p_name + '!' AS s, p.p_size * 1.5 AS f", "SELECT p_partkey AS k, p_size::BIGINT // 7 AS d, p_size::BIGINT % 7 AS m, NULL::BIGINT AS z, NULL::BIGINT AS y, -p_size AS n, p_name || '!' AS s, p_size * 1.5::DOUBLE AS f FROM part"),
    "F17_ids": ("MATCH (r:Region) RETURN id(r) AS a, elementId(r) AS b", "SELECT 'region:' || r_regionkey AS a, 'region:' || r_regionkey AS b FROM region"),
    "F18_labels": ("MATCH (x:Supplier) RETURN size(labels(x)) AS n, labels(x)[0] AS k, labels(x)[1] AS l", "SELECT 2::BIGINT AS n, 'Supplier' AS k, 'Party' AS l FROM supplier"),
    "F23_passthrough": ("MATCH (r:Region) RETURN instr(r.r_name, 'A') AS i, nullif(r.r_name, 'ASIA') AS n, levenshtein(r.r_name, 'ASIA') AS d", "SELECT instr(r_name, 'A')::INT AS i, nullif(r_name, 'ASIA') AS n, levenshtein(r_name, 'ASIA')::INT AS d FROM region"),
}


def _cypher(text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(graph_from_tables(spark, sf_dir), text, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from graphloom import catalog_code, catalog_views
    from graphloom.catalog_operations import OPERATIONS

    return catalog_code.queries() | catalog_views.queries() | {k: _cypher(v[0], v[2] if len(v) > 2 else {}) for k, v in CYPHER.items()} | {k: v[0] for k, v in OPERATIONS.items()}


def oracle_sql() -> dict[str, str]:
    from graphloom import catalog_code, catalog_views
    from graphloom.catalog_operations import OPERATIONS

    return catalog_code.oracle_sql() | catalog_views.oracle_sql() | {k: v[1] for k, v in CYPHER.items()} | {k: v[1] for k, v in OPERATIONS.items() if v[1]}
