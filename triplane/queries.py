"""The queries registered for the engine's operators, each with the SQL that it is checked against.

Names follow the operators. Programs and query texts go through the parsers and the planner; the rest
call the operators. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import evaluate, linking, profile
from .operators.paths import closure
from .plans import templates as T
from .plans.catalog import PROPERTY_NAMES, statement_graph, trade_graph
from .runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_HUB, _RIVER, _PERSON = 7000003, 6000001, 6000006
_BELOW = "WITH RECURSIVE d(n) AS (SELECT {c}::BIGINT UNION SELECT e.s FROM edges e JOIN d ON e.v = d.n WHERE e.pid = 'P279') "
_IN = "s IN (SELECT e.s FROM edges e JOIN d ON e.v = d.n WHERE e.pid = 'P31')"
_PAIRS = "WITH RECURSIVE c(s, v) AS (SELECT s, v FROM edges WHERE pid = 'P279' AND v IS NOT NULL UNION SELECT c.s, e.v FROM c JOIN edges e ON e.s = c.v WHERE e.pid = 'P279' AND e.v IS NOT NULL) "
_CUST = "SELECT 120000000 + c_custkey AS s, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS n FROM customer"
_PARTY = "(SELECT 120000000 + c_custkey AS s, c_acctbal AS bal, c_nationkey AS n FROM customer UNION ALL SELECT 110000000 + s_suppkey, s_acctbal, s_nationkey FROM supplier)"
_LINES = "(SELECT 140000000 + l_orderkey AS s, 130000000 + l_partkey AS v, l_quantity AS qty, l_extendedprice AS price, l_shipdate AS ship, 110000000 + l_suppkey AS supp, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS ended FROM lineitem)"
_ACT = "(SELECT 160000000 + user_id AS s, event_type AS v, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id, event_type)"


def q(n: str) -> str:
    return f"'Q' || CAST({n} AS VARCHAR)"


def trade(name: str, program: str, sql: str, strict: bool = True) -> None:
    QUERIES[name] = lambda spark, d: T.run_tt(trade_graph(spark, d), program, strict)
    ORACLE_SQL[name] = sql


def kg(name: str, program: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: T.run_tt(statement_graph(spark, d), program)
    ORACLE_SQL[name] = sql


def kgs(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: T.run_sparql(statement_graph(spark, d), text)
    ORACLE_SQL[name] = sql


def trades(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: T.run_sparql(trade_graph(spark, d), text)
    ORACLE_SQL[name] = sql


def call(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def result(v: str, source: str, where: str = "TRUE", name: str = "x1", distinct: str = "DISTINCT") -> str:
    return f"SELECT {distinct} {q(v)} AS {name} FROM {source} WHERE {where}"


# Scans, entity constants, triple patterns

trade("located_with_number", '@wd . customer ( ) filter contains ( located_in , " Q101003 " ^^wd:region ) && balance >= 5000 ;',
      result("s", f"({_CUST}) JOIN nation ON n_nationkey = n", "n_regionkey = 3 AND bal > 5000"))
trade("domain_scan", "@wd . party ( ) ;", result("s", _PARTY))
trade("domain_scan_all", "@wd . thing ( ) ;", result("s", f"(SELECT s FROM {_PARTY} UNION ALL SELECT 130000000 + p_partkey FROM part UNION ALL SELECT 102000 + n_nationkey FROM nation UNION ALL SELECT 101000 + r_regionkey FROM region)"))
kg("entity_scan", f'[ location ] of @wd . entity ( ) filter id == " Q{_HUB} " ^^wd:entity ;', result("v", "edges", f"pid = 'P9001' AND s = {_HUB} AND v IS NOT NULL", "v2"))
kgs("triple_scan", "SELECT DISTINCT ?s ?o WHERE { ?s wdt:P9101 ?o }", f"SELECT DISTINCT {q('s')} AS s, {q('v')} AS o FROM edges WHERE pid = 'P9101' AND v IS NOT NULL")
kgs("triple_scan_object", f"SELECT DISTINCT ?s WHERE {{ ?s wdt:P9001 wd:Q{_HUB} }}", result("s", "edges", f"pid = 'P9001' AND v = {_HUB}", "s"))
kgs("values_inline", f"SELECT DISTINCT ?x ?v WHERE {{ VALUES ?v {{ wd:Q{_HUB} wd:Q7000001 wd:Q7000005 }} ?x wdt:P9001 ?v }}", f"SELECT DISTINCT {q('s')} AS x, {q('v')} AS v FROM edges WHERE pid = 'P9001' AND v IN ({_HUB}, 7000001, 7000005)")

# Projection

trade("project_property", "[ country ] of @wd . supplier ( ) ;", result("102000 + s_nationkey", "supplier", name="v2"))
trade("project_id", '[ id ] of @wd . customer ( ) filter balance >= 9000 ;', result("s", f"({_CUST})", "bal > 9000"))
trade("project_multi", "[ country , ordered_by ] of @wd . entity ( ) filter balance >= 0 ;", result("102000 + n", _PARTY, "bal > 0", "v3"))
trade("project_path", "[ < ordered_by / country > ] of @wd . order ( ) filter total >= 200000 ;", result("102000 + c_nationkey", "orders JOIN customer ON o_custkey = c_custkey", "o_totalprice > 200000", "v3"))
trade("typed_projection", "[ located_in : Entity ( wd:region ) ] of @wd . supplier ( ) ;", result("101000 + n_regionkey", "supplier JOIN nation ON s_nationkey = n_nationkey", name="v2"))
trade("qualifier_projection", "[ has_part . supplied_by ] of @wd . order ( ) filter total >= 300000 ;", result("supp", f"{_LINES} JOIN orders ON s = 140000000 + o_orderkey", "o_totalprice > 300000", "v3"))
trade("qualified_value", "[ has_part filter quantity >= 49 ] of @wd . order ( ) ;", result("v", _LINES + " JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o", "qty > 49", "v2"))
trade("qualifier_of_value", '[ supplied_by of ( has_part filter value == " Q130000007 " ^^wd:part ) ] of @wd . order ( ) ;', result("supp", _LINES + " JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o", "v = 130000007", "v2"))
trade("qualified_value_subquery", "[ has_part filter value == any ( @wd . part ( ) filter size >= 49 ) ] of @wd . order ( ) filter total >= 250000 ;",
      result("v", f"{_LINES} JOIN orders ON s = 140000000 + o_orderkey JOIN part ON v = 130000000 + p_partkey", "o_totalprice > 250000 AND p_size > 49", "v3"))
kg("abstract_any", f"[ origin ] of @wd . human ( ) ;", _BELOW.format(c=_PERSON) + f", t AS (SELECT s, v, CASE pid WHEN 'P9101' THEN 0 WHEN 'P9123' THEN 1 ELSE 2 END AS r FROM edges WHERE pid IN ('P9101', 'P9123', 'P9102') AND v IS NOT NULL) SELECT DISTINCT {q('v')} AS v2 FROM t WHERE {_IN} AND r = (SELECT min(r) FROM t u WHERE u.s = t.s)")
kg("abstract_all", "[ kin ] of @wd . human ( ) ;", _BELOW.format(c=_PERSON) + result("v", "edges", f"pid IN ('P9103', 'P9129') AND v IS NOT NULL AND {_IN}", "v2"))
kg("abstract_filter", f'@wd . entity ( ) filter contains ( kin , " Q{_HUB} " ^^wd:entity ) ;', result("s", "edges", f"pid IN ('P9103', 'P9129') AND v = {_HUB}"))
kgs("label_projection", "SELECT DISTINCT ?l WHERE { ?x wdt:P9001 ?v . ?v rdfs:label ?l }", "SELECT DISTINCT label AS l FROM entities WHERE id IN (SELECT 'Q' || CAST(v AS VARCHAR) FROM edges WHERE pid = 'P9001')")

# Filters

trade("filter_entity", '@wd . customer ( ) filter contains ( country , " Q102007 " ^^wd:nation ) ;', result("s", f"({_CUST})", "n = 7"))
trade("filter_number_strict", "@wd . customer ( ) filter balance >= 5000 && balance <= 6000 ;", result("s", f"({_CUST})", "bal > 5000 AND bal < 6000"))
trade("filter_number_literal", "@wd . part ( ) filter size >= 10 && size <= 12 ;", result("130000000 + p_partkey", "part", "p_size BETWEEN 10 AND 12"), strict=False)
trade("filter_number_equal", "@wd . part ( ) filter size == 7 ;", result("130000000 + p_partkey", "part", "p_size = 7"))
trade("filter_date", "@wd . order ( ) filter point_in_time >= new Date ( 1997 , 6 , 1 ) ;", result("140000000 + o_orderkey", "orders", "o_orderdate > TIMESTAMP '1997-06-01'"))
trade("year_point", "@wd . order ( ) filter point_in_time == new Date ( 1996 ) ;", result("140000000 + o_orderkey", "orders", "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'"))
kg("year_overlap", "[ founder filter point_in_time == new Date ( 1900 ) ] of @wd . entity ( ) ;", result("v", "edges", "pid = 'P9101' AND v IS NOT NULL AND q_start <= TIMESTAMP '1901-01-01' AND q_end >= TIMESTAMP '1900-01-01'", "v2"))
trade("filter_string", '@wd . customer ( ) filter segment =~ "BUILDING" ;', result("s", f"({_CUST})", "seg = 'BUILDING'"))
kg("label_equals", '@wd . entity ( ) filter contains~ ( location , "Volafanjel" ) ;', result("s", "edges JOIN entities ON id = 'Q' || CAST(v AS VARCHAR)", "pid = 'P9001' AND lower(label) = 'volafanjel'"))
trade("label_ilike", '@wd . customer ( ) filter id =~ "Customer#000000007" ;', result("120000000 + c_custkey", "customer", "lower(c_name) = 'customer#000000007'"))
trade("enum_filter", '@wd . order ( ) filter priority =~ "1-URGENT" && total >= 100000 ;', result("140000000 + o_orderkey", "orders", "o_orderpriority = '1-URGENT' AND o_totalprice > 100000"))
trade("exists_property", "@wd . entity ( ) filter ! ( ordered_by == null ) ;", result("140000000 + o_orderkey", "orders"))
trade("missing_property", "@wd . customer ( ) filter in_array ( id , any ( @wd . customer ( ) ) ) && supplied_by == null ;", result("s", f"({_CUST})"))
kgs("bound_optional", "SELECT DISTINCT ?x WHERE { ?x wdt:P9101 ?v . OPTIONAL { ?x wdt:P9001 ?l } FILTER(!bound(?l)) }", result("s", "edges", "pid = 'P9101' AND v IS NOT NULL AND s NOT IN (SELECT s FROM edges WHERE pid = 'P9001' AND v IS NOT NULL)", "x"))
trade("and_filters", '@wd . customer ( ) filter contains ( country , " Q102007 " ^^wd:nation ) && balance >= 0 && segment =~ "MACHINERY" ;', result("s", f"({_CUST})", "n = 7 AND bal > 0 AND seg = 'MACHINERY'"))
trade("or_union", '@wd . customer ( ) filter ( contains ( country , " Q102007 " ^^wd:nation ) || balance >= 9500 ) ;', result("s", f"({_CUST})", "n = 7 OR bal > 9500"))
trade("or_of_ands", '@wd . customer ( ) filter ( contains ( country , " Q102001 " ^^wd:nation ) && balance >= 1000 || contains ( country , " Q102002 " ^^wd:nation ) && balance <= 0 ) ;', result("s", f"({_CUST})", "n = 1 AND bal > 1000 OR n = 2 AND bal < 0"))
trade("not_filter", "@wd . customer ( ) filter ! balance >= 0 ;", result("s", f"({_CUST})", "NOT bal > 0"))
trade("not_membership", '@wd . customer ( ) filter ! contains ( country , " Q102007 " ^^wd:nation ) && balance >= 9000 ;', result("s", f"({_CUST})", "n <> 7 AND bal > 9000"))
trade("path_filter", '@wd . order ( ) filter contains ( < ordered_by / located_in + > , " Q101002 " ^^wd:region ) && total >= 250000 ;', result("140000000 + o_orderkey", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "n_regionkey = 2 AND o_totalprice > 250000"))
trade("qualified_filter", '@wd . order ( ) filter contains ( has_part filter quantity >= 45 , " Q130000005 " ^^wd:part ) ;', result("s", _LINES + " JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o", "v = 130000005 AND qty > 45"))
trade("flat_qualifier", "@wd . order ( ) filter has_part . price >= 90000 ;", result("s", _LINES + " JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o", "price > 90000"))
trade("not_exists_qualifier", "[ has_part filter end_time == null && quantity >= 49 ] of @wd . order ( ) ;", result("v", _LINES + " JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o", "ended IS NULL AND qty > 49", "v2"))
kgs("string_functions", 'SELECT DISTINCT ?l WHERE { ?x rdfs:label ?l . FILTER(STRSTARTS(LCASE(STR(?l)), "lake")) }', "SELECT DISTINCT label AS l FROM entities WHERE lower(label) LIKE 'lake%'")
kgs("regex_label", 'SELECT DISTINCT ?l WHERE { ?x rdfs:label ?l . FILTER(regex(?l, "^the .* quartet$", "i")) }', "SELECT DISTINCT label AS l FROM entities WHERE regexp_matches(label, '^the .* quartet$', 'i')")
trades("year_function", "SELECT DISTINCT ?x WHERE { ?x wdt:P585 ?d . FILTER(YEAR(?d) = 1995) }", result("140000000 + o_orderkey", "orders", "year(o_orderdate) = 1995", "x"))

# Joins and subqueries

trades("bgp_join", "SELECT DISTINCT ?o ?n WHERE { ?o wdt:P8005 ?c . ?c wdt:P17 ?n . ?o wdt:P8002 ?t . FILTER(?t > 300000) }", f"SELECT DISTINCT {q('140000000 + o_orderkey')} AS o, {q('102000 + c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
trade("subquery_in", "@wd . order ( ) filter in_array ( ordered_by , any ( @wd . customer ( ) filter balance >= 9000 ) ) ;", result("140000000 + o_orderkey", "orders JOIN customer ON o_custkey = c_custkey", "c_acctbal > 9000"))
trade("subquery_reverse", "@wd . customer ( ) filter in_array ( id , any ( [ ordered_by ] of @wd . order ( ) filter total >= 300000 ) ) ;", result("120000000 + o_custkey", "orders", "o_totalprice > 300000"))
trade("subquery_theta", '@wd . customer ( ) filter balance >= any ( [ balance ] of @wd . customer ( ) filter contains ( country , " Q102003 " ^^wd:nation ) && balance >= 9000 ) ;', result("s", f"({_CUST})", "bal > (SELECT min(c_acctbal) FROM customer WHERE c_nationkey = 3 AND c_acctbal > 9000)"))
kgs("interval_join", "SELECT DISTINCT ?a ?b WHERE { ?a p:P9101 ?s . ?s ps:P9101 ?v ; pq:P580 ?t ; pq:P582 ?u . ?b p:P9102 ?r . ?r ps:P9102 ?v ; pq:P580 ?y . FILTER(?y >= ?t && ?y <= ?u) }",
    f"SELECT DISTINCT {q('x.s')} AS a, {q('y.s')} AS b FROM edges x JOIN edges y ON x.v = y.v WHERE x.pid = 'P9101' AND y.pid = 'P9102' AND y.q_start BETWEEN x.q_start AND x.q_end")
kgs("optional_join", "SELECT DISTINCT ?x ?l WHERE { ?x wdt:P9105 ?v . OPTIONAL { ?x wdt:P9001 ?l } }", f"SELECT DISTINCT {q('a.s')} AS x, {q('b.v')} AS l FROM edges a LEFT JOIN edges b ON a.s = b.s AND b.pid = 'P9001' AND b.v IS NOT NULL WHERE a.pid = 'P9105' AND a.v IS NOT NULL")
kgs("coalesce_bind", "SELECT DISTINCT ?x ?y WHERE { ?x wdt:P31 wd:Q6000006 . OPTIONAL { ?x wdt:P9101 ?a } OPTIONAL { ?x wdt:P9102 ?b } BIND(COALESCE(?a, ?b) AS ?y) FILTER(bound(?y)) }",
    f"SELECT DISTINCT {q('i.s')} AS x, {q('coalesce(a.v, b.v)')} AS y FROM edges i LEFT JOIN edges a ON a.s = i.s AND a.pid = 'P9101' AND a.v IS NOT NULL LEFT JOIN edges b ON b.s = i.s AND b.pid = 'P9102' AND b.v IS NOT NULL WHERE i.pid = 'P31' AND i.v = 6000006 AND coalesce(a.v, b.v) IS NOT NULL")
kgs("not_exists_group", "SELECT DISTINCT ?x WHERE { ?x wdt:P9101 ?v . FILTER NOT EXISTS { ?x wdt:P31 ?c } }", result("s", "edges", "pid = 'P9101' AND v IS NOT NULL AND s NOT IN (SELECT s FROM edges WHERE pid = 'P31' AND v IS NOT NULL)", "x"))
kgs("sub_select", "SELECT DISTINCT ?x ?v WHERE { ?x wdt:P9001 ?v . { SELECT ?v WHERE { ?v wdt:P31 wd:Q6000001 } } }", f"SELECT DISTINCT {q('s')} AS x, {q('v')} AS v FROM edges WHERE pid = 'P9001' AND v IN (SELECT s FROM edges WHERE pid = 'P31' AND v = 6000001)")
kgs("union_groups", f"SELECT DISTINCT ?x WHERE {{ {{ ?x wdt:P9101 wd:Q{_HUB} }} UNION {{ ?x wdt:P9102 wd:Q{_HUB} }} UNION {{ ?x wdt:P9103 wd:Q{_HUB} }} }}", result("s", "edges", f"pid IN ('P9101', 'P9102', 'P9103') AND v = {_HUB}", "x"))
kgs("statement_join", "SELECT DISTINCT ?x ?v ?t WHERE { ?x p:P9101 ?s . ?s ps:P9101 ?v . ?s pq:P580 ?t }", f"SELECT DISTINCT {q('s')} AS x, {q('v')} AS v, q_start AS t FROM edges WHERE pid = 'P9101' AND v IS NOT NULL AND q_start IS NOT NULL")

# Property paths

kgs("path_sequence", "SELECT DISTINCT ?x ?y WHERE { ?x wdt:P9101/wdt:P9001 ?y }", f"SELECT DISTINCT {q('a.s')} AS x, {q('b.v')} AS y FROM edges a JOIN edges b ON a.v = b.s WHERE a.pid = 'P9101' AND b.pid = 'P9001' AND b.v IS NOT NULL")
kgs("path_alternation", "SELECT DISTINCT ?x ?y WHERE { ?x wdt:P9109|wdt:P9108 ?y }", f"SELECT DISTINCT {q('s')} AS x, {q('v')} AS y FROM edges WHERE pid IN ('P9109', 'P9108') AND v IS NOT NULL")
kgs("closure_up", "SELECT DISTINCT ?c WHERE { wd:Q6000359 wdt:P279+ ?c }", _PAIRS + result("v", "c", "s = 6000359", "c"))
kgs("closure_down", f"SELECT DISTINCT ?c WHERE {{ ?c wdt:P279* wd:Q6000001 }}", _BELOW.format(c=6000001) + result("n", "d", name="c"))
kgs("immediate_parents", "SELECT DISTINCT ?c WHERE { wd:Q6000359 wdt:P279 ?c }", result("v", "edges", "pid = 'P279' AND s = 6000359 AND v IS NOT NULL", "c"))
kgs("instance_of_subclass", "SELECT DISTINCT ?x WHERE { ?x wdt:P31/wdt:P279* wd:Q6000001 }", _BELOW.format(c=6000001) + result("s", "edges", f"pid = 'P31' AND {_IN}", "x"))
kgs("inverse_path", f"SELECT DISTINCT ?x WHERE {{ wd:Q{_HUB} ^wdt:P9001 ?x }}", result("s", "edges", f"pid = 'P9001' AND v = {_HUB}", "x"))
trade("located_in_transitive", '@wd . entity ( ) filter contains ( located_in , " Q101001 " ^^wd:region ) ;', result("x", f"(SELECT s AS x FROM {_PARTY} JOIN nation ON n = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 102000 + n_nationkey FROM nation WHERE n_regionkey = 1)"))
kgs("qualifier_path", "SELECT DISTINCT ?x ?c WHERE { ?x p:P9101 ?s . ?s ps:P9101/wdt:P31 ?c }", f"SELECT DISTINCT {q('a.s')} AS x, {q('b.v')} AS c FROM edges a JOIN edges b ON a.v = b.s WHERE a.pid = 'P9101' AND b.pid = 'P31' AND b.v IS NOT NULL")


@call("closure_pairs", _PAIRS + "SELECT s, v FROM c")
def closure_pairs(spark, d):
    return closure(statement_graph(spark, d).edges("P279"))


@call("closure_reflexive", _PAIRS + "SELECT s, v FROM c UNION SELECT s, s FROM edges WHERE pid = 'P279' AND v IS NOT NULL UNION SELECT v, v FROM edges WHERE pid = 'P279' AND v IS NOT NULL")
def closure_reflexive(spark, d):
    return closure(statement_graph(spark, d).edges("P279"), zero=True)


# Aggregation, order, slices

kg("count_entities", "count ( @wd . river ( ) ) ;", _BELOW.format(c=6000001) + f"SELECT count(DISTINCT s) AS count FROM edges WHERE pid = 'P31' AND {_IN}")
trade("count_values", "count ( country of @wd . customer ( ) ) ;", "SELECT count(DISTINCT c_nationkey) AS count FROM customer")
for _op in ("sum", "avg", "min", "max"):
    trade(f"{_op}_values", f"{_op} ( size of @wd . part ( ) ) ;", f"SELECT {_op}(p_size::DOUBLE) AS {_op} FROM part")
trade("having_count", "@wd . order ( ) filter count ( has_part ) >= 5 ;", f"SELECT {q('s')} AS x1 FROM {_LINES} JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o GROUP BY s HAVING count(*) > 5")
trade("count_ge1_is_exists", "@wd . entity ( ) filter count ( ordered_by ) >= 1 ;", result("140000000 + o_orderkey", "orders"))
kgs("having_two", "SELECT DISTINCT ?x WHERE { ?x wdt:P31 ?c . ?x wdt:P9001 ?l } GROUP BY ?x HAVING(COUNT(?l) > 1 && COUNT(?c) < 9)", f"SELECT {q('a.s')} AS x FROM edges a JOIN edges b ON a.s = b.s WHERE a.pid = 'P31' AND b.pid = 'P9001' AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.s HAVING count(*) > 1 AND count(*) < 9")
trade("group_count", "count ( @wd . order ( ) ) by priority ;", "SELECT o_orderpriority AS v2, count(DISTINCT o_orderkey) AS count FROM orders GROUP BY 1")
trade("group_threshold", "count ( @wd . customer ( ) ) by country filter count >= 55 ;", f"SELECT {q('102000 + c_nationkey')} AS v2, count(DISTINCT c_custkey) AS count FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey) > 55")
trade("group_count_top1", "sort ( count desc of count ( @wd . customer ( ) ) by country ) [ 1 ] ;", f"SELECT {q('102000 + c_nationkey')} AS v2 FROM customer GROUP BY c_nationkey ORDER BY count(DISTINCT c_custkey) DESC, c_nationkey LIMIT 1")
trade("sort_by_count", "sort ( count ( has_part ) desc of @wd . order ( ) ) [ 1 : 10 ] ;", f"SELECT {q('s')} AS x1 FROM (SELECT s, count(*) AS n FROM {_LINES} JOIN (SELECT DISTINCT 140000000 + o_orderkey AS o FROM orders) ON s = o GROUP BY s ORDER BY n DESC, s LIMIT 10)")
trade("sort_all", "sort ( balance asc of @wd . supplier ( ) ) ;", result("110000000 + s_suppkey", "supplier"))
trade("sort_top1", "sort ( balance desc of @wd . customer ( ) ) [ 1 ] ;", f"SELECT {q('s')} AS x1 FROM ({_CUST}) ORDER BY bal DESC, s LIMIT 1")
trade("index_n", "sort ( price desc of @wd . part ( ) ) [ 5 ] ;", f"SELECT {q('p')} AS x1 FROM (SELECT 130000000 + p_partkey AS p, p_retailprice FROM part ORDER BY p_retailprice DESC, p LIMIT 1 OFFSET 4)")
trade("slice_a_b", "sort ( total desc of @wd . order ( ) ) [ 3 : 12 ] ;", f"SELECT {q('o')} AS x1 FROM (SELECT 140000000 + o_orderkey AS o, o_totalprice FROM orders ORDER BY o_totalprice DESC, o LIMIT 10 OFFSET 2)")
trade("distinct_order_hidden", "[ country ] of sort ( balance desc of @wd . customer ( ) ) [ 1 : 5 ] ;", f"SELECT {q('102000 + n')} AS v3 FROM (SELECT c_nationkey AS n, max(c_acctbal) AS b FROM customer GROUP BY c_nationkey ORDER BY b DESC, n LIMIT 5)")
kg("sort_by_qualifier", "sort ( founder . start_time asc of @wd . entity ( ) filter ! ( founder == null ) ) [ 1 : 7 ] ;", f"SELECT {q('s')} AS x1 FROM (SELECT s, min(q_start) AS t FROM edges WHERE pid = 'P9101' AND v IS NOT NULL AND q_start IS NOT NULL GROUP BY s ORDER BY t, s LIMIT 7)")
kgs("minmax_top1", "SELECT DISTINCT ?t WHERE { ?x p:P9101 ?s . ?s ps:P9101 ?v . ?s pq:P580 ?t } ORDER BY ?t LIMIT 1", "SELECT min(q_start) AS t FROM edges WHERE pid = 'P9101' AND v IS NOT NULL")

# Yes or no

trade("ask_entity", '[ contains ( country , " Q102007 " ^^wd:nation ) ] of @wd . customer ( ) filter id == " Q120000001 " ^^wd:customer ;', "SELECT count(*) > 0 AS answer FROM customer WHERE c_custkey = 1 AND c_nationkey = 7")
trade("ask_any", "[ count >= 1 ] of count ( @wd . customer ( ) filter balance >= 9999 ) ;", "SELECT count(*) > 0 AS answer FROM customer WHERE c_acctbal > 9999")
trade("ask_compare", '[ balance >= any ( [ balance ] of @wd . customer ( ) filter id == " Q120000002 " ^^wd:customer ) ] of @wd . customer ( ) filter id == " Q120000003 " ^^wd:customer ;', "SELECT (SELECT c_acctbal FROM customer WHERE c_custkey = 3) > (SELECT c_acctbal FROM customer WHERE c_custkey = 2) AS answer")
kgs("ask_path", "ASK WHERE { wd:Q6000359 wdt:P279* wd:Q6000001 }", _BELOW.format(c=6000001) + "SELECT count(*) > 0 AS answer FROM d WHERE n = 6000359")
kgs("ask_reflexive", "ASK WHERE { wd:Q42 wdt:P279* wd:Q42 }", "SELECT TRUE AS answer")


# Templates


def kgt(name: str, template: str, sql: str, year: int | None = None, **parameters) -> None:
    QUERIES[name] = lambda spark, d: T.template(statement_graph(spark, d), template, year, **parameters)
    ORACLE_SQL[name] = sql


_F = "edges WHERE pid = 'P9101' AND v IS NOT NULL"
kgt("template_current_holders", "current_holders", result("s", "edges", f"pid = 'P9130' AND v = {_HUB} AND q_end IS NULL", "x"), p="P9130", q0=_HUB)
kgt("template_current_holders_in", "current_holders_in", result("a.s", "edges a JOIN edges b ON a.v = b.s", f"a.pid = 'P9101' AND a.q_end IS NULL AND b.pid = 'P9001' AND b.v = {_HUB}", "x"), p="P9101", q="P9001", q0=_HUB)
kgt("template_holders_in_year", "holders_in_year", result("s", "edges", f"pid = 'P9001' AND v = {_HUB} AND q_start < TIMESTAMP '1901-01-01' AND q_end >= TIMESTAMP '1900-01-01'", "x"), 1900, p="P9001", q0=_HUB)
kgt("template_first_time", "first_time", f"SELECT min(q_start) AS y FROM edges WHERE pid = 'P9001' AND v = {_HUB} HAVING min(q_start) IS NOT NULL", p="P9001", q0=_HUB)
kgt("template_last_time", "last_time", f"SELECT max(q_end) AS y FROM edges WHERE pid = 'P9001' AND v = {_HUB} HAVING max(q_end) IS NOT NULL", p="P9001", q0=_HUB)
kgt("template_statement_of_instance", "statement_of_instance", _BELOW.format(c=_RIVER) + result("v", "edges", f"pid = 'P9101' AND v IS NOT NULL AND {_IN}", "x"), p="P9101", q1=_RIVER)
kgt("template_same_start", "same_start", f"SELECT DISTINCT {q('b.s')} AS x FROM edges a JOIN edges b ON a.q_start = b.q_start WHERE a.pid = 'P31' AND b.pid = 'P31' AND a.s = 10000001 AND a.v IS NOT NULL AND b.v IS NOT NULL", p="P31", q0=10000001)


@call("template_describe", "SELECT id, domain_name || ' of the graph' AS text FROM entities WHERE id = 'Q7000003'")
def template_describe(spark, d):
    return T.describe(statement_graph(spark, d), _HUB)


# Numbered patterns


def pattern(number: int, sql: str, year: int | None = None, graph=trade_graph, **parameters) -> None:
    QUERIES[f"pattern_{number:02}"] = lambda spark, d: T.pattern(graph(spark, d), number, year, **parameters)
    ORACLE_SQL[f"pattern_{number:02}"] = sql


def first(v: str, source: str, where: str, by: str, name: str = "x", desc: bool = False, n: int = 1, entity: bool = True) -> str:
    """The entity or value v of the least or greatest `by`, the smaller one on a tie."""
    best = f"SELECT v FROM (SELECT {v} AS v, {'max' if desc else 'min'}({by}) AS b FROM {source} WHERE {where} GROUP BY 1) ORDER BY b{' DESC' if desc else ''}, v LIMIT 1 OFFSET {n - 1}"
    return f"SELECT {q('v') if entity else 'v'} AS {name} FROM ({best})"


_L = f"{_LINES} l"
_ON, _PART, _CUSTOMER = 140000000, 130000000, 120000000
_SUPPLIED = f"{_LINES} l JOIN supplier ON supp = 110000000 + s_suppkey"
_ORDERED = f"{_LINES} l JOIN orders ON s = 140000000 + o_orderkey"
_DATES = {"s": "P585", "e": "P582"}
_HELD = "edges WHERE pid = 'P9001' AND v IS NOT NULL"

pattern(1, "SELECT id, domain_name || ' of the graph' AS text FROM entities WHERE id = 'Q7000001'", graph=statement_graph, q0=7000001)
pattern(2, result("s", _SUPPLIED, f"v = {_PART + 861} AND s_nationkey = 9 AND ended IS NULL", "x"), p="P527", q="P176", r="P17", a=_PART + 861, q0=102009)
pattern(3, result("s", _SUPPLIED, f"v = {_PART + 184} AND s_nationkey = 16 AND ended IS NULL", "x"), p="P527", q="P176", r="P17", a=_PART + 184, q0=102016)
pattern(4, result("s", _SUPPLIED, f"v = {_PART + 162} AND s_nationkey = 19 AND ship < TIMESTAMP '1998-01-01' AND ended >= TIMESTAMP '1997-01-01'", "x"), 1997, p="P527", q="P176", r="P17", a=_PART + 162, q0=102019, **_DATES)
pattern(5, result("102000 + s_nationkey", _SUPPLIED, f"s = {_ON + 3710} AND v = {_PART + 228}", "v"), p="P527", q="P176", r="P17", a=_PART + 228, q0=_ON + 3710)
pattern(6, f"SELECT min(ship) AS y FROM {_L} WHERE s = {_ON + 3710} HAVING min(ship) IS NOT NULL", p="P527", q="P31", q0=_ON + 3710, q1=903, **_DATES)
pattern(7, f"SELECT max(ended) AS y FROM {_L} WHERE s = {_ON + 3710} HAVING max(ended) IS NOT NULL", p="P527", q="P31", q0=_ON + 3710, q1=903, **_DATES)
pattern(8, result("a.s", f"{_LINES} a JOIN {_LINES} c ON a.ship = c.ship", f"a.v = {_PART + 991} AND c.s = {_ON + 1} AND c.v = {_PART + 1907}", "x"), p="P527", s="P585", a=_PART + 1907, b=_PART + 991, q0=_ON + 1)
pattern(9, result("v", _L, f"s = {_ON + 3710} AND v IN (SELECT 130000000 + p_partkey FROM part)", "v"), p="P527", q0=_ON + 3710, q1=903)
pattern(10, result("a.v", "edges a JOIN edges b ON a.q_start < b.q_start AND a.q_end >= b.q_start", "a.pid = 'P9001' AND a.s = 10003720 AND b.s = 10000652 AND a.v IS NOT NULL", "x"), graph=statement_graph, p="P9001", t="P580", a=10003720, b=10000652)
pattern(11, result("s", _ORDERED, f"v = {_PART + 1784}", "x"), p="P527", q0=_PART + 1784, q1=904)
pattern(12, result("v", _L, f"s = {_ON + 3710}", "v"), p="P527", q0=_ON + 3710, q1=920)
pattern(13, first("110000000 + s_suppkey", "supplier", "TRUE", "s_acctbal", desc=True, n=2), p="P8001", q0=902)
pattern(14, first("120000000 + c_custkey", "customer", "TRUE", "c_acctbal", desc=True), p="P8001", q0=901)
pattern(15, result("v", _L, f"s = {_ON + 3710} AND ship >= TIMESTAMP '1996-01-01' AND ship < TIMESTAMP '1997-01-01'", "v"), 1996, p="P527", q0=_ON + 3710)
pattern(16, result("supp", _L, f"s = {_ON + 3710}", "v"), p="P527", q="P176", a=920, q0=_ON + 3710)
pattern(17, f"SELECT DISTINCT o_orderdate AS y FROM {_ORDERED} WHERE o_custkey = 102 AND v = {_PART + 1784}", p="P527", q="P8005", q0=_CUSTOMER + 102, q1=_PART + 1784)
pattern(18, f"SELECT DISTINCT o_orderdate AS y FROM {_ORDERED} WHERE o_custkey = 518 AND v = {_PART + 529}", p="P527", q="P8005", q0=_CUSTOMER + 518, q1=_PART + 529)
pattern(19, f"SELECT max(o_orderdate) AS y FROM {_ORDERED} WHERE o_custkey = 801 AND v = {_PART + 1165} HAVING max(o_orderdate) IS NOT NULL", p="P527", q="P8005", a=_CUSTOMER + 801, q0=_PART + 1165)
pattern(20, result("v", _L, f"s = {_ON + 3710}", "v"), p="P527", q0=_ON + 3710, q1=920)
pattern(21, result("v", _L, f"s = {_ON + 3710}", "v"), p="P527", s="P585", q0=_ON + 3710)
pattern(22, first("s", _ORDERED, f"v = {_PART + 529}", "o_orderdate", desc=True), p="P527", t="P585", a=904, q0=_PART + 529)
pattern(23, f"SELECT min(o_orderdate) AS y FROM {_ORDERED} WHERE o_custkey = 836 AND v = {_PART + 1554} HAVING min(o_orderdate) IS NOT NULL", p="P527", q="P8005", t="P585", a=_CUSTOMER + 836, q0=_PART + 1554)
pattern(24, f"SELECT max(ship) AS y FROM {_L} WHERE s = {_ON + 3710} AND v = {_PART + 228} HAVING max(ship) IS NOT NULL", p="P527", q0=_PART + 228, q1=_ON + 3710)
pattern(25, first("v", _L, f"s = {_ON + 3710}", "ship", "v"), p="P527", s="P585", q0=_ON + 3710)
pattern(26, first("140000000 + o_orderkey", "orders", "o_custkey = 102", "o_orderdate"), p="P8005", t="P585", a=904, q0=_CUSTOMER + 102)
pattern(27, first("supp", _L, f"s = {_ON + 3710}", "ship", "v", desc=True), p="P527", q="P176", s="P585", q0=_ON + 3710)
pattern(28, first("s", _ORDERED, f"v = {_PART + 1784} AND o_custkey = 102", "ship", desc=True), p="P527", q="P8005", s="P585", a=_CUSTOMER + 102, q0=_PART + 1784)
pattern(29, result("102000 + c_nationkey", "orders JOIN customer ON o_custkey = c_custkey", "o_orderkey = 3710", "v"), p="P8005", q="P17", q0=_ON + 3710)
pattern(30, first("v", f"{_ORDERED} JOIN customer ON o_custkey = c_custkey", "c_nationkey = 3 AND supp = 110000042", "c_acctbal"), p="P527", q="P17", t="P8001", r="P8006", u="P176", q0=110000042, q1=102003)
pattern(31, result("supp", _L, f"s = {_ON + 3710}", "v"), p="P527", q="P176", a=902, q0=_ON + 3710)
pattern(32, result("v", "edges", "pid = 'P279' AND s = 6000004 AND v IS NOT NULL", "v"), graph=statement_graph, q0=6000004)
pattern(33, f"SELECT max(o_orderdate) AS y FROM {_ORDERED} WHERE v = {_PART + 1784} HAVING max(o_orderdate) IS NOT NULL", p="P527", q0=_PART + 1784, q1=904)
pattern(34, result("supp", _L, f"s = {_ON + 3710} AND v = {_PART + 228}", "v"), q="P176", q0=_PART + 228, q1=_ON + 3710)
pattern(35, first("v", _L, f"s = {_ON + 7616}", "ship", "v"), p="P527", s="P585", q0=_ON + 7616)
pattern(36, first("v", "edges", "pid = 'P279' AND s = 6000030 AND v IS NOT NULL AND q_start IS NOT NULL", "q_start", "v"), graph=statement_graph, p="P279", q0=6000030)
pattern(37, result("supp", _L, f"s = {_ON + 7616} AND v = {_PART + 1534}", "v"), q="P176", q0=_PART + 1534, q1=_ON + 7616)
pattern(38, result("a.v", "edges a JOIN edges b ON a.q_start >= b.q_start JOIN edges c ON a.q_start <= c.q_end", "a.pid = 'P9001' AND a.s = 10000652 AND a.v IS NOT NULL AND b.s = 10003720 AND c.s = 10003720", "x"), graph=statement_graph, p="P9001", q0=10000652, q1=10003720)
pattern(39, result("s", f"{_ORDERED} JOIN customer ON o_custkey = c_custkey", f"c_nationkey = 20 AND v = {_PART + 1784}", "x"), p="P527", q="P17", r="P8006", q0=102020, q1=_PART + 1784)
pattern(40, result("a.s", "edges a JOIN edges c ON a.q_start >= c.q_start AND a.q_end <= c.q_end", f"a.pid = 'P9001' AND a.v = {_HUB} AND c.pid = 'P9001' AND c.s = 10003720 AND c.v = {_HUB}", "x"), graph=statement_graph, p="P9001", q0=_HUB, q1=10003720, q2=_HUB)



# Profiling


@call("connected_properties", f"SELECT DISTINCT pid, 'out' AS direction FROM edges WHERE s = {_HUB} AND v IS NOT NULL AND pid <> 'P31' UNION SELECT DISTINCT pid, 'in' FROM edges WHERE v = {_HUB} AND pid <> 'P31'")
def connected_properties(spark, d):
    return profile.connected_properties(statement_graph(spark, d), _HUB, ("P31",))


@call("connected_qualifiers", "SELECT DISTINCT pid, 'P580' AS qualifier FROM edges WHERE s = 10000008 AND q_start IS NOT NULL UNION SELECT DISTINCT pid, 'P582' FROM edges WHERE s = 10000008 AND q_end IS NOT NULL")
def connected_qualifiers(spark, d):
    return profile.connected_qualifiers(statement_graph(spark, d), 10000008)


@call("property_frequency", "SELECT pid, count(*) AS n FROM edges WHERE v IS NOT NULL GROUP BY pid HAVING count(*) >= 10")
def property_frequency(spark, d):
    return profile.property_frequency(statement_graph(spark, d))


@call("qualifier_frequency", "SELECT 'P580' AS qualifier, count(q_start) AS n FROM edges WHERE pid = 'P9001' AND v IS NOT NULL HAVING count(q_start) >= 10 UNION ALL SELECT 'P582', count(q_end) FROM edges WHERE pid = 'P9001' AND v IS NOT NULL HAVING count(q_end) >= 10")
def qualifier_frequency(spark, d):
    return profile.qualifier_frequency(statement_graph(spark, d), "P9001")


@call("qualifier_sample", "SELECT DISTINCT q_start AS value FROM edges WHERE pid = 'P9001' AND v IS NOT NULL AND q_start IS NOT NULL ORDER BY 1 LIMIT 100")
def qualifier_sample(spark, d):
    return profile.qualifier_sample(statement_graph(spark, d), "P9001", "P580")


@call("domain_size", _PAIRS + "SELECT class, count(DISTINCT s)::DOUBLE AS n FROM (SELECT e.s, c.v AS class FROM edges e JOIN c ON e.v = c.s WHERE e.pid = 'P31' UNION ALL SELECT s, v FROM edges WHERE pid = 'P31' AND v IS NOT NULL) GROUP BY class")
def domain_size(spark, d):
    return profile.domain_sizes(statement_graph(spark, d))


@call("domain_properties", _BELOW.format(c=_RIVER) + f"SELECT pid, count(*) AS n_statements, count(DISTINCT v) AS n_values FROM edges WHERE v IS NOT NULL AND {_IN} GROUP BY pid HAVING count(*) >= 2")
def domain_properties(spark, d):
    return profile.domain_properties(statement_graph(spark, d), _RIVER, 2)


@call("domain_top_sample", _BELOW.format(c=_PERSON) + f", m AS (SELECT DISTINCT s FROM edges WHERE pid = 'P31' AND {_IN}), l AS (SELECT v, count(*) AS n FROM edges WHERE v IS NOT NULL GROUP BY v) SELECT m.s, coalesce(n, 0) AS links FROM m LEFT JOIN l ON m.s = l.v ORDER BY links DESC, s LIMIT 100")
def domain_top_sample(spark, d):
    return profile.domain_sample(statement_graph(spark, d), _PERSON)


_TOPS = ", ".join(str(6000001 + i) for i in range(11))
_TOP = f"b AS (SELECT DISTINCT s, class FROM (SELECT e.s, c.v AS class FROM edges e JOIN c ON e.v = c.s WHERE e.pid = 'P31' UNION ALL SELECT s, v FROM edges WHERE pid = 'P31') WHERE class IN ({_TOPS})), z AS (SELECT class, count(*) AS n FROM b GROUP BY class), t AS (SELECT s, class FROM (SELECT b.s, b.class, row_number() OVER (PARTITION BY b.s ORDER BY n, b.class DESC) AS r FROM b JOIN z USING (class)) WHERE r = 1)"


@call("top_level_domain", _PAIRS + f", {_TOP} SELECT s, class FROM t")
def top_level_domain(spark, d):
    return profile.top_domains(statement_graph(spark, d), [6000001 + i for i in range(11)])


@call("entity_domain", _PAIRS + f", {_TOP}, ty AS (SELECT s, min(v) AS ty FROM edges WHERE pid = 'P9001' GROUP BY s) SELECT DISTINCT e.s, CASE WHEN e.s IN (SELECT s FROM edges WHERE pid = 'P31' AND v = {_PERSON}) THEN {_PERSON} ELSE coalesce(ty.ty, t.class) END AS class FROM edges e LEFT JOIN ty ON ty.s = e.s LEFT JOIN t ON t.s = e.s WHERE e.pid = 'P31' AND e.v IS NOT NULL")
def entity_domain(spark, d):
    g = statement_graph(spark, d)
    types = g.edges("P9001").select("s", F.col("v").alias("type"))
    return profile.entity_domain(g, [6000001 + i for i in range(11)], _PERSON, types)


@call("infer_catalog", " UNION ALL ".join(f"({_BELOW.format(c=c)}SELECT '{n}' AS domain, pid, count(*) AS n_statements, count(DISTINCT v) AS n_values FROM edges WHERE v IS NOT NULL AND {_IN} GROUP BY pid HAVING count(*) >= 3)" for n, c in (("city", 6000002), ("river", 6000001))))
def infer_catalog(spark, d):
    return profile.infer_catalog(statement_graph(spark, d), {"river": 6000001, "city": 6000002}, 3)


# Text and label functions

_ACC = f"translate({{0}}, '{X.ACCENTED}', '{X.BASE}')"


def labels(spark, d) -> DataFrame:
    return table(spark, d, "entities")


@call("clean_name", "WITH a AS (SELECT id, replace(regexp_replace(" + _ACC.format("replace(lower(regexp_replace(trim(replace(label, '(s)', 's')), '[() _-]+', '_', 'g')), 'u.s.', 'us')") + ", '[^1-9a-zA-Z]', '_', 'g'), '__', '_') AS n FROM entities) SELECT id, CASE WHEN regexp_matches(n, '^[^a-zA-Z_]') THEN '_' || n ELSE n END AS name FROM a")
def clean_name(spark, d):
    return labels(spark, d).select("id", X.clean_name(F.col("label")).alias("name"))


@call("snake_case", "SELECT id, lower(regexp_replace(trim(label), '[() _-]+', '_', 'g')) AS name FROM entities")
def snake_case(spark, d):
    return labels(spark, d).select("id", X.snake_case(F.col("label")).alias("name"))


@call("remove_accent", f"SELECT id, {_ACC.format('label')} AS name FROM entities")
def remove_accent(spark, d):
    return labels(spark, d).select("id", X.remove_accent(F.col("label")).alias("name"))


@call("remove_end_punctuation_all", r"SELECT row_id, regexp_replace(utterance, '[.!?]\z', '') AS text FROM examples WHERE utterance IS NOT NULL")
def remove_end_punctuation_all(spark, d):
    return table(spark, d, "examples").filter("utterance IS NOT NULL").select("row_id", X.remove_end_punctuation(F.col("utterance")).alias("text"))


@call("spans", "WITH w AS (SELECT id, list_filter(string_split(label, ' '), lambda x: x <> '') AS t FROM entities), k AS (SELECT id, t, unnest(range(len(t))) AS i FROM w), p AS (SELECT id, t, i, unnest(range(i + 1, len(t) + 1)) AS j FROM k) SELECT id, array_to_string(t[i + 1 : j], ' ') AS span FROM p")
def spans(spark, d):
    return labels(spark, d).select("id", F.explode(X.spans(F.col("label"))).alias("span"))


@call("entity_id_list", "SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(thingtalk, 'Q[0-9]+'))), ' ') AS ids FROM examples WHERE thingtalk IS NOT NULL")
def entity_id_list(spark, d):
    rows = table(spark, d, "examples").filter("thingtalk IS NOT NULL")
    return rows.select("row_id", F.array_join(F.array_sort(X.entity_ids(F.col("thingtalk"))), " ").alias("ids"))


@call("value_kind", "SELECT mention_id, CASE WHEN regexp_matches(label, '^Q[0-9]+$') THEN 'entity' WHEN try_cast(label AS DOUBLE) IS NOT NULL THEN 'number' WHEN try_cast(label AS TIMESTAMP) IS NOT NULL THEN 'date' ELSE 'string' END AS kind FROM mentions WHERE label IS NOT NULL")
def value_kind(spark, d):
    return table(spark, d, "mentions").filter("label IS NOT NULL").select("mention_id", X.value_kind(F.col("label")).alias("kind"))


@call("year_if_new_year", "SELECT edge_id, CASE WHEN month(q_start) = 1 AND day(q_start) = 1 THEN year(q_start) END AS year FROM edges")
def year_if_new_year(spark, d):
    return table(spark, d, "edges").select("edge_id", X.year_if_new_year(F.col("q_start")).cast("bigint").alias("year"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_STEM = r"regexp_replace(regexp_replace(regexp_replace(w, '^(\w{2,})ies$', '\1y'), '^(\w{3,})(?:ing|ed|es)$', '\1'), '^(\w{2,}[^s])s$', '\1')"
_WORDS = "list_transform(list_filter(regexp_split_to_array(lower(TEXT), '[^\\pL\\pN]+'), lambda w: w <> '' AND w NOT IN (" + _STOP + ")), lambda w: " + _STEM + ")"
_SIMILAR = f"(WITH w AS (SELECT a.id, alias, label, {_WORDS.replace('TEXT', 'alias')} AS x, {_WORDS.replace('TEXT', 'label')} AS y FROM entity_aliases a JOIN entities e ON a.id = e.id), c AS (SELECT *, len(list_filter(x, lambda v: list_contains(y, v)))::DOUBLE AS n FROM w) SELECT id, alias, CASE WHEN len(x) = 0 OR len(y) = 0 OR n = 0 OR n IS NULL THEN 0 ELSE 2 * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y)) END AS f1, CASE WHEN len(x) = 0 OR len(y) = 0 OR n IS NULL THEN 0 ELSE n / len(list_distinct(list_concat(x, y))) END AS jaccard FROM c)"


@call("similarity_f1", f"SELECT id, alias, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard FROM {_SIMILAR}")
def similarity_f1(spark, d):
    """Similarity of each alias to its entity's label."""
    e = labels(spark, d).select("id", "label")
    return table(spark, d, "entity_aliases").join(e, "id").select("id", "alias", F.round(X.similarity(F.col("alias"), F.col("label")), 6).alias("f1"), F.round(X.similarity(F.col("alias"), F.col("label"), "jaccard"), 6).alias("jaccard"))


@call("closest_label", f"SELECT id, alias FROM {_SIMILAR} WHERE f1 > 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY f1 DESC, alias) = 1")
def closest_label(spark, d):
    """For each entity the first of its aliases, in order, that is most similar to its label, if any is by more than 0.2."""
    grouped = table(spark, d, "entity_aliases").groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases")).join(labels(spark, d).select("id", "label"), "id")
    return grouped.select("id", X.closest(F.col("label"), F.col("aliases"), least=0.2).alias("alias")).filter("alias IS NOT NULL")


@call("sample_labels", "WITH a AS (SELECT DISTINCT id, alias FROM entity_aliases), b AS (SELECT id, regexp_replace(alias, '^is ', '') AS x, row_number() OVER (PARTITION BY id ORDER BY alias) AS i FROM a WHERE alias IS NOT NULL), c AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY length(x), i) AS r FROM b WHERE regexp_matches(x, '^[a-zA-Z -]+$')), s AS (SELECT id, string_agg(x, '|' ORDER BY r) AS aliases FROM c WHERE r <= 2 GROUP BY id) SELECT a.id, coalesce(s.aliases, '') AS aliases FROM (SELECT DISTINCT id FROM a) a LEFT JOIN s ON a.id = s.id")
def sample_labels(spark, d):
    grouped = table(spark, d, "entity_aliases").groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return grouped.select("id", F.array_join(X.sample_labels(F.col("aliases"), 2), "|").alias("aliases"))


@call("remove_accent_labels", "SELECT label_id, strip_accents(label) AS name FROM labels WHERE label IS NOT NULL")
def remove_accent_labels(spark, d):
    """Labels of all scripts without accents."""
    return table(spark, d, "labels").filter("label IS NOT NULL").select("label_id", X.remove_accent(F.col("label")).alias("name"))


@call("spans_in_order", r"WITH w AS (SELECT id, alias, regexp_split_to_array(regexp_replace(alias, '[.!?]\z', ''), '\s+') AS t FROM entity_aliases WHERE alias IS NOT NULL), k AS (SELECT *, unnest(range(1, len(t) + 1)) AS n FROM w), p AS (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM k) SELECT id, alias, (n - 1) * (len(t) + 1) - n * (n - 1) // 2 + i - 1 AS position, array_to_string(t[i : i + n - 1], ' ') AS span FROM p")
def spans_in_order(spark, d):
    return table(spark, d, "entity_aliases").select("id", "alias", F.posexplode(X.spans_in_order(F.col("alias"))).alias("position", "span"))


# Labels, links and datasets


@call("label_lookup", "WITH l AS (SELECT id, arg_max(label, (updated_at, label_id)) AS label FROM labels WHERE lang = 'en' AND label IS NOT NULL GROUP BY id) SELECT DISTINCT m.id, l.label FROM mentions m LEFT JOIN l ON m.id = l.id WHERE m.id IS NOT NULL")
def label_lookup(spark, d):
    ids = table(spark, d, "mentions").select("id").filter("id IS NOT NULL").distinct()
    return linking.labels_of(ids, table(spark, d, "labels"))


@call("entity_search", "SELECT l.label_id, min(e.id) AS id FROM labels l JOIN entities e ON lower(trim(l.label)) = lower(trim(e.label)) GROUP BY l.label_id")
def entity_search(spark, d):
    e = labels(spark, d).select(F.lower(F.trim("label")).alias("k"), "id").groupBy("k").agg(F.min("id").alias("id"))
    return table(spark, d, "labels").select("label_id", F.lower(F.trim("label")).alias("k")).join(e, "k").select("label_id", "id")


@call("entity_type", "SELECT m.mention_id, e.domain_name AS type FROM mentions m LEFT JOIN entities e ON m.id = e.id")
def entity_type(spark, d):
    return table(spark, d, "mentions").select("mention_id", "id").join(labels(spark, d).select("id", F.col("domain_name").alias("type")), "id", "left").select("mention_id", "type")


@call("cache_insert", "SELECT key, value FROM (SELECT id AS key, min(label) AS value FROM entities GROUP BY id) UNION ALL SELECT id, min(label) FROM labels WHERE id IS NOT NULL AND label IS NOT NULL AND id NOT IN (SELECT id FROM entities) GROUP BY id")
def cache_insert(spark, d):
    cache = labels(spark, d).groupBy(F.col("id").alias("key")).agg(F.min("label").alias("value"))
    new = table(spark, d, "labels").filter("id IS NOT NULL AND label IS NOT NULL").select(F.col("id").alias("key"), F.col("label").alias("value"))
    return linking.add_if_absent(cache, new)


_GOLD = "(SELECT DISTINCT row_id, unnest(list_distinct(regexp_extract_all(thingtalk, 'Q[0-9]+'))) AS id FROM examples WHERE thingtalk IS NOT NULL)"
_FOUND = "(SELECT DISTINCT row_id, id FROM mentions WHERE id IS NOT NULL)"


@call("link_oracle", f"SELECT g.row_id, g.id, e.label, e.domain_name FROM {_GOLD} g LEFT JOIN entities e ON e.id = g.id")
def link_oracle(spark, d):
    return linking.oracle_links(table(spark, d, "examples"), labels(spark, d))


@call("link_merge", "SELECT row_id, id, count(DISTINCT linker) AS n_linkers, max(score) AS score FROM mentions WHERE id IS NOT NULL GROUP BY row_id, id")
def link_merge(spark, d):
    return linking.merged_links(table(spark, d, "mentions"))


def _gold_found(spark, d):
    gold = linking.oracle_links(table(spark, d, "examples"), labels(spark, d)).select("row_id", "id")
    return gold, table(spark, d, "mentions").filter("id IS NOT NULL").select("row_id", "id")


@call("missing_entities", f"SELECT row_id, id FROM {_GOLD} EXCEPT SELECT row_id, id FROM {_FOUND}")
def missing_entities(spark, d):
    return linking.missing_entities(*_gold_found(spark, d))


@call("missing_report", f"WITH m AS (SELECT row_id, id FROM {_GOLD} EXCEPT SELECT row_id, id FROM {_FOUND}) SELECT (SELECT count(*) FROM {_GOLD}) AS n_gold, count(*) AS n_missing, count(DISTINCT row_id) AS n_examples FROM m")
def missing_report(spark, d):
    return linking.missing_report(*_gold_found(spark, d))


@call("completed_links", f"SELECT row_id, id, FALSE AS synthetic FROM {_FOUND} UNION ALL SELECT row_id, id, TRUE FROM (SELECT row_id, id FROM {_GOLD} EXCEPT SELECT row_id, id FROM {_FOUND})")
def completed_links(spark, d):
    return linking.completed_links(*_gold_found(spark, d))


_RANKED = "(SELECT row_id, id, rank() OVER (PARTITION BY row_id ORDER BY score DESC NULLS LAST, mention_id) AS rank FROM mentions WHERE row_id IS NOT NULL AND id IS NOT NULL)"


@call("linker_errors", f"SELECT g.row_id, g.id, CASE WHEN r IS NULL THEN 'missing' ELSE 'misranked' END AS error FROM {_GOLD} g LEFT JOIN (SELECT row_id, id, min(rank) AS r FROM {_RANKED} GROUP BY ALL) b ON b.row_id = g.row_id AND b.id = g.id WHERE r IS NULL OR r > 2")
def linker_errors(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row_id").orderBy(F.desc_nulls_last("score"), "mention_id")
    links = table(spark, d, "mentions").filter("row_id IS NOT NULL AND id IS NOT NULL").select("row_id", "id", F.rank().over(w).alias("rank"))
    return linking.linker_errors(links, _gold_found(spark, d)[0])


@call("candidate_ranking", "WITH c AS (SELECT m.row_id, m.id, max(CASE WHEN m.domain_name = e.domain_name THEN 1 ELSE 0 END) AS type_match, max(CASE WHEN m.label = e.label THEN 1 ELSE 0 END) AS exact_name, count(*) AS n_matches FROM mentions m JOIN entities e ON m.id = e.id WHERE m.row_id IS NOT NULL GROUP BY m.row_id, m.id) SELECT row_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY type_match DESC, exact_name DESC, n_matches DESC, id) AS rank FROM c) WHERE rank <= 4")
def candidate_ranking(spark, d):
    e = labels(spark, d).select("id", F.col("label").alias("name"), F.col("domain_name").alias("of"))
    m = table(spark, d, "mentions").filter("row_id IS NOT NULL").join(e, "id")
    one = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    c = m.groupBy("row_id", "id").agg(one(F.col("domain_name") == F.col("of")).alias("type_match"), one(F.col("label") == F.col("name")).alias("exact_name"), F.count("*").alias("n_matches"))
    return linking.ranked_candidates(c).select("row_id", "id", "rank")


@call("evaluate_metrics", "WITH a AS (SELECT list_distinct(coalesce(expected, [])) AS e, list_distinct(coalesce(predicted, [])) AS p, predicted[1] AS f FROM predictions), b AS (SELECT len(list_intersect(e, p))::DOUBLE AS tp, len(p)::DOUBLE AS np, len(e)::DOUBLE AS ne, CASE WHEN f IS NULL THEN (len(e) = 0 AND len(p) = 0) ELSE list_contains(e, f) END::INT::DOUBLE AS hit FROM a), m AS (SELECT count(*) AS n, 2 * sum(tp) / (sum(np) + sum(ne)) AS micro, avg(CASE WHEN np = 0 AND tp = 0 THEN 1 ELSE tp / np END) AS pr, avg(CASE WHEN ne = 0 AND tp = 0 THEN 1 ELSE tp / ne END) AS rc, avg(hit) AS hits, avg((tp = ne AND tp = np)::INT::DOUBLE) AS ex FROM b) SELECT n, round(micro, 9) AS micro_f1, round(pr, 9) AS precision, round(rc, 9) AS recall, round(2 * pr * rc / (pr + rc), 9) AS f1, round(hits, 9) AS hits_at_1, round(ex, 9) AS exact FROM m")
def evaluate_metrics(spark, d):
    out = evaluate.answer_metrics(table(spark, d, "predictions"), distinct=True)
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@call("intersect_results", "SELECT id FROM mentions WHERE id IN (SELECT id FROM labels) AND id IN (SELECT id FROM entities)")
def intersect_results(spark, d):
    return evaluate.intersection([table(spark, d, t).select("id").filter("id IS NOT NULL") for t in ("mentions", "labels", "entities")])


@call("failed_diff", "SELECT id FROM predictions WHERE predicted IS NULL AND id IS NOT NULL AND id NOT IN (SELECT id FROM predictions WHERE len(expected) = 0)")
def failed_diff(spark, d):
    p = table(spark, d, "predictions")
    return evaluate.newly_failed(p.filter(F.size("expected") == 0).select("id"), p.filter("predicted IS NULL AND id IS NOT NULL").select("id"))


_NAMED = r"(?:contains~? \( |[(!]|&&|\|\||filter) ?([a-z_]+)"


@call("property_usage", f"WITH p AS (SELECT thingtalk AS t FROM examples WHERE thingtalk IS NOT NULL), u AS (SELECT unnest(regexp_extract_all(t, '{_NAMED} (?:,|>=|<=|==|=~)', 1)) AS property, 'filter' AS kind FROM p UNION ALL SELECT unnest(regexp_extract_all(t, '{_NAMED} filter', 1)), 'filter' FROM p UNION ALL SELECT unnest(regexp_extract_all(t, '\\[ ([a-z_]+) (?:\\]|filter|of|,)', 1)), 'projection' FROM p UNION ALL SELECT unnest(regexp_extract_all(t, 'sort \\( ([a-z_]+) ', 1)), 'sort' FROM p) SELECT property, count(*) FILTER (kind = 'filter') AS n_filter, count(*) FILTER (kind = 'projection') AS n_projection, count(*) FILTER (kind = 'sort') AS n_sort, count(*) AS n_total FROM u WHERE property NOT IN ('id', 'value', 'filter', 'contains', 'count', 'sort') GROUP BY property")
def property_usage(spark, d):
    return evaluate.property_usage(table(spark, d, "examples"))


@call("split_half", "SELECT row_id <= (SELECT row_id FROM examples ORDER BY row_id LIMIT 1 OFFSET (SELECT count(*) // 2 - 1 FROM examples)) AS first_half, count(*) AS n FROM examples GROUP BY 1")
def split_half(spark, d):
    a, b = evaluate.split_in_two(table(spark, d, "examples").select("row_id"), "row_id")
    return a.select(F.lit(True).alias("first_half")).union(b.select(F.lit(False))).groupBy("first_half").agg(F.count("*").alias("n"))


@call("class_last_fallback", ORACLE_SQL["located_with_number"])
def class_last_fallback(spark, d):
    """The query without its class, and the class tested on the candidates afterwards; equal to the class-first query."""
    g = trade_graph(spark, d)
    rest = T.run_tt(g, '@wd . entity ( ) filter contains ( located_in , " Q101003 " ^^wd:region ) && balance >= 5000 ;')
    members = profile.domain_members(g, 901).select(F.concat(F.lit("Q"), F.col("s").cast("string")).alias("x1"))
    return rest.join(members, "x1", "left_semi")


# More of the algebra

trade("enum_value_filter", "@wd . customer ( ) filter sex_or_gender == enum female && balance >= 0 ;", result("s", f"({_CUST})", "(s - 120000000) % 2 = 0 AND bal > 0"))
trade("part_of_transitive", '@wd . entity ( ) filter contains ( part_of , " Q101001 " ^^wd:region ) ;', result("x", "(SELECT 120000000 + c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 102000 + n_nationkey FROM nation WHERE n_regionkey = 1)"))
kgs("negated_set", f"SELECT DISTINCT ?x WHERE {{ ?x !(wdt:P9001|wdt:P31) wd:Q{_HUB} }}", result("s", "edges", f"pid NOT IN ('P9001', 'P31') AND v = {_HUB}", "x"))
kgs("negated_inverse", f"SELECT DISTINCT ?x WHERE {{ wd:Q{_HUB} !(^wdt:P31|^wdt:P9001) ?x }}", result("s", "edges", f"pid NOT IN ('P9001', 'P31') AND v = {_HUB}", "x"))
kgs("entity_value", "SELECT DISTINCT ?v WHERE { wd:Q10003720 wdt:P9001 ?v }", result("v", "edges", "pid = 'P9001' AND s = 10003720 AND v IS NOT NULL", "v"))
trades("group_two_keys", "SELECT ?n ?p (COUNT(DISTINCT ?o) AS ?count) WHERE { ?o wdt:P8005 ?c . ?c wdt:P17 ?n . ?o wdt:P8004 ?p } GROUP BY ?n ?p", f"SELECT {q('102000 + c_nationkey')} AS n, o_orderpriority AS p, count(DISTINCT o_orderkey) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority")
trades("order_two_keys", "SELECT DISTINCT ?x ?p WHERE { ?x wdt:P8004 ?p . ?x wdt:P8002 ?t } ORDER BY ?p DESC(?t) LIMIT 20", f"SELECT {q('140000000 + o_orderkey')} AS x, o_orderpriority AS p FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20")
kgt("template_holders_of_hub_in_1999", "holders_in_year", result("s", "edges", f"pid = 'P9001' AND v = {_HUB} AND q_start < TIMESTAMP '2000-01-01' AND q_end >= TIMESTAMP '1999-01-01'", "x"), 1999, p="P9001", q0=_HUB)


def trade_template(name: str, template: str, sql: str, year: int | None = None, **parameters) -> None:
    QUERIES[name] = lambda spark, d: T.template(trade_graph(spark, d), template, year, **parameters)
    ORACLE_SQL[name] = sql


trade_template("template_orders_of_kept_parts", "current_holders_in", result("s", f"{_LINES} l JOIN part ON v = 130000000 + p_partkey", "ended IS NULL", "x"), p="P527", q="P31", q0=903)
trade_template("template_orders_shipped_the_same_day", "same_start", result("b.s", f"{_LINES} a JOIN {_LINES} b ON a.ship = b.ship", f"a.s = {_ON + 3710}", "x"), p="P527", s="P585", q0=_ON + 3710)


@call("union_simplified", _BELOW.format(c=_RIVER) + result("s", "edges", "pid = 'P31' AND v = 6000001", "x"))
def union_simplified(spark, d):
    """A union that says one thing twice, as its first part."""
    from .plans import rewrites, sparql
    from .plans.planner import run

    g = statement_graph(spark, d)
    text = "SELECT DISTINCT ?x WHERE { { ?x wdt:P31 wd:Q6000001 } UNION { ?x wdt:P31/wdt:P279* wd:Q6000001 } }"
    return run(g, rewrites.simplified(g, sparql.parse(T.PREFIXES + text)))


@call("class_with_another", result("s", _PARTY))
def class_with_another(spark, d):
    """A class whose members are those of another one too."""
    g = trade_graph(spark, d)
    g.also = {901: (902,)}
    return T.run_tt(g, "@wd . customer ( ) ;")


@call("allowed_values", f"SELECT DISTINCT 'P176' AS qualifier, {q('supp')} AS value FROM {_LINES} WHERE s = {_ON + 3710} AND v = {_PART + 228} UNION SELECT DISTINCT 'P1114', CAST(qty AS VARCHAR) FROM {_LINES} WHERE s = {_ON + 3710} AND v = {_PART + 228}")
def allowed_values(spark, d):
    return profile.statement_qualifiers(trade_graph(spark, d), _ON + 3710, "P527", _PART + 228, ("P176", "P1114"))


@call("value_range", f"SELECT min(qty) AS least, max(price) AS most FROM {_LINES} WHERE s = {_ON + 3710} AND v = {_PART + 228}")
def value_range(spark, d):
    return profile.value_range(trade_graph(spark, d), _ON + 3710, "P527", _PART + 228, "P1114", "P2284")


@call("domain_entities", "SELECT id, id IN (SELECT s FROM edges WHERE pid = 'P279' AND v IS NOT NULL) AS is_domain FROM (SELECT DISTINCT v AS id FROM edges WHERE v IS NOT NULL)")
def domain_entities(spark, d):
    return profile.domain_entities(statement_graph(spark, d), table(spark, d, "edges").select(F.col("v").alias("id")).filter("id IS NOT NULL"))


_ALL = {n: c for n, c in (("river", 6000001), ("city", 6000002), ("film", 6000003), ("museum", 6000004), ("bridge", 6000005), ("human", 6000006), ("band", 6000007), ("lake", 6000008), ("company", 6000009), ("book", 6000010), ("mountain", 6000011))}
_BELONGS = f"b AS (SELECT DISTINCT s, class FROM (SELECT e.s, c.v AS class FROM edges e JOIN c ON e.v = c.s WHERE e.pid = 'P31' UNION ALL SELECT s, v FROM edges WHERE pid = 'P31') WHERE class IN ({_TOPS}))"


@call("infer_manifest", _PAIRS + f", {_BELONGS}, n(domain, class) AS (VALUES " + ", ".join(f"('{n}', {c})" for n, c in _ALL.items()) + "), p(pid, name) AS (VALUES ('P31', 'instance_of'), ('P279', 'subclass_of'), ('P9001', 'location'), " + ", ".join(f"('P{9101 + i}', '{n}')" for i, n in enumerate(PROPERTY_NAMES)) + ") SELECT domain, e.pid, name, 'entity' AS kind, count(*) AS n_statements, count(DISTINCT v) AS n_values, concat_ws(' ', CASE WHEN count(q_start) >= 5 THEN 'P580' END, CASE WHEN count(q_end) >= 5 THEN 'P582' END) AS qualifiers FROM edges e JOIN b ON e.s = b.s JOIN n ON n.class = b.class JOIN p ON p.pid = e.pid WHERE v IS NOT NULL GROUP BY domain, e.pid, name HAVING count(*) >= 5")
def infer_manifest(spark, d):
    """Properties, names, kinds and qualifiers of all eleven classes."""
    return profile.inferred_manifest(statement_graph(spark, d), _ALL, 5, 5)


@call("alt_labels", "SELECT e.id, coalesce(array_to_string(a, '|'), '') AS aliases FROM entities e LEFT JOIN (SELECT id, list_sort(list(DISTINCT alias)) AS a FROM entity_aliases WHERE alias IS NOT NULL AND lang = 'de' GROUP BY id) USING (id)")
def alt_labels(spark, d):
    return linking.alt_labels_of(labels(spark, d), table(spark, d, "entity_aliases"), "de").select("id", F.array_join("aliases", "|").alias("aliases"))


_NAMES = "(SELECT lower(trim(label)) AS k, id, 0 AS way FROM entities UNION ALL SELECT lower(trim(alias)), id, 1 FROM entity_aliases)"
_SEARCHED = f"(SELECT text, id, row_number() OVER (PARTITION BY text ORDER BY way, CAST(substr(id, 2) AS BIGINT)) AS rank FROM (SELECT t.text, n.id, min(n.way) AS way FROM (SELECT DISTINCT label AS text FROM mentions) t JOIN {_NAMES} n ON lower(trim(t.text)) = n.k WHERE n.k <> '' GROUP BY t.text, n.id))"


@call("entity_search_ranked", f"SELECT text, id, rank FROM {_SEARCHED} WHERE rank <= 5")
def entity_search_ranked(spark, d):
    return linking.searched(table(spark, d, "mentions").select(F.col("label").alias("text")), labels(spark, d), table(spark, d, "entity_aliases"))


@call("url_ids", "WITH u AS (SELECT 'https://pages.example/wiki/' || replace(label, ' ', '_') AS url, label, id FROM entities), s AS (SELECT url, min(id) AS id FROM u WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 0 GROUP BY url), f AS (SELECT k, arg_min(id, (way, CAST(substr(id, 2) AS BIGINT))) AS id FROM " + _NAMES + " WHERE k <> '' GROUP BY k) SELECT DISTINCT u.url, coalesce(s.id, f.id) AS id FROM u LEFT JOIN s ON u.url = s.url LEFT JOIN f ON f.k = lower(trim(u.label))")
def url_ids(spark, d):
    """Entities of page addresses: half of them by a table of addresses, the others by the page's title."""
    e = labels(spark, d)
    urls = e.select(F.concat(F.lit("https://pages.example/wiki/"), F.replace("label", F.lit(" "), F.lit("_"))).alias("url"), "id")
    known = urls.filter("CAST(substr(id, 2) AS bigint) % 2 = 0")
    return linking.ids_of_urls(urls, known, e, table(spark, d, "entity_aliases"))


@call("canonical_names", "WITH a AS (SELECT DISTINCT id, alias FROM entity_aliases WHERE alias IS NOT NULL), b AS (SELECT id, regexp_replace(alias, '^is ', '') AS x, row_number() OVER (PARTITION BY id ORDER BY alias) AS i FROM a), c AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY length(x), i) AS r FROM b WHERE regexp_matches(x, '^[a-zA-Z -]+$')), n AS (SELECT id, label AS x, 0 AS r FROM entities WHERE label IS NOT NULL UNION ALL SELECT c.id, x, r FROM c JOIN entities e ON e.id = c.id WHERE r <= 5), m AS (SELECT id, x, min(r) AS r FROM n GROUP BY id, x) SELECT id, string_agg(x, '|' ORDER BY r) AS canonical FROM m GROUP BY id")
def canonical_names(spark, d):
    return linking.canonical_names(labels(spark, d), table(spark, d, "entity_aliases")).select("id", F.array_join("canonical", "|").alias("canonical"))


@call("answer_metrics", "WITH a AS (SELECT coalesce(expected, []) AS e, coalesce(predicted, []) AS p, predicted[1] AS f FROM predictions), b AS (SELECT len(list_filter(p, lambda x: list_contains(e, x)))::DOUBLE AS tp, len(p)::DOUBLE AS np, (len(list_filter(p, lambda x: list_contains(e, x))) + len(list_filter(e, lambda x: NOT list_contains(p, x))))::DOUBLE AS ne, CASE WHEN f IS NULL THEN (len(e) = 0 AND len(p) = 0) ELSE list_contains(e, f) END::INT::DOUBLE AS hit, (len(list_filter(p, lambda x: NOT list_contains(e, x))) = 0 AND len(list_filter(e, lambda x: NOT list_contains(p, x))) = 0)::INT::DOUBLE AS same FROM a), m AS (SELECT count(*) AS n, 2 * sum(tp) / (sum(np) + sum(ne)) AS micro, avg(CASE WHEN np = 0 AND tp = 0 THEN 1 ELSE tp / np END) AS pr, avg(CASE WHEN ne = 0 AND tp = 0 THEN 1 ELSE tp / ne END) AS rc, avg(hit) AS hits, avg(same) AS ex FROM b) SELECT n, round(micro, 9) AS micro_f1, round(pr, 9) AS precision, round(rc, 9) AS recall, round(2 * pr * rc / (pr + rc), 9) AS f1, round(hits, 9) AS hits_at_1, round(ex, 9) AS exact FROM m")
def answer_metrics(spark, d):
    """Answers counted as often as they are listed."""
    out = evaluate.answer_metrics(table(spark, d, "predictions"))
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@call("intersect_mentions", "SELECT id FROM mentions WHERE id IN (SELECT id FROM entities)")
def intersect_mentions(spark, d):
    return evaluate.intersection([table(spark, d, t).select("id").filter("id IS NOT NULL") for t in ("mentions", "entities")])


#: Root and depth of the classes in a tree of types.
_TREE = {6000001: (1, 2), 6000002: (1, 1), 6000003: (2, 1), 6000004: (1, 2), 6000005: (1, 2), 6000006: (3, 0), 6000007: (3, 1), 6000008: (1, 2), 6000009: (3, 1), 6000010: (2, 2), 6000011: (1, 1)}


@call("domain_choice", _PAIRS + f", {_BELONGS}, z AS (SELECT class, count(*) AS n FROM b GROUP BY class), i(class, root, depth) AS (VALUES " + ", ".join(f"({c}, {r}, {d})" for c, (r, d) in _TREE.items()) + "), k AS (SELECT b.s, b.class, n, root, depth, first_value(root) OVER (PARTITION BY b.s ORDER BY n, b.class DESC) AS of FROM b JOIN z USING (class) JOIN i USING (class)) SELECT s, class FROM k WHERE root = of QUALIFY row_number() OVER (PARTITION BY s ORDER BY depth = 0, depth DESC, n DESC, class DESC) = 1")
def domain_choice(spark, d):
    """The domain of each entity by size, root and depth."""
    from .runtime import numbers_frame

    belongs = profile.members_of(statement_graph(spark, d), list(_TREE))
    sizes = belongs.groupBy("class").agg(F.count("*").alias("size"))
    tree = numbers_frame(spark, **{"class": list(_TREE), "root": [r for r, _ in _TREE.values()], "depth": [x for _, x in _TREE.values()]})
    return profile.chosen_domains(belongs, sizes.join(tree, "class"))
