"""Numbered patterns, paths over other properties, refused products, rewrites of unions, and the functions on edge cases."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_engine import graph, ids  # noqa: F401
from test_queries import DATA, SQL, duck, rows  # noqa: F401

import __spark_entry__ as entry
from triplane.functions import text as X
from triplane.operators import evaluate, linking, paths, profile
from triplane.plans import rewrites, sparql, templates
from triplane.plans.algebra import AnyOf, Other, Triple, Unsupported
from triplane.plans.planner import run

CLOSURES = ["closure_up", "closure_down", "closure_pairs", "closure_reflexive", "instance_of_subclass", "ask_path", "domain_size", "top_level_domain", "entity_domain", "domain_scan", "located_in_transitive", "part_of_transitive", "infer_manifest", "path_filter"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CLOSURES)
def test_closures_in_distributed_rounds(spark, duck, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(paths, "SMALL", 0)
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert rows(got) == rows(want)


def test_every_pattern_is_a_query():
    numbers = set(templates.PATTERNS) | set(templates.STATEMENT_PATTERNS)
    assert numbers == set(range(1, 41)) and set(templates.CONSTANTS) == numbers - {1}
    for n, name in (templates.PATTERNS | templates.STATEMENT_PATTERNS).items():
        if name != "describe":
            free = {x: 5 for x in templates._MARK.findall(templates.TEMPLATES[name])} | templates.CONSTANTS[n]
            assert sparql.parse(templates.fill(name, 2001, **{"s": "P580", "e": "P582"} | {k: v for k, v in free.items() if k not in "se" or k in templates.CONSTANTS[n]})).where
    with pytest.raises(Unsupported):
        templates.fill("holders_in_year", p="P39", q0=5)
    with pytest.raises(Unsupported):
        templates.fill("first_value", q0=5)


def test_other_properties(graph):  # noqa: F811
    def of(text):
        return ids(run(graph, sparql.parse(f"SELECT DISTINCT ?x WHERE {{ {text} }}")))

    assert of("wd:Q11 !wdt:P31 ?x") == [51, 52, 100] and of("wd:Q11 !(wdt:P31|wdt:P131) ?x") == [51, 52]
    assert of("wd:Q3 !(^wdt:P31) ?x") == [2, 4, 5, 5] or of("wd:Q3 !(^wdt:P31) ?x") == [2, 4, 5]
    q = sparql.parse("SELECT DISTINCT ?x WHERE { ?x !(wdt:P31|^wdt:P279) wd:Q3 }")
    assert q.where[0].path == Other(("P31",), ("P279",)) and sparql.parse(sparql.print_query(q)).where == q.where
    with pytest.raises(Unsupported):
        sparql.parse("SELECT ?x WHERE { ?x !(wdt:P31/wdt:P279) ?y }")


def test_products_are_refused(graph):  # noqa: F811
    q = sparql.parse("SELECT DISTINCT ?x ?y WHERE { ?x wdt:P10 ?v . ?y wdt:P131 ?w }")
    with pytest.raises(Unsupported):
        run(graph, q)
    assert run(graph, q, products=True).count() == 9
    assert run(graph, sparql.parse("SELECT DISTINCT ?x WHERE { ?x wdt:P10 ?v . ?y wdt:P10 ?w . FILTER(?v = ?w && ?y != ?x) }")).count() == 2


def test_unions_that_say_one_thing_twice(graph):  # noqa: F811
    def of(text):
        return rewrites.simplified(graph, sparql.parse(f"SELECT DISTINCT ?x WHERE {{ {text} }}")).where

    assert isinstance(of("{ ?x wdt:P31 wd:Q3 } UNION { ?x wdt:P31/wdt:P279* wd:Q3 }")[0], Triple)
    assert isinstance(of("{ ?x wdt:P40 wd:Q3 } UNION { ?x wdt:P40/wdt:P17 wd:Q3 }")[0], Triple)
    assert isinstance(of("{ ?x wdt:P40/wdt:P17 wd:Q3 } UNION { ?x wdt:P40 wd:Q3 }")[0], Triple)
    assert isinstance(of("{ ?x wdt:P31 wd:Q3 } UNION { ?x wdt:P31 wd:Q4 }")[0], AnyOf)
    graph.also = {3: (9,)}
    try:
        assert isinstance(of("{ ?x wdt:P31 wd:Q3 } UNION { ?x wdt:P31 wd:Q9 }")[0], Triple)
        assert ids(templates.run_tt(graph, "@wd . thing ( ) ;")) == [11, 12, 13, 14]
    finally:
        graph.also = {}


def test_text_functions(spark):
    def of(value, f, kind="string"):
        return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).collect()[0].x

    assert of("Đà Nẵng Ελλάδα phở й ẛ̣", X.remove_accent) == "Đa Nang Ελλαδα pho и ſ" and of(None, X.remove_accent) is None and of("", X.remove_accent) == ""
    assert of("a  b\tc?", X.spans_in_order) == ["a", "b", "c", "a b", "b c", "a b c"] and of("", X.spans_in_order) == [""] and of(None, X.spans_in_order) == []
    assert of("", X.clean_name) == "_" and of("Über", X.clean_name) == "uber"
    assert len(of(["b" * n for n in range(1, 9)], X.sample_labels, "array<string>")) == 5
    df = spark.createDataFrame([("red lake", ["lake blue", "lake red", "red lake", None]), ("x", ["y"]), (None, ["a"]), ("a", None)], "t string, c array<string>")
    assert [r[0] for r in df.select(X.closest(F.col("t"), F.col("c"))).collect()] == ["lake red", None, None, None]
    assert df.limit(1).select(F.round(X.similarity(F.lit("lake lake red"), F.lit("lake blue"), "jaccard"), 3)).collect()[0][0] == 0.667


def test_answers_as_often_as_listed(spark):
    rows = [(["a", "b"], ["a", "a", "c"], "S", "S"), ([], None, "S", "T")]
    df = spark.createDataFrame(rows, "expected array<string>, predicted array<string>, gold string, query string")
    m = evaluate.answer_metrics(df, queries=("gold", "query")).collect()[0]
    assert round(m.micro_f1, 6) == round(2 / (2 + (1 + 1) / 2), 6) and round(m.precision, 6) == round((2 / 3 + 1) / 2, 6) and m.exact == 0.5
    assert evaluate.answer_metrics(df, distinct=True).collect()[0].exact == 0.5


def test_split_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(5, "x")] * 7 + [(None, "x")] * 3 + [(i, "x") for i in range(10, 40)], "k bigint, n string")
    a, b = evaluate.split_in_two(df, "k")
    assert a.count() + b.count() == 40 and a.agg(F.max("k")).collect()[0][0] == 22 and b.filter("k IS NULL").count() == 3
    a, b = evaluate.split_in_two(df, "k", 3)
    assert (a.count(), b.count()) == (7, 33)
    assert evaluate.split_in_two(df.limit(0), "k")[0].count() == 0


def test_split_narrows_ranges(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SORTED", 3)
    a, b = evaluate.split_in_two(spark.range(5000).selectExpr("(id * 7919) % 5000 AS k"), "k", 1234)
    assert (a.count(), b.count(), a.agg(F.max("k")).collect()[0][0]) == (1234, 3766, 1233)


def test_search_and_addresses(spark):
    e = spark.createDataFrame([("Q9", "Lake Zo"), ("Q10", "lake zo"), ("Q3", None), ("bad", "Mo")], "id string, label string")
    a = spark.createDataFrame([("Q3", "en", "LAKE ZO "), ("Q3", "en", None), ("Q3", "de", "is long")], "id string, lang string, alias string")
    t = spark.createDataFrame([(" Lake Zo",), (None,), ("",), ("?",), (" Lake Zo",)], "text string")
    assert [(r.id, r.rank) for r in linking.searched(t, e, a).orderBy("rank").collect()] == [("Q9", 1), ("Q10", 2), ("Q3", 3)]
    urls = spark.createDataFrame([("http://p/wiki/Lake_Zo?x=1",), ("http://p/wiki/M%6F",), ("http://p/wiki/%zz",), ("http://p/known",), (None,)], "url string")
    known = spark.createDataFrame([("http://p/known", "Q77")], "url string, id string")
    assert {r.url[9:]: r.id for r in linking.ids_of_urls(urls, known, e, a).collect()} == {"wiki/Lake_Zo?x=1"[0:]: "Q9", "wiki/M%6F": "bad", "wiki/%zz": None, "known": "Q77"}
    assert {r.id: list(r.canonical) for r in linking.canonical_names(e, a).collect()}["Q3"] == ["long", "LAKE ZO "]
    assert {r.id: list(r.aliases) for r in linking.alt_labels_of(e, a, "de").collect()}["Q9"] == []


def test_profiles_of_the_graph(graph, spark):  # noqa: F811
    assert {(r.qualifier, r.value) for r in profile.statement_qualifiers(graph, 11, "P40", 51, ("P9",)).collect()} == {("P9", "Q7")}
    r = profile.value_range(graph, 99, "P40", 51, "P580", "P582").collect()[0]
    assert r.least is None and r.most is None
    assert {r.id: r.is_domain for r in profile.domain_entities(graph, spark.createDataFrame([(1,), (11,), (1,)], "id bigint")).collect()} == {1: True, 11: False}
    m = {(r.domain, r.pid): r for r in profile.inferred_manifest(graph, {"thing": 3, "one": 1}, 1, 1).collect()}
    assert m["thing", "P40"].n_statements == 3 and m["thing", "P40"].qualifiers == "P580 P582 P9" and m["one", "P131"].name == "located_in"


def test_sinks(spark, tmp_path, graph):  # noqa: F811
    from triplane.sources import datasets

    e = spark.createDataFrame([("Q1", "Foo (bar)", "city"), ("Q2", None, "city"), ("Q3", "X", None)], "id string, label string, domain_name string")
    datasets.write_parameters(e, str(tmp_path / "par"))
    assert {(r.value, r.canonical) for r in spark.read.json(str(tmp_path / "par")).collect()} == {("Q1", "foo (bar)"), ("Q3", "x")}
    strings = spark.createDataFrame([("brand", "A-b"), ("brand", "A-b"), ("brand", None)], "property string, value string")
    datasets.write_strings(strings, str(tmp_path / "str"))
    assert [(r[0], r[1], r[2]) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "str")).collect()] == [("A-b", "a - b", "1")]
    datasets.write_index(e, strings, str(tmp_path / "idx"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "idx")).collect()] == ["entity\ten-US\twd:city\tparameter-datasets/city", "string\ten-US\twd:p_brand\tparameter-datasets/p_brand"]
    datasets.write_entities(spark.createDataFrame([("city", "city", None)], "name string, canonical string, has_ner boolean"), str(tmp_path / "ent"))
    assert spark.read.json(str(tmp_path / "ent")).collect()[0].type == "wd:city"
    m = profile.inferred_manifest(graph, {"thing": 3}, 1, 1)
    datasets.write_manifest(m, str(tmp_path / "man"))
    back = datasets.read_manifest(spark, str(tmp_path / "man")).select(m.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))


def test_domain_by_size_root_and_depth(spark):
    c = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (3, 99), (3, None), (1, 10)], "s bigint, class bigint")
    t = spark.createDataFrame([(10, 100, 1, 0), (11, 5, 1, 1), (12, 50, 1, 1)], "class bigint, size bigint, root bigint, depth bigint")
    assert {r.s: r["class"] for r in profile.chosen_domains(c, t).collect()} == {1: 12, 2: 10}
