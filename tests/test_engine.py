"""Parsers, planner rules, paths, text functions and sources on hand-made cases."""

import pytest

from triplane.functions import text as X
from triplane.operators import evaluate, linking, paths
from triplane.plans import sparql, templates, tt
from triplane.plans.algebra import Absent, Alt, Ent, Prop, Repeat, Seq, Stmt, Triple, Unsupported, Var
from triplane.plans.catalog import Abstract, Graph, Property
from triplane.plans.planner import run


@pytest.fixture(scope="module")
def graph(spark):
    """Classes with a chain, a diamond and a cycle; people with values that equal a bound, several values or none."""
    E = lambda rows, v="bigint": (lambda: spark.createDataFrame(rows, f"s bigint, v {v}"))
    st = spark.createDataFrame(
        [(11, 51, "2001-01-01", "2003-01-01", 7), (11, 52, "2003-01-01", None, None), (12, 51, "1999-05-05", "2000-01-01", 8), (13, None, None, None, None)],
        "s bigint, v bigint, a string, b string, q_P9 bigint",
    ).selectExpr("s", "v", "CAST(a AS TIMESTAMP_NTZ) q_P580", "CAST(b AS TIMESTAMP_NTZ) q_P582", "q_P9")
    properties = [
        Property("P31", "instance_of", "entity", E([(11, 1), (12, 2), (13, 3), (13, 2), (14, 9)])), Property("P279", "subclass_of", "entity", E([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 3), (5, 3)])),
        Property("P131", "located_in", "entity", E([(11, 100), (100, 101), (101, 102)])), Property("P10", "size", "value", E([(11, 5.0), (11, 7.0), (12, 6.0), (13, 5.0)], "double")),
        Property("P40", "office", "entity", lambda: st, {"P580": "value", "P582": "value", "P9": "entity"}), Property("P9", "role", "entity", E([])), Property("P580", "start_time", "value", E([], "timestamp_ntz")), Property("P582", "end_time", "value", E([], "timestamp_ntz")),
    ]
    labels = spark.createDataFrame([(51, "Mayor"), (52, "Chief"), (11, "Zoë")], "id bigint, label string")
    return Graph(spark, properties, {"entity": 0, "thing": 3, "one": 1}, lambda: labels, [Abstract("P99", "any_place", "any", ["P131", "P40"])], {"P131"})


def ids(df):
    return sorted(int(r[0][1:]) if isinstance(r[0], str) and r[0][:1] == "Q" else r[0] for r in df.collect())


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ("@wd . thing ( ) ;", [11, 12, 13]), ("@wd . one ( ) ;", [11]), ("@wd . entity ( ) filter size >= 5 ;", [11, 12]), ("@wd . entity ( ) filter size >= 6 && size <= 8 ;", [11]), ("@wd . entity ( ) filter ! ( size == null ) ;", [11, 12, 13]),
        ('@wd . entity ( ) filter contains ( located_in , " Q102 " ^^wd:x ) ;', [11, 100, 101]), ("@wd . thing ( ) filter count ( size ) >= 1 ;", [11, 12, 13]), ("@wd . thing ( ) filter count ( office ) >= 1 && size == 5 ;", [11]),
        ("[ office filter point_in_time == new Date ( 2000 ) ] of @wd . entity ( ) ;", [51]), ("[ office filter end_time == null ] of @wd . entity ( ) ;", [52]), ('[ role of ( office filter value == " Q51 " ^^wd:x ) ] of @wd . entity ( ) ;', [7, 8]),
        ('@wd . entity ( ) filter contains~ ( office , "mayor" ) ;', [11, 12]), ('@wd . entity ( ) filter id =~ "zoë" && size >= 1 ;', [11]), ("sort ( size desc of @wd . thing ( ) ) [ 1 ] ;", [11]), ("sort ( size asc of @wd . thing ( ) ) [ 2 : 3 ] ;", [12, 13]),
        ("count ( @wd . thing ( ) ) ;", [3]), ("max ( size of @wd . thing ( ) ) ;", [7.0]), ('[ office ] of @wd . entity ( ) filter id == " Q11 " ^^wd:x ;', [51, 52]), ('[ contains ( office , " Q51 " ^^wd:x ) ] of @wd . entity ( ) filter id == " Q12 " ^^wd:x ;', [True]),
        ('[ contains ( office , " Q52 " ^^wd:x ) ] of @wd . entity ( ) filter id == " Q12 " ^^wd:x ;', [False]), ('@wd . entity ( ) filter size >= any ( [ size ] of @wd . entity ( ) filter id == " Q12 " ^^wd:x ) ;', [11]), ("[ any_place ] of @wd . entity ( ) ;", [51, 100, 101, 102]),
        ('@wd . entity ( ) filter contains ( office , " Q51 " ^^wd:x ) || size >= 6 ;', [11, 12]), ("sort ( count ( size ) desc of @wd . thing ( ) ) [ 1 ] ;", [11]),
    ],
)
def test_programs(graph, program, want):
    assert ids(templates.run_tt(graph, program)) == want
    # The same program as a query text has the same answers.
    if "abstract" not in program and "any_place" not in program and "located_in" not in program:
        text = templates.tt_to_sparql(graph, program)
        assert ids(run(graph, sparql.parse(text))) == want


@pytest.mark.parametrize("program", ["@wd . nowhere ( ) ;", "@wd . thing ( ) filter nothing >= 2 ;", "[ count >= 2 ] of count ( @wd . thing ( ) ) ;", "@wd . thing ( ) filter size == enum blue ;", "@wd . thing ( ) => notify ;", "@wd . thing ( ) [ 1 , 2 ] ;", "§"])
def test_programs_refused(graph, program):
    with pytest.raises(Unsupported):
        templates.run_tt(graph, program).collect()


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x ?p ?y }", "SELECT ?x WHERE { ?x foo:P1 ?y }", "SELECT ?x WHERE { ?x wdt:P1 ?y } MINUS", "SELECT ?x WHERE { ?s pq:P1 ?y }", "DESCRIBE wd:Q1"])
def test_queries_refused(text):
    with pytest.raises(Unsupported):
        sparql.parse(text)


def test_parse():
    q = sparql.parse("PREFIX a: <http://h/prop/direct/> SELECT DISTINCT ?x WHERE { ?x a:P31/a:P279* <http://h/entity/Q5> ; a:P1|^a:P2 ?y . ?x p:P3 ?s . ?s ps:P3 wd:Q7 . FILTER NOT EXISTS { ?s pq:P4 ?z } }")
    assert q.where[0] == Stmt(Var("x"), "P3", Ent(7), (), ("P4",))
    assert q.where[1] == Triple(Var("x"), Seq((Prop("P31"), Repeat(Prop("P279"), True))), Ent(5)) and isinstance(q.where[2].path, Alt)
    assert any(isinstance(p, Absent) for p in sparql.parse("ASK { ?x wdt:P1 ?y FILTER NOT EXISTS { ?y wdt:P2 ?z } }").where)
    assert sparql.parse(sparql.print_query(q)) == q
    assert tt.UNITS["km"] == 1000


def test_paths_distributed(spark, monkeypatch):
    """Beyond the driver's bound the rounds run as jobs, with the same result: cycles, a diamond, an isolated seed, nulls, repeats."""
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (1, 5), (5, 4), (7, 7), (None, 1), (8, None), (1, 2)]
    edges = spark.createDataFrame(rows, "s bigint, v bigint")
    seeds = spark.createDataFrame([(1,), (9,), (1,)], "n bigint")
    results = []
    for bound in (paths.SMALL, 3):
        monkeypatch.setattr(paths, "SMALL", bound)
        results.append([sorted(tuple(r) for r in df.collect()) for df in (paths.closure(edges), paths.closure(edges, True), paths.reach(edges, seeds), paths.reach(edges, seeds, zero=True), paths.reach(edges, seeds, backward=True), paths.closure(edges.limit(0)), paths.reach(edges.limit(0), seeds, zero=True))])
    assert results[0] == results[1]
    assert results[0][2] == [(1,), (2,), (3,), (4,), (5,)] and (9,) in results[0][3] and (7, 7) in results[0][0] and results[0][5] == []


def test_text_functions(spark):
    def of(value, f, kind="string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).collect()[0].x

    assert of("Größe (u.s.) 10%", X.clean_name) == "gro_e_us_1_" and of("1st", X.clean_name) == "_1st" and of("class", X.clean_name) == "_class" and of(None, X.clean_name) is None
    assert of("a b c", X.spans) == ["a b c", "a b", "b c", "a", "b", "c"] and of("", X.spans) == []
    assert [of(v, X.value_kind) for v in ("Q5", "3.5", "2020-01-01", "x", None)] == ["entity", "number", "date", "string", None]
    assert of(["is member", "in the club!", "member of", "of", "ab"], lambda c: X.sample_labels(c, 3), "array<string>") == ["of", "ab", "member"]
    assert of("end?!", X.remove_end_punctuation) == "end?"
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("cities of the river", "river city"), ("the of", "x"), (None, "x"), ("a b", "c")], "a string, b string")
    assert [r[0] for r in df.select(F.round(X.similarity(F.col("a"), F.col("b")), 3)).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_metrics(spark):
    rows = [(["a"], ["a"]), ([], []), (["a"], None), (["a", "b"], ["b", "c"]), (["a", "b"], ["a", "a", "b"])]
    m = evaluate.answer_metrics(spark.createDataFrame(rows, "expected array<string>, predicted array<string>")).collect()[0]
    assert m.n == 5 and round(m.precision, 4) == round((1 + 1 + 1 + 0.5 + 1) / 5, 4)
    assert round(m.recall, 4) == round((1 + 1 + 0 + 0.5 + 1) / 5, 4) and m.exact == 0.6 and m.hits_at_1 == 0.8


def test_datasets(spark, tmp_path):
    from triplane.sources import datasets

    f = tmp_path / "q.json"
    f.write_text('{"questions": [{"id": "1", "question": [{"language": "en", "string": "who?"}], "query": {"sparql": "ASK {}"}, "answers": [{"head": {}, "boolean": true}]}, {"id": "2", "question": [{"string": "what"}], "query": {"sparql": "S"}, "answers": [{"results": {"bindings": [{"x": {"type": "uri", "value": "http://h/entity/Q5"}}, {"x": {"type": "literal", "value": "7"}}]}}]}]}')
    got = datasets.read_questions(spark, str(f)).collect()
    assert [list(r.answers) for r in got] == [["true"], ["Q5", "7"]] and got[0].utterance == "who?"
    assert [r.id for r in datasets.read_questions(spark, str(f), offset=1).collect()] == ["2"]
    rows = spark.createDataFrame([("a-1", 'say "x"', "p ;")], "id string, utterance string, thingtalk string")
    datasets.write_programs(rows, str(tmp_path / "tsv"))
    assert datasets.read_programs(spark, str(tmp_path / "tsv")).collect() == rows.collect()
    (tmp_path / "pred.tsv").write_text("1\tu\tQ1 Q2\tS\n2\tu\t\tS\n")
    assert [list(r.answers) for r in datasets.read_predictions(spark, str(tmp_path / "pred.tsv")).orderBy("id").collect()] == [["Q1", "Q2"], []]
    datasets.write_parameters(spark.createDataFrame([("Q1", "Foo", "city")], "id string, label string, domain_name string"), str(tmp_path / "par"))
    assert spark.read.json(str(tmp_path / "par")).collect()[0].canonical == "foo"


def test_split_and_sets(spark):
    rows = spark.range(11).withColumnRenamed("id", "k")
    a, b = evaluate.split_in_two(rows, "k")
    assert (a.count(), b.count()) == (5, 6) and evaluate.split_in_two(rows, "k", 0)[0].count() == 0 and evaluate.split_in_two(rows, "k", 50)[1].count() == 0
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.id for r in evaluate.intersection([one("a", "a", "b"), one("a", "b"), one("a")]).collect()) == ["a", "a"]
    assert [r.id for r in evaluate.newly_failed(one("a"), one("a", "b")).collect()] == ["b"]
    cache = spark.createDataFrame([("k", "1")], "key string, value string")
    new = spark.createDataFrame([("k", "2"), ("n", "4"), ("n", "3")], "key string, value string")
    assert sorted(map(tuple, linking.add_if_absent(cache, new).collect())) == [("k", "1"), ("n", "3")]


def test_plan_shapes(graph, spark):
    """A membership test is a semi join, and a comparison with a separate pattern joins one row, not two growing sides."""
    def explained(text):
        return run(graph, sparql.parse(text))._jdf.queryExecution().optimizedPlan().toString()

    assert "LeftSemi" in explained("SELECT DISTINCT ?x WHERE { ?x wdt:P31 wd:Q2 . ?x wdt:P10 ?v }")
    assert "Cartesian" not in run(graph, sparql.parse("SELECT DISTINCT ?x WHERE { ?x wdt:P10 ?v . wd:Q12 wdt:P10 ?w . FILTER(?v > ?w) }"))._jdf.queryExecution().toString()


def test_end_punctuation_of_all_utterances(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["one?", "two\nlines.", "a.\n", "b!\r\n", None, "", "c?!"]
    spark.createDataFrame(list(enumerate(texts)), "row_id bigint, utterance string").write.parquet(f"{tmp_path}/examples.parquet")
    got = {r.row_id: r.text for r in entry.queries()["remove_end_punctuation_all"](spark, str(tmp_path)).collect()}
    assert got == {0: "one", 1: "two\nlines", 2: "a.\n", 3: "b!\r\n", 5: "", 6: "c?"}
