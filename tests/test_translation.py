"""Programs through the query language and back: the answers stay the same; and rewrites of queries."""

import pytest

from test_engine import graph, ids  # noqa: F401
from triplane.plans import rewrites, sparql, templates, tt
from triplane.plans.algebra import Prop, Repeat, Seq, Unsupported

PROGRAMS = [
    "@wd . thing ( ) ;", "@wd . entity ( ) filter size >= 5 ;", "@wd . thing ( ) filter ! ( size == null ) ;", '@wd . entity ( ) filter contains ( office , " Q51 " ^^wd:x ) && size >= 5 ;', '[ office ] of @wd . entity ( ) filter id == " Q11 " ^^wd:x ;',
    "[ office filter point_in_time == new Date ( 2000 ) ] of @wd . entity ( ) ;", "[ office filter end_time == null ] of @wd . entity ( ) ;", '[ role of ( office filter value == " Q51 " ^^wd:x ) ] of @wd . entity ( ) ;', "[ office . role ] of @wd . thing ( ) ;",
    "sort ( size desc of @wd . thing ( ) ) [ 1 ] ;", "sort ( size asc of @wd . thing ( ) ) [ 2 : 3 ] ;", "count ( @wd . thing ( ) ) ;", "max ( size of @wd . thing ( ) ) ;", '[ contains ( office , " Q51 " ^^wd:x ) ] of @wd . entity ( ) filter id == " Q12 " ^^wd:x ;',
    '@wd . entity ( ) filter ( contains ( office , " Q51 " ^^wd:x ) || contains ( office , " Q52 " ^^wd:x ) ) ;', '@wd . entity ( ) filter contains ( office filter ( point_in_time == new Date ( 2000 ) ) , " Q51 " ^^wd:x ) ;', "[ < located_in / located_in > ] of @wd . entity ( ) ;",
    '@wd . entity ( ) filter contains~ ( office , "mayor" ) ;', "@wd . thing ( ) filter count ( size ) >= 1 && size >= 5 ;", "[ size ] of @wd . thing ( ) filter size >= 5 ;", '@wd . entity ( ) filter size >= any ( [ size ] of @wd . entity ( ) filter id == " Q12 " ^^wd:x ) ;',
]


@pytest.mark.parametrize("program", PROGRAMS)
def test_there_and_back(graph, program):  # noqa: F811
    text = templates.tt_to_sparql(graph, program)
    back = templates.sparql_to_tt(graph, text)
    assert ids(templates.run_tt(graph, back)) == ids(templates.run_tt(graph, program))


@pytest.mark.parametrize("text", ["SELECT ?x ?y WHERE { ?x wdt:P10 ?y }", "SELECT ?x WHERE { ?x wdt:P10 ?v . OPTIONAL { ?x wdt:P31 ?c } }", "SELECT ?x WHERE { ?x wdt:P10 ?v . BIND(COALESCE(?v) AS ?w) }", "SELECT ?x WHERE { ?x ^wdt:P31 ?y }", "SELECT ?x WHERE { ?x wdt:P777 ?y }"])
def test_no_program(graph, text):  # noqa: F811
    with pytest.raises(Unsupported):
        templates.sparql_to_tt(graph, text)


def test_rewrites(graph):  # noqa: F811
    q = sparql.parse("SELECT DISTINCT ?x WHERE { ?x wdt:P31 wd:Q3 . ?x wdt:P131 ?m . ?m wdt:P40 ?v . ?v wdt:P10 wd:Q5 . ?x wdt:P131|wdt:P40 ?z }")
    assert rewrites.properties_used(q) == ["P31", "P131", "P40", "P10"] and rewrites.entities_used(q) == [3, 5]
    assert rewrites.inlined(q).where[1].path == Seq((Prop("P131"), Prop("P40"), Prop("P10")))
    assert rewrites.expanded(q).where[0].path == Seq((Prop("P31"), Repeat(Prop("P279"), True))) and rewrites.expanded(q).where[1].path == Repeat(Prop("P131"), False)
    assert rewrites.abstracted(graph, q).where[-1].path == Prop("P99")
    assert ("P131", 3) in rewrites.property_domains(q)
    p = '@wd . thing ( ) filter id == " Q11 " ^^wd:x && size >= 2 ;'
    assert ids(templates.run_tt(graph, rewrites.normalized(graph, p))) == ids(templates.run_tt(graph, p)) == [11]
    assert rewrites.normalized(graph, p, "never") == p and "entity" in rewrites.normalized(graph, p, "id") and rewrites.normalized(graph, "@wd . one ( ) ;", "id") == "@wd . one ( ) ;"
    assert rewrites.intents(p) == ["@wd.thing", "Q11"]
    assert tt.parse(graph, "@wd . thing ( ) filter size == 5 ;") == tt.parse(graph, "@wd.thing() filter size == 5;")


def test_stream(spark, tmp_path):
    from triplane.streaming import events

    rows = [(i, f"2024-01-01 0{h}:10:00", i % 3, t, 1.0, None) for i, (h, t) in enumerate([(0, "a"), (0, "a"), (1, "b"), (5, "a"), (0, "b")])]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "CAST(ts AS TIMESTAMP) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(str(r.start), r.event_type): r.n for r in spark.table("counts").collect()}
    assert got[("2024-01-01 00:00:00", "a")] == 2 and got[("2024-01-01 01:00:00", "b")] == 1


def test_patterns_name_only_templates_of_their_algebra():
    from triplane.plans.templates import PATTERNS, TEMPLATES

    assert set(PATTERNS.values()) <= {"describe", *TEMPLATES}
    assert not {6, 16, 34, 37, 40} & set(PATTERNS)
