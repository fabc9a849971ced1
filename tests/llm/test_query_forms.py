"""Canonical forms of queries by tokens: literals whole, groups in order, lists taken apart, variables numbered."""

import random

import pytest

from triplane.llm import canonical, crosssplit, formdupes

form, meaning = formdupes.nested_form, canonical.query_meaning
UNION = "SELECT ?x { { ?x wdt:P1 wd:Q1 . ?x wdt:P2 wd:Q2 } UNION { ?x wdt:P3 wd:Q3 } ?x wdt:P4 wd:Q4 }"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (UNION, UNION.replace("?x wdt:P1 wd:Q1 . ?x wdt:P2 wd:Q2", "?x wdt:P2 wd:Q2 . ?x wdt:P1 wd:Q1"), True),
        (UNION, "select ?x{?x wdt:p4 wd:q4.{ ?x wdt:P1 wd:Q1 . ?x wdt:P2 wd:Q2 } UNION { ?x wdt:P3 wd:Q3 }}", True),
        ("ASK { ?a p:P1 ?b . OPTIONAL { ?b p:P2 ?c } ?c p:P3 ?d }", "ASK { ?c p:P3 ?d . OPTIONAL { ?b p:P2 ?c } ?a p:P1 ?b }", False),
        ("ASK { ?a p:P1 ?b . FILTER NOT EXISTS { ?b p:P2 ?c . ?c p:P3 ?d } }", "ASK { FILTER NOT EXISTS { ?c p:P3 ?d . ?b p:P2 ?c } ?a p:P1 ?b }", True),
        ('ASK { ?x rdfs:label "St. Mary . b" . ?x p:P1 ?y }', 'ASK { ?x p:P1 ?y . ?x rdfs:label "St. Mary . b" }', True),
        ('ASK { ?x rdfs:label "St. Mary" }', 'ASK { ?x rdfs:label "st. mary" }', False),
        ('ASK { ?x rdfs:label "a  b" }', 'ASK { ?x rdfs:label "a b" }', False),
        ('SELECT ?x { ?x p:P1 "a"@en ; p:P2 wd:Q2 , wd:Q3 ; p:P4 "5"^^xsd:int . }', 'SELECT ?x { ?x p:P2 wd:Q3 . ?x p:P4 "5"^^xsd:int . ?x p:P1 "a"@en . ?x p:P2 wd:Q2 }', True),
        ("ASK { ?x p:P1 ?v . FILTER(?v > -2) }", "ASK { FILTER(?v>-2) ?x p:P1 ?v }", True),
        ("ASK { ?x p:P1 ?v . FILTER(?v > -2) }", "ASK { FILTER(?v>2) ?x p:P1 ?v }", False),
        ("ASK { wd:Q1 p:P1 wd:Q2 }", "ASK { wd:Q2 p:P1 wd:Q1 }", False),
        ("SELECT ?x { ?x p:P1 ?y", "SELECT ?x { ?x p:P1 ?y", True),
        ("", " \n ", True),
    ],
)
def test_forms(a, b, same):
    assert (form(a) == form(b)) is same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("SELECT ?x { ?x wdt:P26 ?y . ?y wdt:P19 wd:Q5 }", "SELECT ?y { ?x wdt:P26 ?y . ?x wdt:P19 wd:Q5 }", False),
        ("SELECT ?x { ?x wdt:P26 ?y . ?y wdt:P19 wd:Q5 }", "SELECT DISTINCT ?b WHERE { ?a wdt:P19 wd:Q5 . ?b wdt:P26 ?a . } LIMIT 1000", True),
        ("SELECT ?x { ?x wdt:P1 ?a . ?x wdt:P1 ?b . ?a wdt:P2 ?b }", "SELECT ?z { ?z wdt:P1 ?b . ?b wdt:P2 ?a . ?z wdt:P1 ?a }", True),
        ("PREFIX e: <http://kg.example/entity/> ASK { e:Q1 wdt:P1 e:Q2 }", "ASK { wd:Q1 <http://kg.example/prop/direct/P1> wd:Q2 }", True),
        ('ASK { ?x rdfs:label "limit 1000 distinct where ?x" }', 'ASK { ?x rdfs:label "?x" }', False),
        ("SELECT ?x { ?x p:P1 ?y } LIMIT 1000", "SELECT ?x { ?x p:P1 ?y } LIMIT 100", False),
        ("SELECT (COUNT(DISTINCT ?x) AS ?n) { ?x p:P1 ?y }", "SELECT (COUNT(?x) AS ?n) { ?x p:P1 ?y }", True),
        (UNION, UNION.replace("?x", "?uri").replace("SELECT", "select distinct"), True),
    ],
)
def test_meanings(a, b, same):
    assert (meaning(a) == meaning(b)) is same


def test_flat_queries_take_the_same_form_by_tokens(monkeypatch):
    rnd = random.Random(30)
    terms = ["?x", "?y", "?V", "wd:Q1", "wdt:P31/wdt:P279*", "<http://kg.example/entity/Q3>", "wdt:P2", "2.5", "-3", "p:P9"]
    queries = []
    for _ in range(400):
        body = [" ".join(rnd.choices(terms, k=3)) for _ in range(rnd.randint(1, 4))] + ["FILTER(?V > -2.5)"] * rnd.randint(0, 1)
        rnd.shuffle(body)
        queries.append(rnd.choice(["SELECT DISTINCT ?x WHERE", "SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE", "SELECT (COUNT(DISTINCT(?x)) AS ?n)", "ask", "PREFIX wd: <http://kg.example/entity/>\nSELECT ?x"]) + "{ " + rnd.choice([" . ", "\n. ", ".  "]).join(body) + rnd.choice([" }", " . } ORDER BY DESC(?V) LIMIT 1000"]))
    fast = [(form(q), meaning.__wrapped__(q)) for q in queries]
    monkeypatch.setattr(canonical, "_flat", lambda q: None)
    assert [(form(q), meaning.__wrapped__(q)) for q in queries] == fast


def test_links_of_classes(spark):
    q, other = "ASK { wd:Q1 wdt:P2 wd:Q3 }", "ASK { wd:Q1 wdt:P2 wd:Q4 }"
    rows = [(1, "who owns lake zanebo", q, "train"), (2, "Who owns Lake Zanebo?", q, "train"), (3, "who owns lake zanebo", q, "dev"), (4, "who owned lake zanebo", q, "test"), (5, "who owns lake zanebo", other, "test"), (6, None, q, "dev"), (7, "a far other text", q, "dev")]
    df = spark.createDataFrame(rows, "row_id bigint, utterance string, sparql string, split string").selectExpr("*", "0 AS class_id", "'x' AS q1")
    assert sorted(map(tuple, crosssplit.linked(df).collect())) == [(1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 4, 1)]
    assert crosssplit.linked(df.limit(0)).collect() == []
