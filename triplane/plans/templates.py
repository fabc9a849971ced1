"""Named query templates with parameters, each written in the query language and run by the planner.

A template is a query text with $0, $1 ... for entity numbers and #Y, #Z for a year and the next. Numbered
patterns of the same algebra share a template.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sparql, tt
from .algebra import Unsupported
from .catalog import Graph
from .planner import run

_P = "http://kg.example/prop"
PREFIXES = f"PREFIX wd: <http://kg.example/entity/> PREFIX wdt: <{_P}/direct/> PREFIX p: <{_P}/> PREFIX ps: <{_P}/statement/> PREFIX pq: <{_P}/qualifier/> "
_START = '"#Y-01-01T00:00:00Z"^^xsd:dateTime'
_NEXT = '"#Z-01-01T00:00:00Z"^^xsd:dateTime'

_MEMBER = "wdt:P31/wdt:P279*"

#: Templates by name. $p, $q, $r ... are properties, $0, $1 ... and $a, $b ... entity numbers; start and end are the qualifiers $s and $e.
TEMPLATES = {
    # Statements of one entity
    "first_value": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?v . ?st pq:$s ?y } ORDER BY ?y LIMIT 1",
    "last_value": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?v . ?st pq:$e ?y } ORDER BY DESC(?y) LIMIT 1",
    "values_in_order": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?v . ?st pq:$s ?y } ORDER BY ?y",
    "values_in_year": f"SELECT DISTINCT ?v WHERE {{ wd:Q$0 p:$p ?st . ?st ps:$p ?v . ?st pq:$s ?y . FILTER(?y < {_NEXT} && ?y >= {_START}) }}",
    "statement_values": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?v }",
    "typed_values": f"SELECT DISTINCT ?v WHERE {{ wd:Q$0 wdt:$p ?v . ?v {_MEMBER} wd:Q$1 }}",
    "offices": "SELECT DISTINCT ?v WHERE { wd:Q$0 wdt:$p ?v . ?v wdt:P31*/wdt:P279* wd:Q$1 }",
    "typed_statement_values": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?v . ?v wdt:P31*/wdt:P279* wd:Q$1 }",
    "value_of_value": "SELECT DISTINCT ?v WHERE { wd:Q$0 wdt:$p/wdt:$q ?v }",
    "start_of_statement": "SELECT DISTINCT ?y WHERE { wd:Q$0 p:$p ?st . ?st ps:$p wd:Q$1 . ?st pq:$s ?y }",
    "last_date_of_statement": "SELECT DISTINCT ?y WHERE { wd:Q$1 p:$p ?st . ?st ps:$p wd:Q$0 . ?st pq:$s ?y } ORDER BY DESC(?y) LIMIT 1",
    "role_in": "SELECT DISTINCT ?v WHERE { wd:Q$1 p:$p ?st . ?st ps:$p wd:Q$0 . ?st pq:$q ?v }",
    "latest_qualifier": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st pq:$s ?y . ?st pq:$q ?v } ORDER BY DESC(?y) LIMIT 1",
    "qualifier_of_typed_value": f"SELECT DISTINCT ?v WHERE {{ wd:Q$0 p:$p ?st . ?st ps:$p ?w . ?st pq:$q ?v . ?w {_MEMBER} wd:Q$a }}",
    "qualifier_of_class": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st pq:$q ?v . ?v wdt:P31 wd:Q$a }",
    "place_of_office": "SELECT DISTINCT ?v WHERE { wd:Q$0 p:$p ?st . ?st ps:$p wd:Q$a . ?st pq:$q ?w . ?w wdt:$r ?v }",
    "first_start_among": "SELECT DISTINCT ?y WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?w . ?w wdt:$q wd:Q$1 . ?st pq:$s ?y } ORDER BY ?y LIMIT 1",
    "last_end_among": "SELECT DISTINCT ?y WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?w . ?w wdt:$q wd:Q$1 . ?st pq:$e ?y } ORDER BY DESC(?y) LIMIT 1",
    # Holders of a value
    "current_holders": "SELECT DISTINCT ?x WHERE { ?x p:$p ?st . ?st ps:$p wd:Q$0 . FILTER NOT EXISTS { ?st pq:$e ?z } }",
    "current_holders_in": "SELECT DISTINCT ?x WHERE { ?x p:$p ?st . ?st ps:$p ?w . ?w wdt:$q wd:Q$0 . FILTER NOT EXISTS { ?st pq:$e ?z } }",
    "current_holders_for": "SELECT DISTINCT ?x WHERE { ?x p:$p ?st . ?st ps:$p wd:Q$a . ?st pq:$q ?w . ?w wdt:$r wd:Q$0 . FILTER NOT EXISTS { ?st pq:$e ?z } }",
    "holders_for_in_year": f"SELECT DISTINCT ?x WHERE {{ ?x p:$p ?st . ?st ps:$p wd:Q$a . ?st pq:$q ?w . ?w wdt:$r wd:Q$0 . ?st pq:$s ?y . ?st pq:$e ?z . FILTER(?y < {_NEXT} && ?z >= {_START}) }}",
    "holders_in_year": f"SELECT DISTINCT ?x WHERE {{ ?x p:$p ?st . ?st ps:$p wd:Q$0 . ?st pq:$s ?y . ?st pq:$e ?z . FILTER(?y < {_NEXT} && ?z >= {_START}) }}",
    "latest_holder_with": "SELECT DISTINCT ?x WHERE { ?x wdt:$q wd:Q$a . ?x p:$p ?st . ?st ps:$p wd:Q$0 . ?st pq:$s ?y } ORDER BY DESC(?y) LIMIT 1",
    "first_time": "SELECT DISTINCT ?y WHERE { ?x p:$p ?st . ?st ps:$p wd:Q$0 . ?st pq:$s ?y } ORDER BY ?y LIMIT 1",
    "last_time": "SELECT DISTINCT ?y WHERE { ?x p:$p ?st . ?st ps:$p wd:Q$0 . ?st pq:$e ?y } ORDER BY DESC(?y) LIMIT 1",
    # Statements of the members of a class or series
    "statement_of_instance": f"SELECT DISTINCT ?x WHERE {{ ?w {_MEMBER} wd:Q$1 . ?w p:$p ?st . ?st ps:$p ?x }}",
    "instances_with_statement": f"SELECT DISTINCT ?x WHERE {{ ?x {_MEMBER} wd:Q$1 . ?x p:$p ?st . ?st ps:$p wd:Q$0 }}",
    "dates_of_member": "SELECT DISTINCT ?y WHERE { ?w wdt:$q wd:Q$0 . ?w p:$p ?st . ?st ps:$p wd:Q$1 . ?w wdt:$t ?y }",
    "last_date_of_member": "SELECT DISTINCT ?y WHERE { ?w wdt:$q wd:Q$a . ?w p:$p ?st . ?st ps:$p wd:Q$0 . ?w wdt:$t ?y } ORDER BY DESC(?y) LIMIT 1",
    "first_date_of_member": "SELECT DISTINCT ?y WHERE { ?w wdt:$q wd:Q$a . ?w p:$p ?st . ?st ps:$p wd:Q$0 . ?w wdt:$t ?y } ORDER BY ?y LIMIT 1",
    "last_date_of_instance": "SELECT DISTINCT ?y WHERE { ?w wdt:P31 wd:Q$1 . ?w p:$p ?st . ?st ps:$p wd:Q$0 . ?w wdt:$t ?y } ORDER BY DESC(?y) LIMIT 1",
    "latest_instance_with": f"SELECT DISTINCT ?x WHERE {{ ?x {_MEMBER} wd:Q$a . ?x p:$p ?st . ?st ps:$p wd:Q$0 . ?x wdt:$t ?y }} ORDER BY DESC(?y) LIMIT 1",
    "first_instance_by": "SELECT DISTINCT ?x WHERE { ?x wdt:P31 wd:Q$a . ?x wdt:$p wd:Q$0 . ?x wdt:$t ?y } ORDER BY ?y LIMIT 1",
    "first_value_in_parts": "SELECT DISTINCT ?x WHERE { ?s wdt:$q wd:Q$1 . ?s wdt:$t ?y . ?s wdt:$r ?w . ?w p:$p ?st . ?st ps:$p ?x . ?st pq:$u wd:Q$0 } ORDER BY ?y LIMIT 1",
    "parts_with_statement": "SELECT DISTINCT ?x WHERE { ?s wdt:$q wd:Q$0 . ?s wdt:$r ?x . ?x p:$p ?st . ?st ps:$p wd:Q$1 }",
    "nth_by_value": f"SELECT DISTINCT ?x WHERE {{ ?x {_MEMBER} wd:Q$0 . ?x wdt:$p ?v }} ORDER BY DESC(?v) LIMIT 1 OFFSET 1",
    "top_by_value": f"SELECT DISTINCT ?x WHERE {{ ?x {_MEMBER} wd:Q$0 . ?x wdt:$p ?v }} ORDER BY DESC(?v) LIMIT 1",
    # Two statements whose times meet
    "same_start": "SELECT DISTINCT ?x WHERE { wd:Q$0 p:$p ?a . ?a pq:$s ?y . ?x p:$p ?b . ?b pq:$s ?y }",
    "holder_since_same_day": "SELECT DISTINCT ?x WHERE { ?x p:$p ?a . ?a ps:$p wd:Q$b . ?a pq:$s ?y . wd:Q$0 p:$p ?c . ?c ps:$p wd:Q$a . ?c pq:$s ?z . FILTER(?y = ?z) }",
    "value_at_date_of": "SELECT DISTINCT ?x WHERE { wd:Q$a p:$p ?st . ?st ps:$p ?x . ?st pq:$s ?y . ?st pq:$e ?z . wd:Q$b wdt:$t ?w . FILTER(?y < ?w && ?z >= ?w) }",
    "value_begun_during": "SELECT DISTINCT ?x WHERE { wd:Q$0 p:$p ?st . ?st ps:$p ?x . ?st pq:$s ?y . wd:Q$1 wdt:$s ?w . wd:Q$1 wdt:$e ?v . FILTER(?y >= ?w && ?y <= ?v) }",
    "holder_within": "SELECT DISTINCT ?x WHERE { ?x p:$p ?a . ?a ps:$p wd:Q$2 . ?a pq:$s ?y . ?a pq:$e ?z . wd:Q$1 p:$p ?c . ?c ps:$p wd:Q$0 . ?c pq:$s ?w . ?c pq:$e ?v . FILTER(?y >= ?w && ?z <= ?v) }",
    "holders_during": "SELECT DISTINCT ?x WHERE { wd:Q$0 p:$p ?a . ?a pq:$s ?s . ?a pq:$e ?e . ?x p:$p ?b . ?b ps:$p wd:Q$1 . ?b pq:$s ?t . FILTER(?t >= ?s && ?t <= ?e) }",
}

#: Templates of the numbered patterns: those about one entity's values or a class's members, and those about statements that meet others.
PATTERNS = {1: "describe", 12: "typed_values", 13: "nth_by_value", 14: "top_by_value", 20: "typed_statement_values", 21: "values_in_order", 25: "first_value", 29: "value_of_value", 35: "first_value", 36: "first_value"}
STATEMENT_PATTERNS = {
    2: "current_holders_for",
    3: "current_holders_for",
    4: "holders_for_in_year",
    5: "place_of_office",
    6: "first_start_among",
    7: "last_end_among",
    8: "holder_since_same_day",
    9: "offices",
    10: "value_at_date_of",
    11: "instances_with_statement",
    15: "values_in_year",
    16: "qualifier_of_typed_value",
    17: "dates_of_member",
    18: "dates_of_member",
    19: "last_date_of_member",
    22: "latest_instance_with",
    23: "first_date_of_member",
    24: "last_date_of_statement",
    26: "first_instance_by",
    27: "latest_qualifier",
    28: "latest_holder_with",
    30: "first_value_in_parts",
    31: "qualifier_of_class",
    32: "statement_values",
    33: "last_date_of_instance",
    34: "role_in",
    37: "role_in",
    38: "value_begun_during",
    39: "parts_with_statement",
    40: "holder_within",
}
#: The properties and entities that are constant in the numbered patterns.
CONSTANTS: dict[int, dict] = {
    2: {"p": "P39", "q": "P768", "r": "P131", "a": 4416090},
    3: {"p": "P39", "q": "P768", "r": "P131", "a": 13218630},
    4: {"p": "P39", "q": "P768", "r": "P131", "a": 4416090},
    5: {"p": "P39", "q": "P768", "r": "P131", "a": 4416090},
    6: {"p": "P54", "q": "P118"},
    7: {"p": "P54", "q": "P118"},
    8: {"p": "P39", "a": 11696, "b": 11699},
    9: {"p": "P39", "1": 294414},
    10: {"p": "P6", "t": "P571", "a": 30, "b": 742787},
    11: {"p": "P161"},
    12: {"p": "P54", "1": 18558301},
    13: {"p": "P2046", "0": 107390},
    14: {"p": "P1082", "0": 107390},
    15: {"p": "P1346", "s": "P585"},
    16: {"p": "P69", "q": "P512", "a": 38723},
    17: {"p": "P1923", "q": "P3450", "t": "P585"},
    18: {"p": "P1346", "q": "P3450", "t": "P585"},
    19: {"p": "P1346", "q": "P3450", "t": "P585", "a": 265538},
    20: {"p": "P39", "1": 294414},
    21: {"p": "P527"},
    22: {"p": "P161", "t": "P577", "a": 11424},
    23: {"p": "P161", "q": "P179", "t": "P577", "a": 162371},
    24: {"p": "P1346", "s": "P585"},
    25: {"p": "P54"},
    26: {"p": "P175", "t": "P577", "a": 482994},
    27: {"p": "P39", "q": "P768"},
    28: {"p": "P54", "q": "P413", "a": 622747},
    29: {"p": "P551", "q": "P17"},
    30: {"p": "P725", "q": "P179", "t": "P580", "r": "P527", "u": "P453"},
    31: {"p": "P19", "q": "P131", "a": 6256},
    32: {"p": "P279"},
    33: {"p": "P1923", "t": "P585"},
    34: {"p": "P527", "q": "P3831"},
    35: {"p": "P35"},
    36: {"p": "P26"},
    37: {"p": "P527", "q": "P3831"},
    38: {"p": "P6"},
    39: {"p": "P161", "q": "P179", "r": "P527"},
    40: {"p": "P39"},
}
_MARK = re.compile(r"\$(\w)")


def fill(name: str, year: int | None = None, **parameters) -> str:
    """A template's text. Entities are given as q0, q1 ... or 0, 1 ...; start and end are P580 and P582 unless s and e say otherwise."""
    if name not in TEMPLATES:
        raise Unsupported(f"unknown template {name}")
    given = {"s": "P580", "e": "P582"} | {k[1:] if len(k) == 2 and k[0] == "q" else k: v for k, v in parameters.items()}

    def value(m: re.Match) -> str:
        if m[1] not in given:
            raise Unsupported(f"template {name} needs ${m[1]}")
        return str(given[m[1]])

    text = _MARK.sub(value, TEMPLATES[name])
    if "#Y" in text:
        if year is None:
            raise Unsupported(f"template {name} needs a year")
        text = text.replace("#Y", f"{year:04}").replace("#Z", f"{year + 1:04}")
    return PREFIXES + text


def template(graph: Graph, name: str, year: int | None = None, **parameters) -> DataFrame:
    """Run a template; q0, q1 ... are entity numbers, p and q properties."""
    return run(graph, sparql.parse(fill(name, year, **parameters)))


def pattern(graph: Graph, number: int, year: int | None = None, **parameters) -> DataFrame:
    """Run a numbered pattern. Its constant properties and entities are those of CONSTANTS unless parameters give others. Pattern 1 describes q0.

    A statement has no name of its own here: pattern 11 gives the instances whose statement it is.
    """
    name = (PATTERNS | STATEMENT_PATTERNS).get(number)
    if name is None:
        raise Unsupported(f"no pattern {number}")
    if name == "describe":
        return describe(graph, parameters["q0"])
    given = {k[1:] if len(k) == 2 and k[0] == "q" else k: v for k, v in parameters.items()}
    return run(graph, sparql.parse(fill(name, year, **(CONSTANTS[number] | given))))


def describe(graph: Graph, entity: int) -> DataFrame:
    """[id, text]: the description of an entity."""
    return graph.descriptions().filter(F.col("id") == entity).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("id"), "text")


def run_tt(graph: Graph, program: str, strict: bool = True) -> DataFrame:
    return run(graph, tt.parse(graph, program, strict))


def run_sparql(graph: Graph, text: str) -> DataFrame:
    return run(graph, sparql.parse(PREFIXES + text if "PREFIX" not in text.upper() else text))


def tt_to_sparql(graph: Graph, program: str) -> str:
    """A TT program as a query text."""
    return sparql.print_query(tt.parse(graph, program))


def answers(result: DataFrame) -> list[str]:
    """A result as the list of its first column's values; yes/no questions as "true" or "false". For results that a person reads."""
    first = result.columns[0]
    return [r[0] for r in result.select(F.col(first).cast("string")).filter(F.col(first).isNotNull()).toLocalIterator()]


def sparql_to_tt(graph: Graph, text: str) -> str:
    """A query text as a TT program."""
    from .decompile import program_of
    from .rewrites import simplified

    return program_of(graph, simplified(graph, sparql.parse(text)))
