"""Graphs over tables: each property is a lazy DataFrame [s, v], with qualifiers a wide one [s, v, q_<pid> ...].

Entities are BIGINT numbers inside the engine. A property is of kind "entity" or "value". Multi-valued
properties are several rows; one row is one statement, so a qualifier is a column beside its value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import numbers_frame, table
from .algebra import Unsupported


@dataclass
class Property:
    pid: str
    name: str
    kind: str
    build: Callable[[], DataFrame]
    qualifiers: dict[str, str] = field(default_factory=dict)
    """Kind of each qualifier property."""


@dataclass
class Abstract:
    """One name for several properties: "any" is the first that is there, "all" their union."""

    pid: str
    name: str
    mode: str
    members: list[str]


#: The class that stands for the states of one country, and their own class.
ALSO = {107390: (475050,)}


class Graph:
    def __init__(self, spark: SparkSession, properties: list[Property], domains: dict[str, int], labels: Callable[[], DataFrame], abstract: list[Abstract] = (), transitive: set[str] = frozenset({"P131", "P361"}), descriptions: Callable[[], DataFrame] | None = None, bulk: Callable[[], DataFrame] | None = None):
        self.spark = spark
        self.properties = {p.pid: p for p in properties}
        self.names = {p.name: p.pid for p in [*properties, *abstract]}
        self.abstract = {a.pid: a for a in abstract}
        self.domains, self.labels, self.descriptions = domains, labels, descriptions
        #: All statements of entity-valued properties in one scan, [s, pid, v, q_...], where a table has them so.
        self.bulk = bulk
        #: Properties that always stand for one or more steps.
        self.transitive = set(transitive)
        #: Classes whose members count as those of another one too.
        self.also: dict[int, tuple[int, ...]] = {k: v for k, v in ALSO.items() if k in domains.values()}

    def property(self, pid: str) -> Property:
        if pid not in self.properties:
            raise Unsupported(f"unknown property {pid}")
        return self.properties[pid]

    def pid(self, name: str) -> str:
        if name not in self.names:
            raise Unsupported(f"unknown property {name}")
        return self.names[name]

    def domain(self, name: str) -> int:
        if name not in self.domains:
            raise Unsupported(f"unknown domain {name}")
        return self.domains[name]

    def edges(self, pid: str) -> DataFrame:
        return self.property(pid).build().select("s", "v").filter("v IS NOT NULL")

    def statements(self, pid: str) -> DataFrame:
        return self.property(pid).build()

    def all_edges(self, kinds: tuple[str, ...] = ("entity",)) -> DataFrame:
        """[s, pid, v] of all properties of the given kinds; values as strings if there are other kinds than entities."""
        if self.bulk and kinds == ("entity",):
            return self.bulk().select("s", "pid", "v").filter("v IS NOT NULL")
        cast = "bigint" if kinds == ("entity",) else "string"
        parts = [self.edges(p.pid).select("s", F.lit(p.pid).alias("pid"), F.col("v").cast(cast).alias("v")) for p in self.properties.values() if p.kind in kinds]
        return reduce(DataFrame.union, parts)


#: Names of the statement table's properties, P9101 first.
PROPERTY_NAMES = "founder owner spouse birthplace publisher architect capital editor composer patron successor head_coach main_tributary official_language sister_city record_label doctoral_advisor place_of_burial chief_curator screenwriter sponsor home_port co_founder parent_company narrator translator landlord namesake next_of_kin mascot".split()
#: Its classes, Q6000001 first.
CLASS_NAMES = "river city film museum bridge human band lake company book mountain".split()


def statement_graph(spark: SparkSession, directory: str) -> Graph:
    """The graph of the table `edges`, with the labels of `entities`; start and end are the qualifiers P580 and P582."""

    t = lru_cache(None)(lambda name: table(spark, directory, name))

    def build(pid: str) -> Callable[[], DataFrame]:
        return lambda: t("edges").filter(F.col("pid") == pid).select("s", "v", F.col("q_start").alias("q_P580"), F.col("q_end").alias("q_P582"))

    names = {"P31": "instance_of", "P279": "subclass_of", "P9001": "location"} | {f"P{9101 + i}": n for i, n in enumerate(PROPERTY_NAMES)}
    times = {"P580": "value", "P582": "value"}
    properties = [Property(p, n, "entity", build(p), times) for p, n in names.items()]
    qualifiers = [Property(p, n, "value", lambda c=c: t("edges").select("s", F.col(c).alias("v"))) for p, n, c in (("P580", "start_time", "q_start"), ("P582", "end_time", "q_end"))]

    def bulk() -> DataFrame:
        return t("edges").filter(F.col("pid").isin(*names)).select("s", "pid", "v", F.col("q_start").alias("q_P580"), F.col("q_end").alias("q_P582"))

    def labels() -> DataFrame:
        return t("entities").select(F.expr("try_cast(substr(id, 2) AS bigint)").alias("id"), "label")

    def descriptions() -> DataFrame:
        return t("entities").select(F.expr("try_cast(substr(id, 2) AS bigint)").alias("id"), F.concat_ws(" of the graph", F.col("domain_name"), F.lit("")).alias("text"))

    abstract = [Abstract("P9801", "origin", "any", ["P9101", "P9123", "P9102"]), Abstract("P9802", "kin", "all", ["P9103", "P9129"])]
    domains = {"entity": 0} | {n: 6000001 + i for i, n in enumerate(CLASS_NAMES)}
    return Graph(spark, [*properties, *qualifiers], domains, labels, abstract, descriptions=descriptions, bulk=bulk)


#: Where the entities of each table begin, and the classes of the trade graph.
BASE = {"region": 101_000, "nation": 102_000, "supplier": 110_000_000, "customer": 120_000_000, "part": 130_000_000, "order": 140_000_000, "user": 160_000_000}
CLASSES = {"customer": 901, "supplier": 902, "part": 903, "order": 904, "nation": 905, "region": 906, "party": 910, "territory": 911, "thing": 920}
SUBCLASSES = [(901, 910), (902, 910), (905, 911), (906, 911), (910, 920), (911, 920), (903, 920)]
KEYS = {"customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "order": ("orders", "o_orderkey"), "nation": ("nation", "n_nationkey"), "region": ("region", "r_regionkey")}


def trade_graph(spark: SparkSession, directory: str) -> Graph:
    """A graph over the trade tables: parties, places, parts, orders with statements for their lines, and users' spans of activity."""

    t = lru_cache(None)(lambda name: table(spark, directory, name))

    def node(kind: str, column: str):
        return F.col(column).cast("bigint") + F.lit(BASE[kind])

    def direct(kind: str, column: str, value) -> Callable[[], DataFrame]:
        name, key = KEYS[kind]
        return lambda: t(name).select(node(kind, key).alias("s"), (F.col(value) if isinstance(value, str) else value).alias("v"))

    def union(*parts: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: reduce(DataFrame.union, [p() for p in parts])

    instances = union(*(direct(kind, key, F.lit(CLASSES[kind]).cast("bigint")) for kind, (_, key) in KEYS.items()))
    subclasses = lambda: numbers_frame(spark, s=[a for a, _ in SUBCLASSES], v=[b for _, b in SUBCLASSES])
    in_nation = union(direct("customer", "", node("nation", "c_nationkey")), direct("supplier", "", node("nation", "s_nationkey")))
    in_region = direct("nation", "", node("region", "n_regionkey"))

    def has_part() -> DataFrame:
        return t("lineitem").select(
            node("order", "l_orderkey").alias("s"), node("part", "l_partkey").alias("v"), F.col("l_quantity").alias("q_P1114"), F.col("l_extendedprice").alias("q_P2284"),
            F.col("l_shipdate").alias("q_P585"), node("supplier", "l_suppkey").alias("q_P176"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("q_P582"),
        )

    def activity() -> DataFrame:
        e = t("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("q_P580"), F.max("ts").alias("q_P582"))
        return e.select((F.col("user_id") + BASE["user"]).alias("s"), F.col("event_type").alias("v"), "q_P580", "q_P582")

    P = Property
    properties = [
        P("P31", "instance_of", "entity", instances), P("P279", "subclass_of", "entity", subclasses),
        P("P131", "located_in", "entity", union(in_nation, in_region)), P("P17", "country", "entity", in_nation), P("P30", "continent", "entity", in_region),
        P("P8001", "balance", "value", union(direct("customer", "", "c_acctbal"), direct("supplier", "", "s_acctbal"))),
        P("P2284", "price", "value", direct("part", "", "p_retailprice")), P("P2048", "size", "value", direct("part", "", F.col("p_size").cast("double"))),
        P("P8002", "total", "value", direct("order", "", "o_totalprice")), P("P585", "point_in_time", "value", direct("order", "", "o_orderdate")),
        P("P1716", "brand", "value", direct("part", "", "p_brand")), P("P8003", "segment", "value", direct("customer", "", "c_mktsegment")),
        P("P8004", "priority", "value", direct("order", "", "o_orderpriority")), P("P8005", "ordered_by", "entity", direct("order", "", node("customer", "o_custkey"))),
        P("P361", "part_of", "entity", union(direct("customer", "", node("nation", "c_nationkey")), in_region)),
        P("P21", "sex_or_gender", "entity", direct("customer", "", F.when(F.col("c_custkey") % 2 == 0, 6581072).otherwise(6581097).cast("bigint"))),
        P("P8006", "placed", "entity", lambda: t("orders").select(node("customer", "o_custkey").alias("s"), node("order", "o_orderkey").alias("v"))),
        P("P527", "has_part", "entity", has_part, {"P1114": "value", "P2284": "value", "P585": "value", "P176": "entity", "P582": "value"}),
        P("P176", "supplied_by", "entity", lambda: has_part().select(F.col("v").alias("s"), F.col("q_P176").alias("v"))), P("P1114", "quantity", "value", lambda: has_part().select("s", F.col("q_P1114").alias("v"))),
        P("P1344", "participant_in", "value", activity, {"P580": "value", "P582": "value"}), P("P580", "start_time", "value", lambda: activity().select("s", F.col("q_P580").alias("v"))), P("P582", "end_time", "value", lambda: activity().select("s", F.col("q_P582").alias("v"))),
    ]

    def labels() -> DataFrame:
        named = [("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")]
        return reduce(DataFrame.union, [t(KEYS[k][0]).select(node(k, KEYS[k][1]).alias("id"), F.col(c).alias("label")) for k, c in named])

    abstract = [Abstract("P8801", "place", "any", ["P30", "P17", "P131"]), Abstract("P8802", "whereabouts", "all", ["P17", "P30"])]
    return Graph(spark, properties, {"entity": 0} | CLASSES, labels, abstract)
