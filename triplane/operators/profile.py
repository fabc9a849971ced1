"""Profiling of a graph: properties, qualifiers, domains and their sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Graph
from ..runtime import numbers_frame
from .paths import closure, reach


def connected_properties(graph: Graph, entity: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """[pid, direction] of the entity-valued properties into or out of an entity, without the excluded ones."""
    edges = graph.all_edges()
    out = edges.filter(F.col("s") == entity).select("pid", F.lit("out").alias("direction"))
    into = edges.filter(F.col("v") == entity).select("pid", F.lit("in").alias("direction"))
    return out.union(into).filter(~F.col("pid").isin(*excluded) if excluded else F.lit(True)).distinct()


def connected_qualifiers(graph: Graph, entity: int) -> DataFrame:
    """[pid, qualifier] that the statements of an entity have."""
    if graph.bulk:
        mine = graph.bulk().filter(F.col("s") == entity)
        names = [c for c in mine.columns if c.startswith("q_")]
        there = F.explode(F.filter(F.array(*[F.when(F.col(c).isNotNull(), c[2:]) for c in names]), lambda x: x.isNotNull()))
        return mine.select("pid", there.alias("qualifier")).distinct()
    parts = []
    for p in graph.properties.values():
        for q in p.qualifiers:
            mine = graph.statements(p.pid).filter((F.col("s") == entity) & F.col(f"q_{q}").isNotNull())
            parts.append(mine.select(F.lit(p.pid).alias("pid"), F.lit(q).alias("qualifier")))
    return reduce(DataFrame.union, parts).distinct()


def property_frequency(graph: Graph, least: int = 10) -> DataFrame:
    """[pid, n] of the entity-valued properties with at least so many statements."""
    return graph.all_edges().groupBy("pid").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def qualifier_frequency(graph: Graph, pid: str, least: int = 10) -> DataFrame:
    """[qualifier, n] of a property's qualifiers that so many of its statements have."""
    names = list(graph.property(pid).qualifiers)
    counts = graph.statements(pid).filter("v IS NOT NULL").agg(*[F.count(f"q_{q}").alias(q) for q in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("qualifier"), F.col(q).alias("n")) for q in names]))
    return counts.select(pairs.alias("p")).select("p.*").filter(F.col("n") >= least)


def qualifier_sample(graph: Graph, pid: str, qualifier: str, k: int = 100) -> DataFrame:
    """[value]: the k smallest distinct values of a qualifier."""
    return graph.statements(pid).filter("v IS NOT NULL").select(F.col(f"q_{qualifier}").alias("value")).filter("value IS NOT NULL").distinct().orderBy("value").limit(k)


def domain_members(graph: Graph, cls: int) -> DataFrame:
    """[s]: instances of a class or of one of its subclasses."""
    spark = graph.spark
    classes = reach(graph.edges("P279"), numbers_frame(spark, n=[cls]), backward=True, zero=True)
    return graph.edges("P31").join(classes.withColumnRenamed("n", "v"), "v", "left_semi").select("s").distinct()


def domain_sizes(graph: Graph, big: tuple[int, ...] = ()) -> DataFrame:
    """[class, n]: instances of each class or its subclasses; infinite for the classes named as big ones."""
    direct = graph.edges("P31").distinct()
    up = closure(graph.edges("P279"), starts=direct.select(F.col("v").alias("n")).distinct()).select(F.col("s").alias("v"), F.col("v").alias("class"))
    reached = direct.join(up, "v").select("s", "class").union(direct.select("s", F.col("v").alias("class")))
    sizes = reached.groupBy("class").agg(F.countDistinct("s").cast("double").alias("n"))
    return sizes.withColumn("n", F.when(F.col("class").isin(*big), float("inf")).otherwise(F.col("n"))) if big else sizes


def domain_properties(graph: Graph, cls: int, least: int = 10) -> DataFrame:
    """[pid, n_statements, n_values] of the properties that a domain's entities have at least so often."""
    edges = graph.all_edges().join(domain_members(graph, cls), "s", "left_semi")
    return edges.groupBy("pid").agg(F.count("*").alias("n_statements"), F.countDistinct("v").alias("n_values")).filter(F.col("n_statements") >= least)


def domain_sample(graph: Graph, cls: int, k: int = 100) -> DataFrame:
    """[s, links]: the k entities of a domain with the most statements that lead to them, the smaller number first on a tie."""
    links = graph.all_edges().groupBy(F.col("v").alias("s")).agg(F.count("*").alias("links"))
    return domain_members(graph, cls).join(links, "s", "left").select("s", F.coalesce("links", F.lit(0)).alias("links")).orderBy(F.desc("links"), "s").limit(k)


def top_domains(graph: Graph, domains: list[int]) -> DataFrame:
    """[s, class]: for each entity the given domain that it belongs to and that has the fewest members; on a tie the larger number.

    The classes below each domain are followed down from the domains, which are few; a cycle of classes does no harm.
    """
    named = numbers_frame(graph.spark, n=sorted(set(domains)))
    down = closure(graph.edges("P279").select(F.col("v").alias("s"), F.col("s").alias("v")), starts=named)
    up = down.filter(F.col("s").isin(*domains)).select("v", F.col("s").alias("class"))
    direct = graph.edges("P31").select("s", "v").distinct()
    own = direct.filter(F.col("v").isin(*domains)).select("s", F.col("v").alias("class"))
    belongs = direct.join(up, "v").select("s", "class").union(own).distinct()
    sizes = belongs.groupBy("class").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", (-F.col("class")).alias("c")))
    return belongs.join(sizes, "class").groupBy("s").agg(best.alias("b")).select("s", (-F.col("b.c")).alias("class"))


def entity_domain(graph: Graph, domains: list[int], person: int, types: DataFrame) -> DataFrame:
    """[s, class]: persons are persons; else the class that a type table [s, type] gives; else the top domain."""
    persons = graph.edges("P31").filter(F.col("v") == person).select("s").distinct().withColumn("is_person", F.lit(True))
    everyone = graph.edges("P31").select("s").distinct()
    tops = top_domains(graph, domains).withColumnRenamed("class", "top")
    joined = everyone.join(persons, "s", "left").join(types.groupBy("s").agg(F.min("type").alias("type")), "s", "left").join(tops, "s", "left")
    return joined.select("s", F.coalesce(F.when(F.col("is_person"), F.lit(person).cast("bigint")), "type", "top").alias("class"))


def infer_catalog(graph: Graph, domains: dict[str, int], least: int = 10) -> DataFrame:
    """[domain, pid, n_statements, n_values]: the properties of each domain, the manifest's content."""
    parts = [domain_properties(graph, c, least).select(F.lit(n).alias("domain"), "pid", "n_statements", "n_values") for n, c in sorted(domains.items()) if c]
    return reduce(DataFrame.union, parts)


def statement_qualifiers(graph: Graph, entity: int, pid: str, value: int, qualifiers: tuple[str, ...]) -> DataFrame:
    """[qualifier, value]: the distinct values that qualifiers have in an entity's statements of one value, as texts.

    With a property's constraint statements as the graph has them, these are its allowed units.
    """
    mine = graph.statements(pid).filter((F.col("s") == entity) & (F.col("v") == value))
    kinds = graph.property(pid).qualifiers
    text = lambda q: F.concat(F.lit("Q"), F.col(f"q_{q}").cast("string")) if kinds[q] == "entity" else F.col(f"q_{q}").cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("qualifier"), text(q).alias("value")) for q in qualifiers]))
    return mine.select(pairs.alias("p")).select("p.*").filter("value IS NOT NULL").distinct()


def value_range(graph: Graph, entity: int, pid: str, value: int, least: str, most: str) -> DataFrame:
    """[least, most]: one row, the range that an entity's statements of one value give by two qualifiers; nulls if there is none."""
    mine = graph.statements(pid).filter((F.col("s") == entity) & (F.col("v") == value))
    return mine.agg(F.min(f"q_{least}").alias("least"), F.max(f"q_{most}").alias("most"))


def domain_entities(graph: Graph, ids: DataFrame) -> DataFrame:
    """[id, is_domain] of ids [id]: whether each has a superclass, which is what makes it a domain."""
    classes = graph.edges("P279").select(F.col("s").alias("id")).distinct().withColumn("is_domain", F.lit(True))
    return ids.select("id").distinct().join(classes, "id", "left").select("id", F.coalesce("is_domain", F.lit(False)).alias("is_domain"))


def members_of(graph: Graph, domains: list[int]) -> DataFrame:
    """[s, class]: the members of each of some classes, those of subclasses too; followed down from the classes."""
    down = closure(graph.edges("P279").select(F.col("v").alias("s"), F.col("s").alias("v")), starts=numbers_frame(graph.spark, n=sorted(set(domains))))
    below = down.filter(F.col("s").isin(*domains)).select("v", F.col("s").alias("class"))
    direct = graph.edges("P31").select("s", "v").distinct()
    own = direct.filter(F.col("v").isin(*domains)).select("s", F.col("v").alias("class"))
    return direct.join(below, "v").select("s", "class").union(own).distinct()


def inferred_manifest(graph: Graph, domains: dict[str, int], least: int = 10, least_qualified: int = 10) -> DataFrame:
    """[domain, pid, name, kind, n_statements, n_values, qualifiers]: what a manifest lists of each domain.

    Properties that the domain's members have in `least` statements, with their name and kind, and the
    qualifiers of `least_qualified` of these, in order, separated by spaces. All domains are read in one pass.
    """
    statements = graph.bulk() if graph.bulk else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [graph.statements(p.pid).withColumn("pid", F.lit(p.pid)) for p in graph.properties.values() if p.kind == "entity"])
    names = sorted(c for c in statements.columns if c.startswith("q_"))
    joined = statements.filter("v IS NOT NULL").join(members_of(graph, list(domains.values())), "s")
    counts = joined.groupBy("class", "pid").agg(F.count("*").alias("n_statements"), F.countDistinct("v").alias("n_values"), *[F.count(c).alias(c) for c in names]).filter(F.col("n_statements") >= least)
    listed = [F.when(F.col(c) >= least_qualified, c[2:]) for c in names]
    of_class = F.create_map(*[F.lit(x) for n, c in domains.items() for x in (c, n)])
    of_pid = F.create_map(*[F.lit(x) for p in graph.properties.values() for x in (p.pid, p.name)])
    kinds = F.create_map(*[F.lit(x) for p in graph.properties.values() for x in (p.pid, p.kind)])
    qualifiers = F.concat_ws(" ", *listed) if listed else F.lit("")
    return counts.select(of_class[F.col("class").cast("int")].alias("domain"), "pid", of_pid[F.col("pid")].alias("name"), kinds[F.col("pid")].alias("kind"), "n_statements", "n_values", qualifiers.alias("qualifiers"))


def chosen_domains(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """[s, class]: one domain for each entity with candidates [s, class], by classes [class, size, root, depth].

    First the candidate with the fewest members, the larger number on a tie. Then, among the candidates
    under the same root, the deepest, of these the one with the most members, the larger number on a tie;
    the root itself, at depth 0, only if it is alone. Candidates without an entry in classes don't count.
    """
    known = candidates.select("s", "class").distinct().join(classes, "class")
    least = known.groupBy("s").agg(F.min_by("root", F.struct("size", -F.col("class"))).alias("of"))
    order = F.struct((F.col("depth") == 0).alias("is_root"), -F.col("depth"), -F.col("size"), -F.col("class"))
    return known.join(least, "s").filter(F.col("root") == F.col("of")).groupBy("s").agg(F.min_by("class", order).alias("class"))
