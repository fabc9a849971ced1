"""Entity linking without outside services: oracle links, merged linkers, missing entities and error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_ids, sample_labels


def oracle_links(examples: DataFrame, entities: DataFrame, key: str = "row_id", program: str = "thingtalk") -> DataFrame:
    """[key, id, label, domain_name]: the entities of each gold program; labels are null for entities without one."""
    named = examples.filter(F.col(program).isNotNull()).select(key, F.explode(entity_ids(F.col(program))).alias("id"))
    return named.join(entities.select("id", "label", "domain_name"), "id", "left").select(key, "id", "label", "domain_name")


def merged_links(mentions: DataFrame, key: str = "row_id") -> DataFrame:
    """[key, id, n_linkers, score]: the links of all linkers, one for each entity of an example, with the best score."""
    return mentions.filter("id IS NOT NULL").groupBy(key, "id").agg(F.countDistinct("linker").alias("n_linkers"), F.max("score").alias("score"))


def missing_entities(gold: DataFrame, found: DataFrame, key: str = "row_id") -> DataFrame:
    """[key, id] of gold entities that no linker found."""
    return gold.select(key, "id").distinct().join(found.select(key, "id").distinct(), [key, "id"], "left_anti")


def missing_report(gold: DataFrame, found: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: gold links, missing ones, and examples with a missing one."""
    lost = missing_entities(gold, found, key)
    total = gold.select(key, "id").distinct().agg(F.count("*").alias("n_gold"))
    return total.join(lost.agg(F.count("*").alias("n_missing"), F.countDistinct(key).alias("n_examples")), F.lit(True))


def completed_links(gold: DataFrame, found: DataFrame, key: str = "row_id") -> DataFrame:
    """[key, id, synthetic]: the links found, and the missing gold ones marked as put in."""
    return found.select(key, "id").distinct().withColumn("synthetic", F.lit(False)).union(missing_entities(gold, found, key).withColumn("synthetic", F.lit(True)))


def ranked_candidates(candidates: DataFrame, key: str = "row_id", k: int = 4) -> DataFrame:
    """The k best candidates of each mention: type match, exact name, number of matches, then id."""
    order = [F.desc_nulls_last(c) for c in ("type_match", "exact_name", "n_matches")] + [F.asc("id")]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def linker_errors(links: DataFrame, gold: DataFrame, key: str = "row_id", top: int = 2) -> DataFrame:
    """[key, id, error]: gold entities that a linker missed, or ranked below its first `top`; links: key, id, rank."""
    best = links.groupBy(key, "id").agg(F.min("rank").alias("rank"))
    joined = gold.select(key, "id").distinct().join(best, [key, "id"], "left")
    error = F.when(F.col("rank").isNull(), "missing").when(F.col("rank") > top, "misranked")
    return joined.select(key, "id", error.alias("error")).filter("error IS NOT NULL")


def labels_of(ids: DataFrame, labels: DataFrame, lang: str = "en") -> DataFrame:
    """`ids` with a column "label": the latest label in a language; null where there is none."""
    newest = F.max_by("label", F.struct("updated_at", "label_id"))
    known = labels.filter((F.col("lang") == lang) & F.col("label").isNotNull()).groupBy("id").agg(newest.alias("label"))
    return ids.join(known, "id", "left")


def add_if_absent(cache: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A key-value cache with those new entries whose key it doesn't have yet; of several new ones the smallest value."""
    fresh = new.groupBy(key).agg(F.min("value").alias("value")).join(cache.select(key), key, "left_anti")
    return cache.select(key, "value").unionByName(fresh.select(key, "value"))


def alt_labels_of(ids: DataFrame, aliases: DataFrame, lang: str | None = None) -> DataFrame:
    """[id, aliases]: the distinct other names of each id, in order, of one language or all; an empty list where there are none."""
    kept = aliases.filter("alias IS NOT NULL" if lang is None else F.col("alias").isNotNull() & (F.col("lang") == lang))
    names = kept.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return ids.select("id").join(names, "id", "left").select("id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def searched(texts: DataFrame, entities: DataFrame, aliases: DataFrame, k: int = 5) -> DataFrame:
    """[text, id, rank]: the k entities whose label or alias is a text but for case and outer white space: labels first, then by number of the id.

    Null and blank texts find nothing; a text is looked up once, however often it comes.
    """
    key = lambda c: F.lower(F.trim(c))
    labels = entities.select(key("label").alias("k"), "id", F.lit(0).alias("by"))
    named = labels.union(aliases.select(key("alias"), "id", F.lit(1))).filter("k != ''").groupBy("k", "id").agg(F.min("by").alias("by"))
    # The rank's limit is taken before the shuffle too, so a name of very many entities costs k rows a task.
    order = Window.partitionBy("k").orderBy("by", F.expr("try_cast(substr(id, 2) AS bigint)"), "id")
    found = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("k", "id", "rank")
    wanted = texts.select("text").distinct().select("text", key("text").alias("k"))
    return wanted.join(found, "k").select("text", "id", "rank")


def ids_of_urls(urls: DataFrame, sitelinks: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """[url, id]: the entity of each page address: by the table of sitelinks [url, id], else the first found for the page's title, else null."""
    direct = sitelinks.filter("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("known"))
    title = F.replace(F.try_url_decode(F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?\z", 1)), F.lit("_"), F.lit(" "))
    pages = urls.select("url").filter("url IS NOT NULL").distinct().select("url", title.alias("text")).join(direct, "url", "left")
    by_name = searched(pages.filter("known IS NULL").select("text"), entities, aliases, 1).select("text", F.col("id").alias("found"))
    return pages.join(by_name, "text", "left").select("url", F.coalesce("known", "found").alias("id"))


def canonical_names(entities: DataFrame, aliases: DataFrame, k: int = 5) -> DataFrame:
    """[id, canonical]: each entity's label and the k aliases that sample_labels() takes, which a catalog lists as its names."""
    names = alt_labels_of(entities.select("id"), aliases)
    out = entities.select("id", "label").join(names, "id")
    own = F.filter(F.array("label"), lambda x: x.isNotNull())
    return out.select("id", F.array_distinct(F.concat(own, sample_labels(F.col("aliases"), k))).alias("canonical"))
