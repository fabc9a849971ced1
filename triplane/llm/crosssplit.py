"""Records of evaluation splits that are in the training split too, exactly or almost.

A record is what its query asks (canonical.query_meaning) and the shingles of its utterance. Records of
one meaning and one utterance form are a class, so repeated deliveries cost nothing. Classes are joined
by an exact prefix-filter join: shingles in order of rarity, the prefixes of evaluation classes indexed,
training prefixes probing them with length and position filters, and the overlap verified. Meaning and
shingle are the join key together, so a pair that asks something else is never made.

Shingles are of three characters: TESTDATA's cases differ by slips in letters and changed words, which
five-word shingles of a one-line question would not survive. No pair with a Jaccard similarity of
SIMILARITY or more is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, use_checkpoints
from .canonical import DEFAULT_LIMIT, NAMESPACES, query_meaning, utterance_form, with_forms
from .formdupes import UTTERANCE_SQL

#: Least Jaccard similarity of the utterances' shingles.
SIMILARITY = 0.4
WIDTH = 3
#: Hash buckets in which the rarity of shingles is counted.
BUCKETS = 1 << 14


def shingles(text: Column) -> Column:
    """The distinct shingles of a text's letters and digits; a shorter text is its own shingle."""
    n = F.greatest(F.length(text) - (WIDTH - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(WIDTH))))


def record_keys(rows: DataFrame, key: str, held_out: bool) -> DataFrame:
    """(key, q1, q2, u): the training or the other rows with both fields, their meaning's hash and utterance form."""
    splits = ("dev", "test") if held_out else ("train",)
    filled = rows.filter(F.col("split").isin(*splits) & (F.col("utterance") != "") & (F.col("sparql") != ""))
    return with_forms(filled.select(key, "sparql", "utterance"), {"sparql": ("q", query_meaning), "utterance": ("u", utterance_form)}, {"q"})


def rarities(classes: DataFrame) -> bytes:
    """The rank by rarity of each of BUCKETS hash buckets of shingles, two bytes each: of one length, whatever the data."""
    buckets = classes.select(F.explode(shingles(F.col("u"))).alias("gram")).groupBy(bucket(F.col("gram")).alias("b")).agg(F.count("*").alias("n"))
    counts = [0] * BUCKETS
    for row in buckets.collect():
        counts[row.b] = row.n
    rank = {n: i for i, n in enumerate(sorted(set(counts)))}
    return b"".join(rank[n].to_bytes(2, "big") for n in counts)


def bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


def similar_classes(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(q1, q2, eu, tu): the class pairs of one meaning, evaluation and training utterance form.

    classes: (q1, q2, u, held_out, trained), distinct by the first three. Shingles are ordered by the
    rarity of their hash bucket and then by themselves, an order that all classes share, so the prefix
    filter is exact. Prefixes travel as hashes; a collision makes a candidate more, which verification drops.
    """
    t = similarity
    ranks = F.lit(bytearray(rarities(classes)))
    ranked = F.array_sort(F.transform(shingles(F.col("u")), lambda g: F.struct(F.substr(ranks, bucket(g) * 2 + 1, F.lit(2)).alias("rank"), g.alias("gram"))))
    n = F.size("ranked")
    keyed = classes.select("q1", "q2", "u", "held_out", "trained", F.xxhash64("q1", "q2", "u").alias("c"), ranked.alias("ranked"))
    prefix = F.slice("ranked.gram", F.lit(1), n - F.ceil(n * t - 1e-9).cast("int") + 1)
    probes = keyed.select("q1", "q2", "c", "held_out", "trained", n.alias("n"), F.posexplode(prefix).alias("at", "gram")).select(
        F.xxhash64("q1", "q2", "gram").alias("j"), "c", "n", "at", "held_out", "trained"
    )
    e = probes.filter("held_out").select("j", F.col("c").alias("ec"), F.col("n").alias("en"), F.col("at").alias("ea"))
    r = probes.filter("trained").select("j", F.col("c").alias("tc"), F.col("n").alias("tn"), F.col("at").alias("ta"))
    needed = F.ceil((F.col("en") + F.col("tn")) * (t / (1 + t)) - 1e-9)
    fits = (F.col("en") >= F.col("tn") * t) & (F.col("tn") >= F.col("en") * t)
    within = F.least(F.col("en") - F.col("ea"), F.col("tn") - F.col("ta")) >= needed
    candidates = e.join(r, "j").filter(fits & within).select("ec", "tc").distinct()
    left = classes.filter("held_out").select(F.xxhash64("q1", "q2", "u").alias("ec"), "q1", "q2", F.col("u").alias("eu"))
    right = classes.filter("trained").select(F.xxhash64("q1", "q2", "u").alias("tc"), F.col("q1").alias("r1"), F.col("q2").alias("r2"), F.col("u").alias("tu"))
    pairs = candidates.join(left, "ec").join(right, "tc").filter("q1 = r1 AND q2 = r2")
    eg, tg = shingles(F.col("eu")), shingles(F.col("tu"))
    common = F.size(F.array_intersect(eg, tg))
    return pairs.filter(common >= (F.size(eg) + F.size(tg) - common) * t - 1e-9).select("q1", "q2", "eu", "tu")


def shared_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, held_out, q1, q2, u): the records whose meaning is on both sides; no other can be in a pair.

    Both sides are checkpointed, as they are read several times and their forms are the costly part:
    the evaluation side whole, of the training side what meets it.
    """
    use_checkpoints(rows.sparkSession)
    held_out = record_keys(rows, key, True).checkpoint()
    trained = record_keys(rows, key, False).join(held_out.select("q1", "q2").distinct(), ["q1", "q2"], "left_semi").checkpoint()
    held_out = held_out.join(trained.select("q1", "q2").distinct(), ["q1", "q2"], "left_semi")
    columns = [key, "q1", "q2", "u"]
    return held_out.select(*columns, F.lit(True).alias("held_out")).union(trained.select(*columns, F.lit(False).alias("held_out")))


def class_pairs(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The similar class pairs of records; their classes are checkpointed, as rarities, prefixes and verification read them."""
    classes = records.groupBy("q1", "q2", "u").agg(F.max("held_out").alias("held_out"), (~F.min("held_out")).alias("trained"))
    return similar_classes(classes.checkpoint(), similarity)


def overlaps(rows: DataFrame, key: str = "row_id", similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), smaller first: every evaluation row with every training row that is the same or nearly so.

    Null and empty fields match nothing, rows of other splits are ignored, repeated rows each count.
    """
    records = shared_records(rows, key)
    pairs = class_pairs(records, similarity)
    e = records.filter("held_out").select(F.col(key).alias("e"), "q1", "q2", F.col("u").alias("eu"))
    t = records.filter("NOT held_out").select(F.col(key).alias("t"), "q1", "q2", F.col("u").alias("tu"))
    found = pairs.join(e, ["q1", "q2", "eu"]).join(t, ["q1", "q2", "tu"])
    return found.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def linked(rows: DataFrame, key: str = "row_id", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, n_links): the rows with a case, each with its class and the number of classes of the other side that are the same or nearly so.

    A class is the rows of one meaning and one utterance form; its id is the smallest key in it. One row
    for each row, however often a record was delivered: overlaps() is the expansion into pairs.
    """
    records = shared_records(rows, key)
    pairs = class_pairs(records, similarity)
    sides = pairs.select("q1", "q2", F.col("eu").alias("u"), F.lit(True).alias("held_out")).union(pairs.select("q1", "q2", F.col("tu").alias("u"), F.lit(False).alias("held_out")))
    links = sides.groupBy("q1", "q2", "u", "held_out").agg(F.count("*").alias("n_links"))
    classes = records.groupBy("q1", "q2", "u").agg(F.min(key).alias("class_id"))
    return records.join(links.join(classes, ["q1", "q2", "u"]), ["q1", "q2", "u", "held_out"]).select(key, "class_id", "n_links")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return overlaps(table(spark, directory, "examples"))


def p2_classes(spark: SparkSession, directory: str) -> DataFrame:
    return linked(table(spark, directory, "examples"))


def p2_report(spark: SparkSession, directory: str) -> DataFrame:
    """Evaluation rows that are in the training split too, counted by split and source; a null source is a source."""
    rows = table(spark, directory, "examples")
    records = shared_records(rows, "row_id")
    leaked = records.filter("held_out").join(
        class_pairs(records).select("q1", "q2", F.col("eu").alias("u")).distinct(), ["q1", "q2", "u"], "left_semi"
    )
    held_out = rows.filter("split IN ('dev', 'test')").select("row_id", "split", "source")
    return (
        held_out.join(leaked.select("row_id", F.lit(1).alias("leaked")), "row_id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("n_rows"), F.count("leaked").alias("n_in_train"))
    )


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_report": p2_report}

#: The rules once more as a join of all records of one meaning, for queries of one group without literals, which
#: all of the tables' are. Variables are told apart by nothing here, which makes no difference in the tables.
_NAMES = "regexp_replace(lower(sparql), '<[^<>\\s]*/(entity|prop/direct|prop/statement|prop/qualifier|prop)/([^<>/\\s]+)>', ' \\1:\\2 ', 'g')"
for _path, _prefix in NAMESPACES.items():
    _NAMES = f"replace({_NAMES}, ' {_path}:', ' {_prefix}:')"
_RECORDS = rf"""WITH t AS (SELECT row_id, split, source, {UTTERANCE_SQL} AS u, regexp_replace({_NAMES}, 'prefix\s+[^\s<]*\s*<[^>]*>', ' ', 'g') AS b FROM examples WHERE utterance <> '' AND sparql <> '' AND split IN ('train', 'dev', 'test')),
k AS (SELECT row_id, split, u, ' ' || array_to_string(list_filter(list_transform(regexp_extract_all(b, '<[^<>\s]*[:/][^<>\s]*>|\?\w+|[\w-]*:[\w.%-]*[\w%-]|\d+\.\d+|\w+|[!<>]=|&&|\|\||\S'), lambda x: CASE WHEN x[1] = '?' THEN '?' ELSE x END), lambda x: x NOT IN ('where', 'distinct')), ' ') || ' ' AS b FROM t WHERE u <> ''),
r AS (SELECT row_id, split, u, trim(split_part(b, '{{', 1)) || '|' || array_to_string(list_sort(list_filter(list_transform(string_split(replace(split_part(split_part(b, '{{', 2), '}}', 1), ' . ', ' .  '), ' . '), lambda x: trim(x)), lambda x: x <> '')), '|') || '|' || trim(regexp_replace(split_part(b, '}}', 2), ' limit {DEFAULT_LIMIT} ', ' ')) AS q, list_distinct(list_transform(range(1, greatest(len(u) - {WIDTH - 1}, 1) + 1), lambda i: substr(u, i, {WIDTH}))) AS g FROM k),
pairs AS (SELECT e.row_id AS e, t.row_id AS t FROM r e JOIN r t ON e.q = t.q AND e.split <> 'train' AND t.split = 'train' WHERE len(list_intersect(e.g, t.g)) >= {SIMILARITY} * (len(e.g) + len(t.g) - len(list_intersect(e.g, t.g))) - 1e-9)"""
ORACLE_SQL: dict[str, str] = {
    "p2_found": f"{_RECORDS} SELECT least(e, t) AS id_a, greatest(e, t) AS id_b FROM pairs",
    "p2_report": f"{_RECORDS} SELECT split, source, count(*) AS n_rows, count(*) FILTER (row_id IN (SELECT e FROM pairs)) AS n_in_train FROM examples WHERE split IN ('dev', 'test') GROUP BY split, source",
}
