"""Answers against gold answers, intersections and differences of results, and statistics of a dataset's programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_divide


def answer_metrics(answers: DataFrame, expected: str = "expected", predicted: str = "predicted", queries: tuple[str, str] | None = None, distinct: bool = False) -> DataFrame:
    """One row: n, micro_f1, precision, recall, f1, hits_at_1, exact of two columns of answer lists.

    A null list is an empty one. Answers count as often as they are listed, with `distinct` once. Recall and
    precision of an example are averaged, and f1 is that of the averages; 0/0 counts as 1, as for an empty
    prediction of an empty gold list. `exact` is the part of equal query texts, of the columns `queries`
    (expected, predicted); without them that of equal sets of answers.
    """
    e, p = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (expected, predicted))
    e, p = (F.array_distinct(e), F.array_distinct(p)) if distinct else (e, p)
    tp = F.size(F.filter(p, lambda x: F.array_contains(e, x))).cast("double")
    fn = F.size(F.filter(e, lambda x: ~F.array_contains(p, x))).cast("double")
    first = F.coalesce(F.get(F.col(predicted), F.lit(0)), F.lit(None).cast("string"))
    same = F.col(queries[0]).eqNullSafe(F.col(queries[1])) if queries else (F.size(F.array_except(e, p)) == 0) & (F.size(F.array_except(p, e)) == 0)
    rows = answers.select(
        tp.alias("tp"), F.size(p).cast("double").alias("np"), (tp + fn).alias("ne"),
        F.coalesce(F.array_contains(e, first), (F.size(e) == 0) & (F.size(p) == 0)).cast("double").alias("hit"),
        same.cast("double").alias("same"),
    )
    means = rows.agg(
        F.count("*").alias("n"), F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("ne").alias("ne"),
        F.avg(safe_divide(F.col("tp"), F.col("np"))).alias("precision"), F.avg(safe_divide(F.col("tp"), F.col("ne"))).alias("recall"),
        F.avg("hit").alias("hits_at_1"), F.avg("same").alias("exact"),
    ).withColumn("precision", F.when(F.col("precision") == float("inf"), 0.0).otherwise(F.col("precision")))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return means.select("n", safe_divide(2 * F.col("tp"), F.col("np") + F.col("ne")).alias("micro_f1"), "precision", "recall", f1.alias("f1"), "hits_at_1", "exact")


def intersection(results: list[DataFrame]) -> DataFrame:
    """The rows of the first result that are in all others too; its repetitions stay."""
    return reduce(lambda a, b: a.join(b.distinct(), a.columns, "left_semi"), results)


def newly_failed(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """The failures of the second run that the first did not have."""
    return after.join(before.select(key).distinct(), key, "left_anti")


def property_usage(examples: DataFrame, program: str = "thingtalk") -> DataFrame:
    """[property, n_filter, n_projection, n_sort, n_total]: how often programs use each property, and for what."""
    kinds = {
        "n_filter": r"(?:contains~? \( |[(!]|&&|\|\||filter) ?([a-z_]+)(?= (?:,|>=|<=|==|=~|filter))",
        "n_projection": r"\[ ([a-z_]+)(?= (?:\]|filter|of|,))",
        "n_sort": r"sort \( ([a-z_]+)(?= )",
    }
    def tagged(kind: str, pattern: str):
        names = F.regexp_extract_all(F.col(program), F.lit(pattern), F.lit(1))
        return F.transform(names, lambda x: F.struct(x.alias("property"), F.lit(kind).alias("kind")))

    used = F.explode(F.flatten(F.array(*[tagged(k, r) for k, r in kinds.items()])))
    rows = examples.filter(F.col(program).isNotNull()).select(used.alias("u")).select("u.*").filter("property NOT IN ('id', 'value', 'filter', 'contains', 'count', 'sort')")
    return rows.groupBy("property").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count("*").alias("n_total"))


#: Rows of a key range that are sorted at once.
SORTED = 10_000


def split_in_two(rows: DataFrame, key: str, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `size` rows by key (half, if no size is given) and the rest; rows with a null key are in the rest, equal keys on one side.

    The last key of the first part is found by counting ranges of keys, then ranges within the one that
    it is in, and so on: no task sorts more than a range, and only counts come to the driver.
    """
    keys = rows.select(key).filter(F.col(key).isNotNull())
    n = rows.count()
    size = n // 2 if size is None else size
    if size <= 0:
        return rows.limit(0), rows
    part, before, last = keys, 0, None
    while last is None:
        ranges = part.repartitionByRange(key).groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).orderBy("least").collect()
        for r in ranges:
            if before + r.n >= size:
                break
            before += r.n
        else:
            return rows, rows.limit(0)
        if r.least == r.most:
            last = r.least
        else:
            part = keys.filter(F.col(key).between(r.least, r.most))
            if r.n <= SORTED or len(ranges) == 1:
                last = part.orderBy(key).offset(size - before - 1).limit(1).collect()[0][0]
    return rows.filter(F.col(key) <= last), rows.filter((F.col(key) > last) | F.col(key).isNull())
