"""Records that are the same but for their form: white space, letter case, punctuation, order of fields.

Each column is dictionary-encoded: every distinct value is canonicalised once and gets an integer
identifier, which values of one canonical form share. Records become tuples of integers, and the
tuples are grouped. Texts are shuffled once, to find the distinct values; after that only integers move.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import key128, table, use_checkpoints
from .canonical import GAP, MINUS, PLUS, POINT, query_form, utterance_form, with_forms


def value_dictionary(rows: DataFrame, column: str, form: Callable[[str], str]) -> DataFrame:
    """(k1, k2, c1, c2): for each distinct value its raw key and the identifier of its canonical form.

    The identifier is a 128-bit hash of the form, as two integers, so it needs no counter that all
    tasks share and is the same in every run. Values with an empty form have no entry.
    """
    k1, k2 = key128(F.col("v"))
    values = rows.groupBy(F.col(column).alias("v")).agg(F.lit(1).alias("one")).select(k1.alias("k1"), k2.alias("k2"), "v")
    return with_forms(values, {"v": ("c", form)}, {"c"})


def encoded_records(rows: DataFrame, key: str, fields: dict[str, Callable[[str], str]]) -> DataFrame:
    """(key, g1, g2): each record as one integer pair made of its fields' identifiers.

    Rows with a null or empty field, or one without letters and digits, are left out.
    """
    kept = rows.select(key, *fields).filter(reduce(Column.__and__, [F.col(c).isNotNull() & (F.col(c) != "") for c in fields]))
    raw = [(f"{c}_{i}", k) for c in fields for i, k in enumerate(key128(F.col(c)), 1)]
    out = kept.select(F.col(key), *[k.alias(n) for n, k in raw])
    for c, form in fields.items():
        entries = value_dictionary(kept, c, form).select(
            F.col("k1").alias(f"{c}_1"), F.col("k2").alias(f"{c}_2"), F.col("c1").alias(f"{c}_c1"), F.col("c2").alias(f"{c}_c2")
        )
        out = out.join(entries, [f"{c}_1", f"{c}_2"]).drop(f"{c}_1", f"{c}_2")
    ids = [F.col(f"{c}_c{i}") for c in sorted(fields) for i in (1, 2)]
    return out.select(key, F.xxhash64(*ids).alias("g1"), F.xxhash64(F.lit(1), *ids).alias("g2"))


def nested_form(query: str) -> str:
    return query_form(query, nested=True)


FIELDS = {"utterance": utterance_form, "sparql": nested_form}


def groups_of(records: DataFrame, key: str) -> DataFrame:
    """(g1, g2, keep_id, n_copies): grouped with partial aggregation, so a hot group costs one row a task."""
    return records.groupBy("g1", "g2").agg(F.min(key).alias("keep_id"), F.count("*").alias("n_copies"))


def copies(rows: DataFrame, key: str = "row_id", fields: dict | None = None) -> DataFrame:
    """(keep_id, copy_id): every further copy of a record, with the smallest key of its group.

    Ties can't occur but for equal keys: rows that share key and group are one row. A hot group is
    split by adaptive execution where its members meet the one row that describes it. The tuples, a few
    bytes a record, are checkpointed, as they are grouped and then met again.
    """
    use_checkpoints(rows.sparkSession)
    records = encoded_records(rows, key, fields or FIELDS).checkpoint()
    groups = groups_of(records, key).filter("n_copies > 1").drop("n_copies")
    return records.join(groups, ["g1", "g2"]).filter(F.col(key) != F.col("keep_id")).select("keep_id", F.col(key).alias("copy_id"))


def collapsed(rows: DataFrame, key: str = "row_id", fields: dict | None = None) -> DataFrame:
    """One row for each record, the one with the smallest key, with the number of its copies."""
    fields = fields or FIELDS
    groups = groups_of(encoded_records(rows, key, fields), key).select("keep_id", "n_copies")
    return rows.select(F.col(key).alias("keep_id"), *fields).join(groups, "keep_id")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return copies(table(spark, directory, "examples"))


def p1_collapsed(spark: SparkSession, directory: str) -> DataFrame:
    return collapsed(table(spark, directory, "examples"))


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}

#: The rules once more for queries of one group without literals, which all of the tables' are: tokens by one
#: regular expression, statements between dots, and private characters for the content signs of utterances.
_SIGNS = rf"regexp_replace(regexp_replace(lower(utterance), '(^|[^\w.,\x{{80}}-\x{{dfff}}\x{{f900}}-\x{{10ffff}}])[-−](\.?\d)', '\1{MINUS}\2', 'g'), '(^|[^\w.,\x{{80}}-\x{{dfff}}\x{{f900}}-\x{{10ffff}}])\+(\.?\d)', '\1{PLUS}\2', 'g')"
_POINTS = rf"regexp_replace(regexp_replace({_SIGNS}, '(\d)\.(\d)', '\1{POINT}\2', 'g'), '(\d)\.(\d)', '\1{POINT}\2', 'g')"
_GAPS = rf"regexp_replace(regexp_replace({_POINTS}, '(\d)[^\w<>=≤≥≠\x{{80}}-\x{{dfff}}\x{{f900}}-\x{{10ffff}}]*\s[^\w<>=≤≥≠\x{{80}}-\x{{dfff}}\x{{f900}}-\x{{10ffff}}]*([\d{MINUS}{PLUS}])', '\1{GAP}\2', 'g'), '(\d)[^\w<>=≤≥≠\x{{80}}-\x{{dfff}}\x{{f900}}-\x{{10ffff}}]*\s[^\w<>=≤≥≠\x{{80}}-\x{{dfff}}\x{{f900}}-\x{{10ffff}}]*([\d{MINUS}{PLUS}])', '\1{GAP}\2', 'g')"
UTTERANCE_SQL = f"regexp_replace({_GAPS}, '[^\\pL\\pM\\pN<>=≤≥≠{MINUS}{PLUS}{POINT}{GAP}]', '', 'g')"
_GROUPS = rf"""WITH t AS (SELECT row_id, utterance, sparql, {UTTERANCE_SQL} AS u, lower(sparql) AS s FROM examples WHERE utterance <> '' AND sparql <> ''),
p AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(s, 'prefix\s+[^\s<]*\s*<[^>]*>'), lambda x: regexp_replace(x, '\s+', '', 'g')))) AS prefixes, regexp_replace(s, 'prefix\s+[^\s<]*\s*<[^>]*>', ' ', 'g') AS b FROM t),
k AS (SELECT * REPLACE (' ' || array_to_string(regexp_extract_all(b, '<[^<>\s]*[:/][^<>\s]*>|\?\w+|[\w-]*:[\w.%-]*[\w%-]|\d+\.\d+|\w+|[!<>]=|&&|\|\||\S'), ' ') || ' ' AS b) FROM p),
f AS (SELECT *, array_to_string(prefixes, ' ') || '|' || trim(split_part(b, '{{', 1)) || '|' || array_to_string(list_sort(list_filter(list_transform(string_split(replace(split_part(split_part(b, '{{', 2), '}}', 1), ' . ', ' .  '), ' . '), lambda x: trim(x)), lambda x: x <> '')), '|') || '|' || trim(split_part(b, '}}', 2)) AS q FROM k WHERE u <> ''),
g AS (SELECT *, min(row_id) OVER (PARTITION BY u, q) AS keep_id FROM f)"""
ORACLE_SQL: dict[str, str] = {
    "p1_found": f"{_GROUPS} SELECT keep_id, row_id AS copy_id FROM g WHERE row_id <> keep_id",
    "p1_collapsed": f"{_GROUPS}, n AS (SELECT keep_id, count(*) AS n_copies FROM g GROUP BY keep_id) SELECT keep_id, utterance, sparql, n_copies FROM n JOIN g USING (keep_id) WHERE row_id = keep_id",
}
