"""Lines of program TSV files: the valid rows are loaded, the others set apart with the reason.

Lines are split in the JVM, once; only those with a quoted field go through a scanner in Python. Each
distinct value of a column is checked once; the invalid ones make a dictionary of reasons, which is joined
back to the lines beside the structural checks. The join keeps every line as it is, so lines with equal or
null keys are judged each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import key128, table, use_checkpoints

COLUMNS = ("id", "utterance", "thingtalk")
#: Entries of the dictionary up to which it is broadcast, about 20 MB; a larger one is joined by shuffle.
BROADCAST = 250_000
_ID = re.compile(r"[a-z]+-[0-9]{1,9}").fullmatch
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]").search
_QUOTED = re.compile('"[^"]*"')
_NO_BRACKET = re.compile(r"[^()\[\]{}]+")


def scan_fields(line: str) -> list[str] | None:
    """The fields of a line with quoted fields; None if a quoted field isn't closed or something follows its end."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if line[end + 1 : end + 2] != '"':
                    break
                end += 2
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < n and line[at] != "\t":
                return None
        else:
            end = line.find("\t", at)
            end = n if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= n:
            return fields
        at += 1


def split_lines(lines: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """(key, __fault, __v0, __v1, __v2): the fields of each line; without them and with the fault if its quoting is broken or they aren't three.

    A null line is an empty one. A carriage return at the end is not part of the line.
    """
    import pyarrow as pa

    whole = lines.select(F.col(key).alias("__key"), F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\r\z", "").alias("__line"))
    quoted = F.col("__line").startswith('"') | F.col("__line").contains('\t"')
    plain = whole.filter(~quoted).select("__key", F.split("__line", "\t", -1).alias("__fields"))
    kind = whole.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [scan_fields(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fields, pa.list_(pa.string()))], ["__key", "__fields"])

    split = plain.union(whole.filter(quoted).mapInArrow(run, f"__key {kind}, __fields array<string>"))
    fault = F.when(F.col("__fields").isNull(), "quoting").when(F.size("__fields") != len(COLUMNS), "columns")
    values = [F.when(fault.isNull(), F.get("__fields", F.lit(i))).alias(f"__v{i}") for i in range(len(COLUMNS))]
    return split.select(F.col("__key").alias(key), fault.alias("__fault"), *values)


def nests(brackets: str) -> bool:
    """Whether a string of brackets nests and closes."""
    pairs, opened = {")": "(", "]": "[", "}": "{"}, []
    for c in brackets:
        if c not in pairs:
            opened.append(c)
        elif not opened or opened.pop() != pairs[c]:
            return False
    return not opened


def invalid(at: int, value: str) -> bool:
    """Whether a value of the column number `at` is invalid."""
    if at == 0:
        return not _ID(value)
    if at == 1:
        return not value or value.isspace() or bool(_CONTROL(value))
    program = value.strip()
    return not program.endswith(";") or program.count('"') % 2 == 1 or not nests(_NO_BRACKET.sub("", _QUOTED.sub("", program)))


def invalid_values(split: DataFrame) -> DataFrame:
    """(at, k1, k2, reason): column number, key and reason of each distinct invalid value of the well-formed lines."""
    import pyarrow as pa

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"__v{i}").alias("value")) for i in range(len(COLUMNS))]))
    values = split.filter("__fault IS NULL").select(each.alias("__e")).select("__e.at", "__e.value").groupBy("at", "value").agg(F.lit(1).alias("one"))
    k1, k2 = key128(F.col("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            bad = [n for n, (i, v) in enumerate(zip(at, batch.column(3).to_pylist())) if invalid(i, v)]
            kept = batch.take(pa.array(bad, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array([COLUMNS[at[n]] for n in bad], pa.string())], ["at", "k1", "k2", "reason"])

    return values.select("at", k1.alias("k1"), k2.alias("k2"), "value").mapInArrow(run, "at int, k1 bigint, k2 bigint, reason string")


def judged_lines(lines: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """(key, __reason, __v0, __v1, __v2): every line with its fields and the first reason against it; a null reason for a valid one.

    The split lines and the dictionary are checkpointed: both are read several times.
    """
    use_checkpoints(lines.sparkSession)
    split = split_lines(lines, key, line).checkpoint()
    reasons = invalid_values(split).checkpoint()
    known = F.broadcast if reasons.limit(BROADCAST + 1).count() <= BROADCAST else lambda df: df
    out, found = split, []
    for i in range(len(COLUMNS)):
        entries = reasons.filter(F.col("at") == i).select(F.col("k1").alias(f"__a{i}"), F.col("k2").alias(f"__b{i}"), F.col("reason").alias(f"__r{i}"))
        k1, k2 = key128(F.col(f"__v{i}"))
        out = out.join(known(entries), F.col(f"__v{i}").isNotNull() & (k1 == F.col(f"__a{i}")) & (k2 == F.col(f"__b{i}")), "left")
        found.append(f"__r{i}")
    return out.select(key, F.coalesce("__fault", *found).alias("__reason"), *[f"__v{i}" for i in range(len(COLUMNS))])


def bad_lines(lines: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """(key, reason): each bad line with the first reason that applies; repeated and null keys come once for each line."""
    return judged_lines(lines, key, line).filter("__reason IS NOT NULL").select(key, F.col("__reason").alias("reason"))


def valid_rows(lines: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """(key, id, utterance, thingtalk) of the valid lines, whatever other lines have the same key."""
    kept = judged_lines(lines, key, line).filter("__reason IS NULL")
    return kept.select(key, *[F.col(f"__v{i}").alias(c) for i, c in enumerate(COLUMNS)])


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return bad_lines(table(spark, directory, "raw_examples"))


def p3_valid(spark: SparkSession, directory: str) -> DataFrame:
    return valid_rows(table(spark, directory, "raw_examples"))


QUERIES = {"p3_found": p3_found, "p3_valid": p3_valid}

def _sql() -> dict[str, str]:
    """The rules once more, with regular expressions on whole lines and twenty rounds of taking away empty pairs of brackets."""
    field = r'"(?:[^"]|"")*"|(?:[^"\t][^\t]*)?'
    blank = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
    left = r"""regexp_replace(regexp_replace(t, '"[^"]*"', '', 'g'), '[^()\[\]{}]+', '', 'g')"""
    for _ in range(20):
        left = rf"regexp_replace({left}, '\(\)|\[\]|\{{\}}', '', 'g')"
    checked = rf"""
        l AS (SELECT line_id, chr(9) || regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM raw_examples),
        f AS (SELECT line_id, regexp_full_match(line, '(?s)(?:\t(?:{field}))+') AS closed, regexp_extract_all(line, '(?s)\t({field})', 1) AS raw FROM l),
        v AS (SELECT line_id, closed, list_transform(raw, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM f),
        c AS (SELECT line_id, closed, len(v) AS n, v[1] AS i, v[2] AS u, regexp_replace(regexp_replace(v[3], '^{blank}+', ''), '{blank}+\z', '') AS t FROM v),
        r AS (SELECT line_id, i, u, CASE WHEN NOT closed THEN 'quoting' WHEN n <> 3 THEN 'columns' WHEN NOT regexp_full_match(i, '[a-z]+-[0-9]{{1,9}}') THEN 'id'
            WHEN regexp_full_match(u, '{blank}*') OR regexp_matches(u, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{fffd}}]') THEN 'utterance'
            WHEN t = '' OR NOT ends_with(t, ';') OR (len(t) - len(replace(t, '"', ''))) % 2 = 1 OR {left} <> '' THEN 'thingtalk' END AS reason FROM c)"""
    return {
        "p3_found": f"WITH {checked} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
        "p3_valid": f"WITH {checked} SELECT r.line_id, r.i AS id, r.u AS utterance, v.v[3] AS thingtalk FROM r JOIN v USING (line_id) WHERE reason IS NULL",
    }


ORACLE_SQL: dict[str, str] = _sql()
