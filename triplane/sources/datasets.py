"""Dataset files: question JSON, program and prediction TSV, parameter datasets and cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "questions array<struct<id:string,question:array<struct<language:string,string:string>>,query:struct<sparql:string>,answers:array<string>>>"


def read_questions(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """[at, id, utterance, sparql, answers] of a question file; the first `offset` questions are skipped."""
    file = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    rows = file.select(F.posexplode("questions").alias("at", "q")).filter(F.col("at") >= offset)
    answer = F.get(F.col("q.answers"), F.lit(0))
    return rows.select("at", "q.id", F.get(F.col("q.question"), F.lit(0)).getField("string").alias("utterance"), "q.query.sparql", result_values(answer).alias("answers"))


def result_values(response) -> F.Column:
    """The list of answers in a SPARQL JSON response: the first bound variable of each binding, entity IRIs as Q numbers.

    A boolean response is its word; a null response is an empty list.
    """
    parsed = F.from_json(response, "boolean boolean, results struct<bindings:array<map<string,struct<type:string,value:string>>>>")
    values = F.transform(F.filter(parsed["results"]["bindings"], lambda b: F.size(b) > 0), lambda b: F.regexp_replace(F.map_values(b)[0]["value"], r"^https?://.*/entity/", ""))
    return F.when(parsed["boolean"].isNotNull(), F.array(parsed["boolean"].cast("string"))).otherwise(F.coalesce(values, F.array().cast("array<string>")))


def read_programs(spark: SparkSession, path: str, columns: str = "id string, utterance string, thingtalk string") -> DataFrame:
    """A TSV file of programs, without quoting."""
    return spark.read.schema(columns).option("sep", "\t").option("quote", "").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """[id, utterance, answers, sparql]: answers are split at spaces; an empty field is an empty list."""
    raw = spark.read.schema("id string, utterance string, answers string, sparql string").option("sep", "\t").option("quote", "").csv(path)
    return raw.withColumn("answers", F.filter(F.split(F.coalesce("answers", F.lit("")), " "), lambda x: x != ""))


def write_programs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(path)


def tokenized(c) -> F.Column:
    """A name in lower case with a space around every sign."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"([^\p{L}\p{M}\p{N}\s])", " $1 "), r"\s+", " "))


def write_parameters(entities: DataFrame, path: str) -> None:
    """Parameter datasets: one folder of JSON lines for each domain, with value, name and canonical form; entities without a name are left out.

    A large domain is several files: its rows are split among tasks by adaptive execution.
    """
    rows = entities.filter("label IS NOT NULL").select("domain_name", F.col("id").alias("value"), F.col("label").alias("name"), F.lower("label").alias("canonical"))
    rows.hint("rebalance", "domain_name").write.mode("overwrite").partitionBy("domain_name").json(path)


def write_strings(values: DataFrame, path: str) -> None:
    """String datasets of values [property, value]: for each property a folder of TSV lines, the distinct values with their tokens and weight 1."""
    rows = values.filter("value IS NOT NULL").select("property", "value").distinct().select("property", "value", tokenized("value").alias("tokens"), F.lit(1).alias("weight"))
    rows.hint("rebalance", "property").write.mode("overwrite").option("sep", "\t").option("quote", "").option("escapeQuotes", False).option("emptyValue", "").partitionBy("property").csv(path)


def write_index(entities: DataFrame, strings: DataFrame, path: str) -> None:
    """The index of parameter datasets as TSV: kind, language, name and folder of each domain and string property."""
    line = lambda kind, prefix, c: F.concat_ws("\t", F.lit(kind), F.lit("en-US"), F.concat(F.lit(prefix), c), F.concat(F.lit(f"parameter-datasets/{prefix.split(':')[1]}"), c)).alias("line")
    domains = entities.filter("domain_name IS NOT NULL").select("domain_name").distinct().select(line("entity", "wd:", F.col("domain_name")))
    properties = strings.filter("property IS NOT NULL").select("property").distinct().select(line("string", "wd:p_", F.col("property")))
    domains.union(properties).orderBy("line").write.mode("overwrite").text(path)


def write_entities(domains: DataFrame, path: str) -> None:
    """The entity types of domains [name, canonical, has_ner] as JSON lines: type, name and whether linkers know them."""
    domains.select(F.concat(F.lit("wd:"), F.col("name")).alias("type"), F.col("canonical").alias("name"), F.coalesce("has_ner", F.lit(False)).alias("has_ner_support")).write.mode("overwrite").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest [domain, pid, name, kind, qualifiers ...] as JSON lines, one for each domain with its properties in order. A domain has as many as the catalog has properties."""
    columns = [c for c in manifest.columns if c != "domain"]
    ordered = F.array_sort(F.collect_list(F.struct("pid", *[c for c in columns if c != "pid"])))
    manifest.groupBy("domain").agg(ordered.alias("properties")).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a written manifest."""
    rows = spark.read.json(path).select("domain", F.explode("properties").alias("p"))
    return rows.select("domain", "p.*")
