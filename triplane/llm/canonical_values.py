"""Values typed freely, mapped to the entries of a reference list.

A value that holds an entity's id in any form is that entity. Any other value is repaired token by
token: each distinct token is joined to the vocabulary of the reference labels and aliases by edit
distance (one slip: a letter missing, too many, changed, or two exchanged), by way of the strings that
are left when one letter is deleted. Complete entries that share a word with the repaired value are
ranked by soft TF-IDF. A value with a word of its own that no entry has is something else, and one of
abbreviations only says too little.

Everything is computed on distinct values and tokens; a hot value meets its result once, in a join that
adaptive execution splits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import exp, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, use_checkpoints

#: Least soft TF-IDF similarity of an entry.
ACCEPTED = 0.8
#: Similarity of a token that was repaired, and of an abbreviation to its word.
REPAIRED, SHORT = 0.95, 0.9
#: Shortest token that is repaired, and longest abbreviation.
REPAIRABLE, SHORTEST = 4, 4
#: Words that say nothing about which thing is meant.
FREE = frozenset("the a an of de la le el les der die das du da do s etc and".split())
#: Letters of other scripts that look like Latin ones, and those.
LOOKS = str.maketrans("аеосрхуіјѕԁһɑɡορνιαυκАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧօ", "aeocpxyijsdhagopviaukABEKMHOPCTXIJSABEZHIKMNOPTYXo")
#: How words that mean a number begin, by the number.
NUMBER_WORDS = {"1": "one uni mono first", "2": "two bi du second", "3": "three tri third", "4": "four quar quad tetra", "5": "five fif quin pent", "6": "six sext hex", "7": "seven sept hept", "8": "eight oct okt", "9": "nin non", "10": "ten dec"}
_TOKEN = re.compile(r"[^\W_]+")
_JOINED = re.compile(r"(?<=[^\W\d_A-Z]{2})(?=[A-Z][a-zà-ÿ])")
QUERY = "value string, domain string, tokens array<string>"


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", "".join(c for c in text if unicodedata.category(c) != "Cf"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return text.translate(LOOKS) if any("a" <= c <= "z" or "A" <= c <= "Z" for c in text) else text


def tokens_of(text: str) -> list[str]:
    """The words of a value without case, accents and look-alike letters; words run together are split at capitals."""
    return _TOKEN.findall(_JOINED.sub(" ", fold(text)).casefold())


def typed_id(value: Column) -> Column:
    """The entity id that a value consists of, whatever its form; null if it is no id."""
    plain = F.translate(value, "Ｑｑ０１２３４５６７８９，", "Qq0123456789,")
    digits = F.regexp_extract(plain, r"(?i)^[^\p{L}\p{N}]*(?:wd:\s*|https?://\S*/)?q?[\s:_-]*([0-9][0-9,.\s]*)[^\p{L}\p{N}]*$", 1)
    digits = F.regexp_replace(F.regexp_replace(digits, r"[^0-9]", ""), r"^0+", "")
    return F.when(digits != "", F.concat(F.lit("Q"), digits))


def with_tokens(values: DataFrame) -> DataFrame:
    """(value, domain, tokens) of distinct (value, domain)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [tokens_of(v or "") for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.string()))], ["value", "domain", "tokens"])

    return values.select("value", "domain").mapInArrow(run, QUERY)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter missing, too many, changed, or two exchanged turns one string into the other."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def slips(strings: DataFrame, column: str) -> DataFrame:
    """`strings` with a column "left": the string and what is left of it without one of its letters."""
    at = F.sequence(F.lit(1), F.length(column))
    without = F.transform(at, lambda i: F.concat(F.substr(F.col(column), F.lit(1), i - 1), F.substr(F.col(column), i + 1)))
    return strings.withColumn("left", F.explode(F.array_union(F.array(F.col(column)), without)))


def repairs(strings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): each distinct string with the vocabulary words that are it or one slip away; known strings stand for themselves only."""
    import pyarrow as pa

    distinct = strings.select("token").distinct()
    known = distinct.join(vocabulary.select(F.col("word").alias("token")), "token", "left_semi").select("token", F.col("token").alias("word"), F.lit(1.0).alias("sim"))
    unknown = distinct.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti").filter(F.length("token") >= REPAIRABLE)
    met = slips(unknown, "token").join(slips(vocabulary.select("word").filter(F.length("word") >= REPAIRABLE), "word"), "left").select("token", "word").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([one_slip(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    near = met.mapInArrow(run, "token string, word string").withColumn("sim", F.lit(REPAIRED))
    return known.union(near)


_NUMBERED = re.compile(r"(\d+)([^\W\d_]+)").fullmatch


def beginnings(short: str) -> list[str]:
    """How words can begin that a token is an abbreviation of."""
    m = _NUMBERED(short)
    return NUMBER_WORDS.get(m[1], "").split() if m else [short[0]]


def short_for(short: str, word: str) -> bool:
    """Whether a token can be an abbreviation of a word: an initial, a few of its letters in their order, or a number with the word's end ("4tet")."""
    if len(short) > SHORTEST or len(short) >= len(word):
        return False
    if m := _NUMBERED(short):
        return word.endswith(m[2]) and any(word.startswith(x) for x in beginnings(short))
    if short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def rank(tokens: list[str], repaired: dict[str, dict[str, float]], entry: dict[str, float], domain: str) -> float:
    """Soft TF-IDF similarity of a value's tokens to an entry's; 0 if the value has a word that isn't the entry's, or abbreviations only.

    The words of FREE and the name of the entry's domain are no words of its own. entry: word to weight.
    """
    left, dot, q2, said, written = dict(entry), 0.0, 0.0, False, False
    for t in tokens:
        best = max(((sim, w) for w, sim in repaired.get(t, {}).items() if w in left), default=None)
        written |= best is not None and best[1] not in FREE
        if best is None:
            best = max(((SHORT, w) for w in left if short_for(t, w)), default=None)
        if best is not None:
            weight = left.pop(best[1]) if best[1] not in FREE else left.pop(best[1]) * 0.01
            dot += best[0] * weight * weight
            q2 += weight * weight
        elif t == domain:
            said = True
        elif t not in FREE and not (repaired.get(t) and set(repaired[t]) & FREE):
            return 0.0
    e2 = sum((w * 0.01) ** 2 if t in FREE else w * w for t, w in entry.items())
    return dot / sqrt(q2 * e2) + 0.01 * said if written and q2 and e2 else 0.0


def best_entries(queries: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, domain, id): the closest entry of each distinct value, if one is accepted.

    On a tie the smallest id counts. A domain that isn't null leaves only its entities. Distinct values,
    entries, vocabulary and repairs are checkpointed: several steps read each of them.
    """
    import pyarrow as pa

    use_checkpoints(queries.sparkSession)
    entries = with_tokens(
        entities.select(F.col("label").alias("value"), F.col("id").alias("domain")).union(aliases.select(F.col("alias"), "id")).distinct()
    ).select(F.col("domain").alias("id"), F.array_distinct("tokens").alias("words"))
    entries = entries.join(entities.select("id", F.col("domain_name").alias("of")), "id").filter(F.size("words") > 0).checkpoint()
    total = entries.select("id").distinct().count()
    words = entries.select("id", F.explode("words").alias("word")).groupBy("word").agg(F.countDistinct("id").alias("df"))
    words = words.select("word", F.log(1 + total / F.col("df")).alias("w")).checkpoint()
    queries = queries.checkpoint()

    tokens = queries.select("value", "domain", "tokens", F.explode("tokens").alias("token"))
    # A domain's name may stand beside an entity's: it is known too, as no word (empty, without weight).
    domains = entities.select(F.lower("domain_name").alias("token")).filter("token IS NOT NULL").distinct()
    named = tokens.select("token").distinct().join(domains, "token", "left_semi").select(F.lit("").alias("word"), "token", F.lit(0.0).alias("sim"), F.lit(0.0).alias("w"))
    fixed = repairs(tokens, words).join(words, "word").select("word", "token", "sim", "w").union(named).checkpoint()
    mended = tokens.join(fixed, "token", "left").groupBy("value", "domain", "tokens").agg(F.collect_set(F.struct("token", "word", "sim", "w")).alias("fixes"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each value with the words to look its entries up by.

        Every token that is neither free nor a domain's name must be a word of an accepted entry (rank()), so
        one is enough: the rarest of those too long for an abbreviation, with all its repairs. A value without
        such a token is looked up by all words that its tokens are or are repaired to, one of which an accepted
        entry has. A value with a long token that is none of these has no entry.
        """
        for batch in batches:
            at, out = [], []
            for n, (ts, fixes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words: dict[str, dict[str, float]] = {}
                domains = set()
                for f in fixes:
                    if f["word"]:
                        words.setdefault(f["token"], {})[f["word"]] = f["w"]
                    elif f["word"] == "":
                        domains.add(f["token"])
                long = [t for t in ts if len(t) > SHORTEST and t not in FREE and t not in domains]
                if any(t not in words for t in long):
                    continue
                lookups = [w for t, w in words.items() if t in long and not FREE.intersection(w)]
                # The number of entries with a word, but for a factor.
                best = min(lookups, key=lambda w: (sum(1 / (exp(x) - 1) for x in w.values()), sorted(w)), default=None)
                found = sorted(best) if best else sorted({w for ws in words.values() for w in ws} - FREE)
                at += [n] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(out, pa.string())], [*batch.schema.names, "word"])

    fixes = "fixes array<struct<token:string,word:string,sim:double,w:double>>"
    probes = mended.mapInArrow(chosen, f"{QUERY}, {fixes}, word string")
    weighted = entries.select("id", "of", "words", F.explode("words").alias("word")).join(words, "word")
    weighted = weighted.groupBy("id", "of", "words").agg(F.collect_list(F.struct("word", "w")).alias("weights"))
    by_word = weighted.select("id", "of", "weights", F.explode("words").alias("word"))
    # A value that shares several words with an entry is ranked against it several times; the best rank counts.
    met = probes.join(by_word, "word").filter(F.col("domain").isNull() | (F.col("domain") == F.col("of"))).drop("word")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for ts, fx, of, weights in zip(*(batch.column(c).to_pylist() for c in ("tokens", "fixes", "of", "weights"))):
                repaired: dict[str, dict[str, float]] = {}
                for f in fx:
                    if f["word"]:
                        repaired.setdefault(f["token"], {})[f["word"]] = f["sim"]
                scores.append(rank(ts, repaired, {x["word"]: x["w"] for x in weights}, of))
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("domain"), batch.column("id"), pa.array(scores, pa.float64())], ["value", "domain", "id", "score"])

    ranked = met.mapInArrow(scored, "value string, domain string, id string, score double").filter(F.col("score") >= ACCEPTED)
    # Words run together: the whole value against whole entries.
    joined = queries.select("value", "domain", F.array_join("tokens", "").alias("token"))
    whole = entries.select("id", "of", F.array_join("words", "").alias("word"))
    fused = repairs(joined, whole.select("word").distinct()).join(joined, "token").join(whole, "word")
    fused = fused.filter(F.col("domain").isNull() | (F.col("domain") == F.col("of"))).select("value", "domain", "id", (F.col("sim") - 0.04).alias("score"))
    best = F.min(F.struct((-F.round("score", 6)).alias("rank"), "id"))
    return ranked.union(fused).groupBy("value", "domain").agg(best.alias("best")).select("value", "domain", F.col("best.id").alias("id"))


def mapped(rows: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, row_id, id) of rows (src, row_id, typed, value, domain): the entity meant, or "none".

    Rows with both fields null or blank are left out. An id typed in either field counts before any
    name, the id field's first.
    """
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")) == "", F.lit(True))
    rows = rows.filter(~(blank(F.col("typed")) & blank(F.col("value"))))
    ids = entities.select("id").distinct()
    rows = rows.withColumn("first", typed_id(F.col("typed"))).withColumn("second", typed_id(F.col("value")))
    rows = rows.join(ids.select(F.col("id").alias("first"), F.col("id").alias("by_typed")), "first", "left")
    rows = rows.join(ids.select(F.col("id").alias("second"), F.col("id").alias("by_value")), "second", "left")
    rows = rows.select("src", "row_id", "value", "domain", F.coalesce("by_typed", "by_value").alias("known"))
    named = rows.filter("known IS NULL")
    queries = with_tokens(named.select("value", "domain").distinct().filter("value IS NOT NULL")).filter(F.size("tokens") > 0)
    best = best_entries(queries, entities, aliases).withColumnRenamed("value", "v").withColumnRenamed("domain", "d")
    found = named.join(best, (F.col("value") == F.col("v")) & F.col("domain").eqNullSafe(F.col("d")), "left")
    out = found.select("src", "row_id", F.coalesce("id", F.lit("none")).alias("id"))
    return rows.filter("known IS NOT NULL").select("src", "row_id", F.col("known").alias("id")).union(out)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    entities = table(spark, directory, "entities")
    mentions = table(spark, directory, "mentions").join(entities.select("id").distinct(), "id", "left_anti")
    mentions = mentions.select(F.lit("mentions").alias("src"), F.col("mention_id").alias("row_id"), F.col("id").alias("typed"), F.col("label").alias("value"), F.col("domain_name").alias("domain"))
    labels = table(spark, directory, "labels").filter("id IS NULL")
    labels = labels.select(F.lit("labels").alias("src"), F.col("label_id").alias("row_id"), F.col("id").alias("typed"), F.col("label").alias("value"), F.lit(None).cast("string").alias("domain"))
    return mapped(mentions.union(labels), entities, table(spark, directory, "entity_aliases"))


def p5_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    """How many rows of each table were mapped, and how many match no entity."""
    return p5_found(spark, directory).groupBy("src").agg(F.count("*").alias("n_rows"), F.count_if(F.col("id") == "none").alias("n_unmatched"))


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}
ORACLE_SQL: dict[str, str] = {}
