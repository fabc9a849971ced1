"""Text, label and value functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = range(0x300, 0x370)


def _accented() -> dict[str, str]:
    """Each character that decomposes into one other and combining marks of MARKS, with that other one."""
    out = {}
    for c in map(chr, range(0xC0, 0x30000)):  # no later character decomposes
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            base = [x for x in unicodedata.normalize("NFD", c) if ord(x) not in MARKS]
            if len(base) == 1 and base[0] != c:
                out[c] = base[0]
    return out


#: Letters with accents of all scripts, and the letters without them.
ACCENTED, BASE = map("".join, zip(*_accented().items()))
#: Words that similarity leaves out.
STOP_WORDS = "a an the of in on at to for by with and or is are was were be been it its this that from as".split()
KEYWORDS = "class import query action list filter sort count sum avg min max any of true false null enum new".split()


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"[() _-]+", "_"))


def remove_accent(c: Column) -> Column:
    """Letters with accents as the letters without; combining marks go. Letters that decompose into several, as Korean syllables do, stay composed."""
    return F.regexp_replace(F.translate(c, ACCENTED, BASE), r"[\x{300}-\x{36f}]", "")


def remove_end_punctuation(c: Column) -> Column:
    """Without the sign at the very end of the text; a line feed after it keeps it."""
    return F.regexp_replace(c, r"[.!?]\z", "")


def clean_name(c: Column) -> Column:
    """A name usable as an identifier. The digit 0 is replaced and double underscores are halved once: existing names depend on it."""
    s = snake_case(F.replace(c, F.lit("(s)"), F.lit("s")))
    s = remove_accent(F.replace(s, F.lit("u.s."), F.lit("us")))
    s = F.replace(F.regexp_replace(s, r"[^1-9a-zA-Z]", "_"), F.lit("__"), F.lit("_"))
    return F.when(~s.rlike(r"^[a-z_]") | s.isin(*KEYWORDS), F.concat(F.lit("_"), s)).otherwise(s)


def stem(c: Column) -> Column:
    """A light suffix stripper: plurals, -ing and -ed of words that stay three letters long."""
    s = F.regexp_replace(c, r"^(\w{2,})ies$", "$1y")
    s = F.regexp_replace(s, r"^(\w{3,})(?:ing|ed|es)$", "$1")
    return F.regexp_replace(s, r"^(\w{2,}[^s])s$", "$1")


def content_words(c: Column) -> Column:
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(words, stem)


def similarity(a: Column, b: Column, metric: str = "f1") -> Column:
    """Overlap of stemmed content words: f1 or jaccard. Shared words of a count as often as they occur, all words of the union once; 0 if either side has none."""
    x, y = content_words(a), content_words(b)
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    if metric == "f1":
        p, r = common / F.size(x), common / F.size(y)
        score = F.when(common == 0, 0.0).otherwise(2 * p * r / (p + r))
    else:
        score = common / F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | a.isNull() | b.isNull(), 0.0).otherwise(score)


def spans(c: Column) -> Column:
    """All token n-grams of a text, longest first, from left to right within a length."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    n = F.size(words)
    by_length = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.sequence(F.lit(0), k), lambda i: F.array_join(F.slice(words, i + 1, n - k), " ")))
    return F.when(n > 0, F.flatten(by_length)).otherwise(F.array().cast("array<string>"))


def spans_in_order(c: Column) -> Column:
    """All token n-grams of a text without the sign at its end, shortest first, from left to right within a length. Tokens stand between white space of any kind.

    A blank end of the text is an empty token; an empty text has one empty span, a null none.
    """
    words = F.split(remove_end_punctuation(c), r"[\s\p{Z}\x{feff}]+", -1)
    n = F.size(words)
    by_length = F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.when(c.isNotNull(), F.flatten(by_length)).otherwise(F.array().cast("array<string>"))


def closest(text: Column, candidates: Column, metric: str = "f1", least: float = 0.0) -> Column:
    """The candidate most similar to a text, the first of several; null if none is by more than `least`."""
    scored = F.transform(candidates, lambda x, i: F.struct(similarity(text, x, metric).alias("score"), (-i).alias("place"), x.alias("x")))
    return F.array_max(F.filter(scored, lambda s: s.score > least)).x


def sample_labels(labels: Column, k: int = 5) -> Column:
    """The k shortest labels of letters, spaces and hyphens, without a leading "is ", in their order among equals."""
    kept = F.filter(F.transform(labels, lambda x: F.regexp_replace(x, r"^is ", "")), lambda x: x.rlike(r"^[a-zA-Z -]+\z"))
    ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.slice(F.transform(ranked, lambda x: x.x), 1, k)


def value_kind(c: Column) -> Column:
    """entity, number, date or string."""
    return (
        F.when(c.rlike(r"^Q[0-9]+$"), "entity").when(c.try_cast("double").isNotNull(), "number").when(c.try_cast("timestamp").isNotNull(), "date").when(c.isNotNull(), "string")
    )


def entity_ids(c: Column) -> Column:
    """The distinct entity ids in a text, in their order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"Q[0-9]+"), F.lit(0)))


def year_if_new_year(c: Column) -> Column:
    return F.when((F.month(c) == 1) & (F.day(c) == 1), F.year(c))


def safe_divide(a: Column, b: Column) -> Column:
    """0/0 is 1, and anything else over 0 infinite."""
    return F.when((b == 0) & (a == 0), 1.0).when(b == 0, float("inf")).otherwise(a / b)
