"""Text that looks the same but is written with different characters, brought to one form.

A text is normalised for compatibility as far as that doesn't show (full width, ligatures, Roman
numerals, spaces, hyphens), ignorable characters are deleted, and accents are composed. In each word
every letter opens a column of its look-alikes in all scripts. A Viterbi search through that lattice under
character-pair scores gives the word's best reading in each script that has a letter in every column, or,
if no script has, the best one with changes of script. A second search over the readings of a text's words
chooses among them, with a penalty for a change of script from word to word. Every word of every text is
searched. Texts that look the same have the same lattices, hence one form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import key128, table, use_checkpoints

#: Letters that look alike in common fonts, one class a group; base letters without accents.
LOOK_ALIKES = """
aаɑα cсϲ dԁ eе gɡ hһ iі jјϳ lӏ nո oоοօ pрρ qԛ sѕ uս vνѵ wԝ xх yу
AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅՏ TТΤ UՍ VѴ WԜ XХΧ YΥҮ ZΖ
""".split()
#: Hyphens that look like the ASCII one.
HYPHENS = "‐‑"
#: Log scores of a change of script within a word and between words.
SWITCH, WORD_SWITCH = -30.0, -8.0
#: Distinct words that a worker remembers before it starts anew; the result doesn't depend on it.
REMEMBERED = 200_000
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_CLASS = {c: group for group in LOOK_ALIKES for c in group}

class _Compatible(dict):
    """str.translate table of one character: its compatible form where that looks the same, nothing for ignorable ones."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind, tag = unicodedata.category(c), unicodedata.decomposition(c).partition(" ")[0]
        if kind == "Cf" or code in (0x34F, 0x115F, 0x1160, 0x3164) or 0xFE00 <= code <= 0xFE0F:
            out = ""
        elif kind == "Zs":
            out = " "
        elif c in HYPHENS:
            out = "-"
        elif tag in ("<wide>", "<narrow>") or tag == "<compat>" and (0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F or code in (0x132, 0x133) or 0x1C4 <= code <= 0x1CC or 0x1F1 <= code <= 0x1F3):
            out = unicodedata.normalize("NFKC", c)
        else:
            out = c
        self[code] = out
        return out


_COMPATIBLE = _Compatible()
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


@lru_cache(100_000)
def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ", 1)[0]


_LETTERS_ONLY = {i: chr(i) if chr(i).isalpha() else " " for i in range(128)}


def words_of(text: str) -> list[str]:
    """The runs of letters, with their marks, of a compatible() text."""
    return text.translate(_LETTERS_ONLY).split() if text.isascii() else _WORD.findall(text)


def compatible(text: str) -> str:
    """The text without ignorable characters, compatible where that doesn't show, accents decomposed."""
    return text if text.isascii() else unicodedata.normalize("NFD", text.translate(_COMPATIBLE))


def pair_counts(words: Counter) -> Counter:
    """(script, letter, next letter) counts of the words of one script; ^ and $ are the ends of a word."""
    pairs: dict[str, Counter] = {s: Counter() for s in SCRIPTS}
    for word, n in words.items():
        if word.isascii():
            s, base = "LATIN", f"^{word}$"
        else:
            letters = [c for c in compatible(word) if not unicodedata.combining(c)]
            scripts = set(map(script, letters))
            s, base = scripts.pop() if len(scripts) == 1 else "", f"^{''.join(letters)}$"
        if s in pairs:
            count = pairs[s]
            for i in range(len(base) - 1):
                count[base[i : i + 2]] += n
    return Counter({(s, x[0], x[1]): n for s, count in pairs.items() for x, n in count.items()})


class Reader:
    """Reads texts through the lattices of look-alikes under given pair counts."""

    def __init__(self, pairs: dict[tuple[str, str, str], int]):
        first, words = Counter(), Counter()
        for (s, a, _), n in pairs.items():
            first[s, a] += n
            if a == "^":
                words[s] += n
        self.pairs, self.first, self.total = pairs, first, sum(first.values())
        self.share = {s: log((words[s] + 0.5) / (words.total() + 2)) for s in SCRIPTS}
        self.readings = lru_cache(REMEMBERED)(self._readings)
        self.score = lru_cache(None)(self._score)
        self.candidates = lru_cache(100_000)(self._candidates)
        self.only = lru_cache(100_000)(self._only)
        #: ASCII words of which the best reading is the word itself.
        self.plain: set[str] = set()

    def _candidates(self, c: str) -> tuple[list[str], ...]:
        """The look-alikes of a letter in each of SCRIPTS, as far as words of that script have them; the first one if none has."""
        alike = ([x for x in _CLASS.get(c, c) if script(x) == s] for s in SCRIPTS)
        return tuple([x for x in xs if (s, x) in self.first] or xs[:1] for s, xs in zip(SCRIPTS, alike))

    def _only(self, c: str) -> str:
        """The script of a letter that no other script can write and that is its only candidate there; "" for any other letter."""
        alike = self.candidates(c)
        own = [s for s, xs in zip(SCRIPTS, alike) if xs]
        return own[0] if len(own) == 1 and [c] in alike else ""

    def _score(self, s: str, a: str, b: str) -> float:
        """Log probability of b after a in a script, smoothed by how frequent b is."""
        alone = (self.first.get((s, b), 0) + 0.01) / (self.total + 1)
        return log((self.pairs.get((s, a, b), 0) + 5 * alone) / (self.first.get((s, a), 0) + 5))

    def _best(self, columns: list[list[str]]) -> tuple[float, list[str]]:
        """The Viterbi path through columns of candidates and its score; on a tie the candidate first in its class. Linear in the columns."""
        now, back = {("", "^"): 0.0}, []
        for column in [*columns, ["$"]]:
            new, came = {}, {}
            for c in column:
                s = script(c) if c.isalpha() else ""
                best = None
                for (last, a), value in now.items():
                    of = s or last
                    v = value + (self.score(of, a, c) if last in ("", of) else SWITCH)
                    if best is None or v > best[0]:
                        best = (v, of, (last, a))
                new[best[1], c], came[best[1], c] = best[0], best[2]
            now = new
            back.append(came)
        state, value = next(iter(now.items()))
        path = []
        for came in reversed(back):
            path.append(state[1])
            state = came[state]
        return value, path[:0:-1]

    def _within(self, s: str, columns: list[list[str]]) -> tuple[float, list[str]]:
        """_best() for columns of one script."""
        if all(len(c) == 1 for c in columns):
            path = [c[0] for c in columns]
            value, last = 0.0, "^"
            for c in path:
                value += self.score(s, last, c)
                last = c
            return value + self.score(s, last, "$"), path
        now: list[tuple] = [(0.0, "^", None)]
        for column in [*columns, "$"]:
            new = []
            for c in column:
                if len(now) == 1:
                    last = now[0]
                    new.append((last[0] + self.score(s, last[1], c), c, last))
                else:
                    new.append(max(((x[0] + self.score(s, x[1], c), c, x) for x in now), key=lambda x: x[0]))
            now = new
        node, path = now[0][2], []
        while node[2]:
            path.append(node[1])
            node = node[2]
        return now[0][0], path[::-1]

    def _readings(self, word: str) -> list[tuple[str, float, str]]:
        """(script, score, form): the best reading of a word in each script that can write it, the best script first; with changes of script, and without a script, if none can."""
        at, found = range(len(word)) if word.isascii() else [i for i, c in enumerate(word) if not unicodedata.combining(c)], []
        alike = [self.candidates(word[i]) for i in at]
        # One letter of one script only decides the script, and if every letter has one candidate there, the search has one path.
        bound = next(filter(None, map(self.only, word)), "")
        if bound and all([len(o[SCRIPTS.index(bound)]) == 1 for o in alike]):
            n, form = SCRIPTS.index(bound), list(word)
            for i, o in zip(at, alike):
                form[i] = o[n][0]
            return [(bound, 0.0, "".join(form))]
        for s, own in zip(SCRIPTS, zip(*alike)):
            if not all(own):
                continue
            value, path = self._within(s, own)
            found.append((s, value + self.share[s], path))
        if not found:
            found.append(("", *self._best([list(_CLASS.get(word[i], word[i])) for i in at])))
        out = []
        for s, value, path in found:
            form = list(word)
            for i, c in zip(at, path):
                form[i] = c
            out.append((s, value, "".join(form)))
        return sorted(out, key=lambda r: -r[1])

    @staticmethod
    def chosen(readings: list[list[tuple[str, float, str]]]) -> list[str]:
        """One reading for each word of a text, by the scores and the changes of script between words."""
        if len({r[0][0] for r in readings} - {""}) < 2:  # the best of all words, without a change
            return [r[0][2] for r in readings]
        now, back = {"": 0.0}, []
        for options in readings:
            new: dict[str, float] = {}
            came = {}
            for s, value, form in options:
                for last, before in now.items():
                    v = before + value + (WORD_SWITCH if s and last and s != last else 0.0)
                    to = s or last
                    if to not in new or v > new[to]:
                        new[to], came[to] = v, (last, form)
            now = new
            back.append(came)
        state, out = max(now, key=now.get), []
        for came in reversed(back):
            state, form = came[state]
            out.append(form)
        return out[::-1]

    def text(self, text: str) -> str:
        plain = compatible(text)
        words = words_of(plain)
        if self.plain.issuperset(words):
            return plain
        readings = list(map(self.readings, words))
        if len(self.plain) > REMEMBERED:
            self.plain.clear()
        self.plain.update(w for w, r in zip(words, readings) if r[0][0] == "LATIN" and r[0][2] == w and w.isascii())
        forms = self.chosen(readings)
        if forms != words:
            left = iter(forms)
            plain = _WORD.sub(lambda m: next(left), plain)
        return plain if plain.isascii() else unicodedata.normalize("NFC", plain)


def letter_pairs(texts: DataFrame, column: str) -> dict[tuple[str, str, str], int]:
    """Pair counts over all words of all texts. At most the square of the letters of four scripts comes to the driver."""
    import pyarrow as pa

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(words_of(t))
            if len(words) > REMEMBERED:
                counts += pair_counts(words)
                words.clear()
        counts += pair_counts(words)
        columns = [pa.array([k[i] for k in counts], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["script", "a", "b", "n"])

    counted = texts.select(column).mapInArrow(pairs, "script string, a string, b string, n bigint").groupBy("script", "a", "b").agg(F.sum("n").alias("n"))
    return {(r.script, r.a, r.b): r.n for r in counted.collect()}


_READERS: dict[str, Reader] = {}


def worker_reader(name: str, pairs: dict) -> Reader:
    """The reader under given pair counts, made once in each worker."""
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = Reader(pairs)
    return _READERS[name]


def with_form(rows: DataFrame, column: str, pairs: dict) -> DataFrame:
    """`rows` with a column "form"."""
    import pyarrow as pa

    names = [*rows.columns, "form"]
    where = rows.columns.index(column)
    shared, name = rows.sparkSession.sparkContext.broadcast(pairs), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = worker_reader(name, shared.value)
        for batch in batches:
            forms = [reader.text(t) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("form", T.StringType())]))


def unified(rows: DataFrame) -> DataFrame:
    """(src, id, text, form) of rows (src, id, text); null and empty texts are left out."""
    filled = rows.select("src", "id", "text").filter("text != ''")
    return with_form(filled, "text", letter_pairs(filled, "text"))


def several_texts(rows: DataFrame) -> DataFrame:
    """(src, id, f1, f2, t1, t2): the rows whose form other texts of their src have too; form and text by hash.

    Every row's hashes are checkpointed once, and the few rows left again. Texts that look like nothing at all have no form.
    """
    use_checkpoints(rows.sparkSession)
    (t1, t2), (f1, f2) = key128(F.col("text")), key128(F.col("form"))
    keyed = unified(rows).filter("trim(form) != ''").select("src", "id", f1.alias("f1"), f2.alias("f2"), t1.alias("t1"), t2.alias("t2")).checkpoint()
    text = F.struct("t1", "t2")
    forms = keyed.groupBy("src", "f1", "f2").agg(F.min(text).alias("least"), F.max(text).alias("most")).filter("least < most")
    return keyed.join(forms.select("src", "f1", "f2"), ["src", "f1", "f2"], "left_semi").checkpoint()


def same_looking(rows: DataFrame) -> DataFrame:
    """(src, id_a, id_b), smaller first: rows of one src whose text looks the same but differs in its characters.

    Texts are paired within their form, distinct ones only and by hash, and the pairs then meet their
    rows; rows with the same text never meet. Null and empty texts have no case.
    """
    keyed = several_texts(rows)
    members = keyed.groupBy("src", "f1", "f2", "t1", "t2").agg(F.lit(1).alias("one")).drop("one")
    others = members.select("src", "f1", "f2", F.col("t1").alias("o1"), F.col("t2").alias("o2"))
    pairs = members.join(others, ["src", "f1", "f2"]).filter("t1 < o1 OR t1 = o1 AND t2 < o2").select("src", "t1", "t2", "o1", "o2")
    left = keyed.select("src", "t1", "t2", F.col("id").alias("a"))
    right = keyed.select("src", F.col("t1").alias("o1"), F.col("t2").alias("o2"), F.col("id").alias("b"))
    found = pairs.join(left, ["src", "t1", "t2"]).join(right, ["src", "o1", "o2"])
    return found.select("src", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def looks(rows: DataFrame) -> DataFrame:
    """(src, id, class_id, n_links): the rows that have a case, each with the smallest id of its class and the number of rows that it makes a case with.

    One row for each row, whatever the classes' sizes; same_looking() is its expansion into pairs.
    """
    keyed = several_texts(rows)
    texts = keyed.groupBy("src", "f1", "f2", "t1", "t2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    forms = texts.groupBy("src", "f1", "f2").agg(F.sum("n").alias("of"), F.min("least").alias("class_id"))
    counts = texts.join(forms, ["src", "f1", "f2"]).select("src", "t1", "t2", "class_id", (F.col("of") - F.col("n")).alias("n_links"))
    return keyed.join(counts, ["src", "t1", "t2"]).select("src", "id", "class_id", "n_links")


def texts(spark: SparkSession, directory: str) -> DataFrame:
    labels = table(spark, directory, "labels").select(F.lit("labels").alias("src"), F.col("label_id").alias("id"), F.col("label").alias("text"))
    examples = table(spark, directory, "examples").select(F.lit("examples").alias("src"), F.col("row_id").alias("id"), F.col("utterance").alias("text"))
    return labels.union(examples)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return same_looking(texts(spark, directory))


def p4_classes(spark: SparkSession, directory: str) -> DataFrame:
    return looks(texts(spark, directory))


def p4_forms(spark: SparkSession, directory: str) -> DataFrame:
    """The one form of every text that isn't in it yet."""
    return unified(texts(spark, directory)).filter("form != text")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms}


def oracle_sql() -> dict[str, str]:
    """What looks the same, once more and without a search: every character as the first of its class, composed.

    Texts have the same lattices if and only if this form is the same. Its tables come from the rules above.
    """
    quote = lambda x: x.replace("'", "''")
    codes = [c for c in map(chr, range(0xA0, 0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    compatible_form = {c: _COMPATIBLE[ord(c)] for c in codes if _COMPATIBLE[ord(c)] != c}
    single = {c: x for c, x in compatible_form.items() if len(x) == 1}
    gone = [c for c, x in compatible_form.items() if not x]
    form = f"translate(TEXT, '{quote(''.join([*single, *gone]))}', '{quote(''.join(single.values()))}')"
    for c, x in compatible_form.items():
        if len(x) > 1:
            form = f"replace({form}, '{c}', '{quote(x)}')"
    first = {c: group[0] for c, group in _CLASS.items() if group[0] != c}
    for c in codes:
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in _CLASS:
            alike = unicodedata.normalize("NFC", _CLASS[parts[0]][0] + parts[1:])
            if len(alike) == 1 and alike != c:
                first[c] = alike
    form = f"nfc_normalize(translate(nfc_normalize({form}), '{''.join(first)}', '{''.join(first.values())}'))"
    texts = "(SELECT 'labels' AS src, label_id AS id, label AS text FROM labels UNION ALL SELECT 'examples', row_id, utterance FROM examples)"
    forms = f"WITH f AS (SELECT src, id, text, {form.replace('TEXT', 'text')} AS form FROM {texts} WHERE text <> ''), p AS (SELECT a.src, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.src = b.src AND a.form = b.form AND a.id < b.id AND a.text <> b.text WHERE trim(a.form) <> '')"
    both = "(SELECT src, id_a AS id, id_b AS other FROM p UNION ALL SELECT src, id_b, id_a FROM p)"
    return {
        "p4_found": f"{forms} SELECT src, id_a, id_b FROM p",
        "p4_classes": f"{forms}, k AS (SELECT src, form, min(id) AS class_id FROM f GROUP BY src, form) SELECT l.src, l.id, class_id, count(*) AS n_links FROM {both} l JOIN f ON f.src = l.src AND f.id = l.id JOIN k ON k.src = f.src AND k.form = f.form GROUP BY l.src, l.id, class_id",
    }
