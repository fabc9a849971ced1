"""Documents that hold passages of held-out evaluation items.

Texts become templates: words that are common in the corpus stay, numbers, units and all other words
(names, above all) become typed placeholders, a run of names one placeholder. Which words are common is
counted once over all documents, so an item's template, and with it its result, depends on no other
item. Windows of five template tokens are hashed; a document's windows are hash-joined with those of the
items while it is scanned. Where windows of one item gather within a passage of the item's length, the
passage is aligned with the item word by word: what counts is the part of the item's words, and of its
slot fillers, found in blocks of three or more words in their order. A passage that shares the template
and fills its slots otherwise, each filler always by the same other one, is a re-parameterised item: it
is told from a copy and reported apart.

The items are a stated query set: they are taken in blocks of at most BLOCK_WORDS words, each block's
items are broadcast, a worker makes their window table once, and the documents are scanned once for each
block, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import accumulate
from math import ceil
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import table

#: Words of items in one broadcast block: 2 million words are below 100 MB in each worker.
BLOCK_WORDS = 2_000_000
#: Template tokens in a window.
WINDOW = 5
#: Part of the documents that a common word is in, two documents at least. So there are at most 1 / COMMON
#: times as many common words as a document has distinct words on average, whatever the corpus.
COMMON = 0.005
#: Tokens a worker remembers before it starts anew, and texts tested together; the result depends on neither.
REMEMBERED, SLICE = 500_000, 256
#: Part of an item's windows that must gather for an alignment.
GATHERED = 0.2
#: Part of the item's words, and of its slot fillers, that the passage must hold.
HELD, SLOTS = 0.5, 0.25
#: Shortest block of words that counts as held.
BLOCK = 3
#: Part of an item's template that a re-parameterised passage has, and of its slot fillers that agree on one other filler.
ALIKE, AGREED = 0.8, 0.8
#: Template windows below which an item is looked for by plain words too.
FEW = 8
NAME, NUMBER, UNIT = 0, 1, 2
#: Units of measure.
UNITS = frozenset("km m cm mm kg g t ha mi ft lb s min h kilometre kilometres kilometer kilometers kilómetro kilometros kilometro kilomètre kilomètres kilometre kilometern metre metres meter meters metros mètres hours minutes seconds percent".split())
_WORD = re.compile(r"[^\W_]+")
_IGNORED = dict.fromkeys(range(0x200B, 0x2010)) | dict.fromkeys([0xAD, 0x2060, 0xFEFF])
_MARKS = re.compile(r"[\u0300-\u036f]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t\r]*\n\s*(?=[^\W\d_])")


def words_of(text: str) -> list[str]:
    """Words without case, accents, punctuation and layout; a word broken at a line's end is joined."""
    if "-" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", text.translate(_IGNORED).casefold())
    return _WORD.findall(_MARKS.sub("", text))


class Items:
    """The window table of a block of items, and the test of documents against it."""

    def __init__(self, items: list[tuple[object, str]], kept: list[str], plain: int = 0):
        """`kept`: the common words. `plain`: every word of the items is kept, so windows are of so many plain words."""
        import numpy as np

        self.keys = [k for k, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.window = plain or WINDOW
        common = set(kept)
        self.slots = [[w not in common and w not in UNITS for w in words] for words in self.words]
        if plain:
            kept = sorted({w for words in self.words for w in words} - UNITS)
        self.lexicon = {w: i + 3 for i, w in enumerate(kept)} | dict.fromkeys(UNITS, UNIT)
        self.code = np.random.default_rng(7).integers(1, 2**63, len(kept) + 4, dtype=np.uint64)
        self.known: dict[str, bytes] = {}
        ids = [np.array([self.kind(w) for w in words], np.int32) for words in self.words]
        h, owner, place = self.windows_of(ids)
        self.windows = np.bincount(owner, minlength=len(items))
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.table, self.first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        # Items of which half may have too few template windows to gather are looked for by plain words
        # besides, items shorter than a window by windows of their own length.
        few: dict[int, list[tuple[int, str]]] = {}
        for i, n in enumerate(self.windows if not plain else ()):
            if n < max(FEW, GATHERED * len(self.words[i])) and self.words[i]:
                few.setdefault(min(WINDOW, len(self.words[i])), []).append((i, items[i][1]))
        self.plain = [Items(part, [w for w in common if not w.isdigit()], n) for n, part in sorted(few.items())]
        self.fewest = [fewest_slots(slots) for slots in self.slots]

    def kind(self, word: str) -> int:
        return self.lexicon.get(word, NUMBER if word.isdigit() else NAME)

    def ids_of(self, text: str):
        """The template token of each word. Words are looked up by the token between white space that they are in."""
        import numpy as np

        known, kind = self.known, self.kind
        tokens = (_BROKEN.sub("", text) if "-\n" in text or "-\r" in text or "- " in text else text).split()
        for token in set(tokens).difference(known):
            known[token] = array("i", [kind(w) for w in words_of(token)]).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, tokens)), np.int32)

    def windows_of(self, texts: list):
        """(hash, text number, first word) of every template window of texts given as template tokens."""
        import numpy as np

        size = np.array([len(x) for x in texts])
        ends = np.cumsum(size)
        ids = np.concatenate(texts) if len(texts) else np.zeros(0, np.int32)
        begins = ends - size
        first = np.zeros(len(ids) + 1, bool)
        first[begins] = True
        kept = np.flatnonzero((ids != NAME) | first[:-1] | (np.concatenate([[1], ids[:-1]]) != NAME)) if len(ids) else np.zeros(0, np.int64)
        n = len(kept) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = self.code[ids[kept]]
        h = np.zeros(n, np.uint64)
        for k in range(self.window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (c[k : k + n] ^ (c[k : k + n] >> np.uint64(29)))
        text = np.searchsorted(ends, kept, side="right")
        whole = np.flatnonzero(text[:n] == text[self.window - 1 :])
        return h[whole], text[whole], kept[whole] - begins[text[whole]]

    def present(self, i: int, words: set[str]) -> float:
        """Item i's slot fillers among given words, as part of the fewest that a held half of it has; 1 if it may have none."""
        fillers = [w for w, slot in zip(self.words[i], self.slots[i]) if slot]
        return sum(w in words for w in fillers) / self.fewest[i] if self.fewest[i] else 1.0

    def held(self, i: int, words: list[str]) -> tuple[float, float]:
        """The parts of item i's words, and of the slot fillers from the first to the last held word, that a passage holds, in blocks and in order.

        Without a slot there nothing speaks against a copy.
        """
        blocks = [m for m in SequenceMatcher(None, self.words[i], words, autojunk=False).get_matching_blocks() if m.size >= min(BLOCK, len(self.words[i]))]
        slots = self.slots[i]
        inside = sum(sum(slots[m.a : m.a + m.size]) for m in blocks)
        around = sum(slots[blocks[0].a : blocks[-1].a + blocks[-1].size]) if blocks else 0
        return sum(m.size for m in blocks) / len(slots), inside / around if around else 1.0

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item, first word, end) of the passages where enough of an item's windows gather."""
        import numpy as np

        if len(self.known) > REMEMBERED:
            self.known.clear()
        h, text, at = self.windows_of([self.ids_of(t) for t in texts])
        if not len(h) or not len(self.table):
            return []
        where = np.searchsorted(self.table, h)
        where[where == len(self.table)] = 0
        hit = np.flatnonzero(self.table[where] == h)
        w = where[hit]
        n = self.n[w]
        entry = np.repeat(self.first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.repeat(text[hit], n) * len(self.keys) + self.owner[entry]
        place, start = self.place[entry], np.repeat(at[hit], n) - self.place[entry]
        order = np.lexsort((start, pair))
        pair, place, start = pair[order], place[order], start[order]
        groups, first, count = np.unique(pair, return_index=True, return_counts=True)
        least = np.maximum(1, GATHERED * self.windows[groups % len(self.keys)])
        out = []
        for g in np.flatnonzero(count >= least):
            t, i = divmod(int(groups[g]), len(self.keys))
            size, s, p = len(self.words[i]), start[first[g] : first[g] + count[g]], place[first[g] : first[g] + count[g]]
            # Windows of one copy begin at nearly the same distance from their place in the item.
            slack = size // 2 + 10
            reach = np.searchsorted(s, s + slack, side="right") - np.arange(len(s))
            # The densest place first, then all others, in steps that hold every copy whole.
            places, n = [int(reach.argmax())], 0
            while n < len(s):
                places.append(n)
                n = int(np.searchsorted(s, s[n] + slack // 2, side="right"))
            for n in dict.fromkeys(places):
                if reach[n] >= least[g] and len(set(p[n : n + reach[n]].tolist())) >= least[g]:
                    out.append((t, i, max(0, int(s[n]) - 5), int(s[n]) + size + slack + 10))
        return out

    def passages(self, texts: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        """(text number, item, words) of the passages to look at."""
        last, words = -1, []
        for t, i, begin, end in self.candidates(texts):
            if t != last:
                last, words = t, words_of(texts[t])
            yield t, i, words[begin:end]

    def leaked(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text number, item) of every text that holds an item."""
        out = {(t, part.keys[i]): None for part in self.plain for t, i in part.leaked(texts)}
        for t, i, passage in self.passages(texts):
            # Fillers that are nowhere in the passage can't be held: most passages that share a template only end here.
            if (t, i) in out or self.present(i, set(passage)) < SLOTS:
                continue
            part, slots = self.held(i, passage)
            if part >= HELD and slots >= SLOTS:
                out[t, i] = None
        return list(out)

    def agreed(self, i: int, words: list[str]) -> tuple[float, int, int, float]:
        """How a passage fills item i's template: the part of the template it has, slots, slots with the item's own filler, and the part of the slots that agree.

        Slots agree if each filler of the item stands for one filler of the passage and the other way round.
        """
        kinds = [self.kind(w) for w in self.words[i]]
        blocks = [m for m in SequenceMatcher(None, kinds, [self.kind(w) for w in words], autojunk=False).get_matching_blocks() if m.size >= min(BLOCK, len(kinds))]
        pairs = [(self.words[i][m.a + n], words[m.b + n]) for m in blocks for n in range(m.size) if self.slots[i][m.a + n]]
        both = Counter(pairs)
        best: dict[tuple[int, str], int] = {}
        for (a, b), n in both.items():
            best[0, a], best[1, b] = max(best.get((0, a), 0), n), max(best.get((1, b), 0), n)
        agree = sum(n for (a, b), n in both.items() if n == best[0, a] == best[1, b])
        return sum(m.size for m in blocks) / len(kinds), len(pairs), sum(a == b for a, b in pairs), agree / len(pairs) if pairs else 0.0

    def refilled(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item, slots, slots with the item's own filler) of every text that holds an item's template with other fillers."""
        copies, out = set(self.leaked(texts)), {}
        for t, i, passage in self.passages(texts):
            if (t, i) in copies:
                continue
            part, n, own, agree = self.agreed(i, passage)
            if part >= ALIKE and n and own < n and agree >= AGREED:
                out[t, i] = max(out.get((t, i), (0, 0)), (n, own))
        return [(*k, *v) for k, v in out.items()]


_TABLES: dict[str, Items] = {}


def worker_table(name: str, items: list[tuple[object, str]], kept: list[str]) -> Items:
    """The window table of a block, made once in each worker; a worker keeps two."""
    if name not in _TABLES:
        while len(_TABLES) > 1:
            _TABLES.pop(next(iter(_TABLES)))
        _TABLES[name] = Items(items, kept)
    return _TABLES[name]


def common_words(documents: DataFrame, text: str = "text") -> list[str]:
    """The words, apart from numbers and units, that COMMON of all documents have, and two at least: a list of bounded length."""
    import pyarrow as pa

    filled = documents.select(text).filter(F.col(text) != "")
    least = max(2, ceil(filled.count() * COMMON))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known: dict[str, tuple[int, ...]] = {}
        numbers: dict[str, int] = {}
        counts = np.zeros(1 << 16, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.string()), pa.array(counts[: len(numbers)])], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens = set((_BROKEN.sub("", t) if "-" in t else t).split())
                for token in tokens.difference(known):
                    known[token] = tuple(numbers.setdefault(w, len(numbers)) for w in words_of(token) if not w.isdigit())
                while len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                counts[list({w for token in tokens for w in known[token]})] += 1
            if len(known) > REMEMBERED:
                yield out()
                known.clear()
                numbers.clear()
                counts[:] = 0
        yield out()

    counts = filled.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r.word for r in counts.filter(F.col("n") >= least).select("word").collect() if r.word not in UNITS)


def fewest_slots(slots: list[bool]) -> int:
    """The least number of slots in any passage of as many of an item's words as must be held."""
    size = ceil(HELD * len(slots))
    sums = [0, *accumulate(slots)]
    return min((sums[n + size] - sums[n] for n in range(len(slots) - size + 1)), default=0)


def blocks_of(items: Iterable[tuple[object, str]]) -> Iterator[list[tuple[object, str]]]:
    block, n = [], 0
    for key, text in items:
        size = len(text.split())
        if block and n + size > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((key, text))
        n += size
    if block:
        yield block


def scanned(documents: DataFrame, items: DataFrame, found: str, columns: list[T.StructField], key: str, item_key: str, text: str) -> DataFrame:
    """(key, item_key, *columns): what the method `found` of Items says of all documents and items."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType), *columns])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    kept = spark.sparkContext.broadcast(common_words(documents, text))
    rows = ((r[0], r[1]) for r in items.filter(f"{text} != ''").select(item_key, text).toLocalIterator())
    parts = []
    for block in blocks_of(rows):
        shared, name = spark.sparkContext.broadcast(block), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            known = worker_table(name, shared.value, kept.value)
            for batch in batches:
                for n in range(0, batch.num_rows, SLICE):
                    part = batch.slice(n, SLICE)
                    hits = getattr(known, found)([t or "" for t in part.column(1).to_pylist()])
                    at = part.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    rest = [pa.array([h[c] for h in hits], kinds[c]) for c in range(2, len(schema))]
                    yield pa.RecordBatch.from_arrays([at, pa.array([known.keys[h[1]] for h in hits], kinds[1]), *rest], schema.names)

        parts.append(documents.select(key, text).mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item_key): the documents that hold about half or more of an item, in order and nearly verbatim.

    Null and empty texts, and those without a word, hold nothing and are nowhere held; an item shorter than
    a window is held where all its words stand together. Repeated keys come once for each row that holds the item.
    """
    return scanned(documents, items, "leaked", [], key, item_key, text)


def refilled(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item_key, n_slots, n_own): the documents that hold an item re-parameterised, and how many of the slots have the item's own filler.

    They hold ALIKE of the item's template, no copy of it, and AGREED of the fillers stand each for one
    other filler throughout. Items without a slot can't be re-parameterised. Nulls as in leaks().
    """
    columns = [T.StructField("n_slots", T.LongType()), T.StructField("n_own", T.LongType())]
    return scanned(documents, items, "refilled", columns, key, item_key, text)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def p7_refilled(spark: SparkSession, directory: str) -> DataFrame:
    return refilled(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def p7_items(spark: SparkSession, directory: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p7_found(spark, directory).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p7_refilled": p7_refilled}
ORACLE_SQL: dict[str, str] = {}
