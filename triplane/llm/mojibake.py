"""Text that was decoded with the wrong character encoding: find it, and restore what can be restored.

Every distinct clean word of the corpus is garbled under all chains of a right and a wrong encoding,
and the documents' words are hash-joined with that table: a word that is a garbled form of a clearly
more frequent word is garbled, and that word is its original. How frequent a word is counts in distinct texts. Words whose original is nowhere in the
corpus (most invented names) are decoded back by the same chains: they count if every run of foreign
characters in them comes out as well-formed UTF-8 of ordinary characters or as plain Japanese, and from
single-byte chains if several words of the text come out well-formed by one chain.

A garbled sequence in quotation marks that stands for one character, or of which the text has the sound form
too, is quoted in order to talk about it and counts for nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import key128, table, use_checkpoints

#: Single-byte encodings that text is wrongly decoded with, in order of preference for repair.
WRONG = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866"]
#: Right and wrong encoding of single-byte chains.
SINGLE_BYTE = [("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "mac_roman"), ("cp1251", "cp866"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252")]
#: Encodings of which two characters at a time are taken for bytes of another one.
DOUBLE_BYTE = ["shift_jis", "euc_jp"]
#: Wrong encodings of the first and the second step of twice garbled text.
TWICE = [(a, b) for a in ("cp1252", "cp437", "mac_roman") for b in ("cp1252", "cp437", "mac_roman")]
#: A well-formed word is a garbled form only of a word in this many times as many documents.
RATIO = 4
#: Forms of one chain in one text that are garbled whatever their frequency.
SEVERAL = 3
#: The ways a garbled word is told, the surest first.
HOW = ("joined", "decoded", "together")
#: Most characters of a quoted sequence that stands for one character.
QUOTED = 4
LOST = "�"
OPENING, CLOSING = "\"'`“”‘’«»„‹›", "\"'`“”‘’«»‹›"
_ASCII_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_EDGES = _ASCII_EDGES + "“”‘’«»„‹›—–…¿¡、。「」"
_ACCENTS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÿœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ’"
_AFTER = ".,;:!?)]"
_SPACE = "\t\n\r\x0b\x0c"
_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(None)
def byte_characters(encoding: str) -> str:
    """The 256 characters of a single-byte encoding; a byte without one stands for the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(None)
def _to_wrong(encoding: str) -> dict[int, str]:
    return dict(enumerate(byte_characters(encoding)))


@lru_cache(None)
def _to_byte(encoding: str) -> dict[int, int]:
    """Character to byte; for the Windows encodings also the control characters that a stricter decoder leaves."""
    known = {ord(c): b for b, c in enumerate(byte_characters(encoding))}
    return ({b: b for b in range(128, 160)} if encoding.startswith("cp125") else {}) | known


def misread(raw: bytes, wrong: str) -> str:
    return raw.decode("latin-1").translate(_to_wrong(wrong))


def garbled_forms(word: str) -> dict[str, int]:
    """All forms of a clean word under the chains, without the word itself; each with the chains that give it, a bit for each."""
    utf8, forms, chain = word.encode("utf-8", "replace"), defaultdict(int), 0
    for wrong in [*WRONG, "latin-1"]:
        form = misread(utf8, wrong)
        # Garbled text that was put in lower or upper case afterwards can't be decoded back.
        for cased in {form, form.lower(), form.upper()}:
            forms[cased] |= 1 << chain
        chain += 1
    for first, second in TWICE:
        forms[misread(misread(utf8, first).encode("utf-8"), second)] |= 1 << chain
        chain += 1
    for right, wrong in [*SINGLE_BYTE, *((right, "cp1252") for right in DOUBLE_BYTE)]:
        try:
            forms[misread(word.encode(right), wrong)] |= 1 << chain
        except UnicodeEncodeError:
            pass
        chain += 1
    for right in ("cp1252", "cp1251"):
        try:
            forms[word.encode(right).decode("utf-8", "replace")] |= 1 << chain
        except UnicodeEncodeError:
            pass
        chain += 1
    forms.pop(word, None)
    return forms


def well_formed(word: str) -> bool:
    """Letters of one script in ordinary case, perhaps with marks and punctuation of text; what a clean word looks like."""
    script = ""
    for c in word:
        if c.isascii():
            if c.isalpha():
                if script not in ("", "LATIN", "CJK"):
                    return False
                script = script or "LATIN"
            continue
        kind = unicodedata.category(c)
        if kind in ("Cc", "Cn", "Co", "Cs", "So", "Sm", "Sk", "Sc", "No") or c == LOST:
            return False
        if kind[0] == "L":
            of = unicodedata.name(c, "?").split(" ", 1)[0]
            of = "CJK" if of in ("HIRAGANA", "KATAKANA", "CJK", "KATAKANA-HIRAGANA") else of
            if script not in ("", of) and "CJK" not in (script, of):
                return False
            script = of
    parts = (p for p in re.split(r"[\W\d_]+", word) if p)
    return all(p.lower() == p.upper() or p.islower() or p.isupper() or p[0].isupper() and p[1:].islower() for p in parts)


def speakable(word: str) -> bool:
    """Whether a Cyrillic word has the vowels of one; letters of a word read in another Cyrillic encoding mostly don't."""
    return len(word) > 3 and 0.2 <= sum(c in "аеёиоуыэюяіїє" for c in word.lower()) / len(word) <= 0.7


def ordinary(c: str) -> bool:
    """Whether a character is one that texts are made of, as against one that bytes give by chance."""
    n = ord(c)
    if n < 0xA0:
        return True
    return (
        n <= 0x17F or 0x370 <= n < 0x530 or 0x2010 <= n <= 0x2044 or 0x20A0 <= n < 0x20C0 or 0x2190 <= n < 0x2600
        or 0x3000 <= n < 0xA000 or 0xAC00 <= n < 0xD7B0 or 0xFF00 <= n < 0xFFF0 or n >= 0x1F300 or n in (0x2116, 0x2122, 0xFEFF, 0x200B, 0x200D)
    )


def reread(run: str, inside: bool = False) -> str | None:
    """A run of foreign characters decoded back by one chain, again and again while that works; None if it is no garbled UTF-8.

    A single character comes out of a Cyrillic encoding only `inside` a word of Latin letters: by itself
    such a run can be a word ("Её").
    """
    for wrong in WRONG:
        to_byte = _to_byte(wrong)
        try:
            raw = bytes([to_byte[ord(c)] for c in run])
            text = raw.decode("utf-8")
        except (KeyError, ValueError):
            continue
        if text == run or not all(map(ordinary, text)) or any(0x80 <= ord(c) < 0xA0 for c in text) and not reread(text):
            continue
        if len(text) < 2 and not inside and wrong in ("cp1251", "koi8_r", "cp866"):
            continue
        return reread(text) or text
    return None


def repaired(word: str) -> str | None:
    """The word with all its foreign runs decoded back; None unless that works for one of them at least."""
    found = False

    def back(m: re.Match) -> str:
        nonlocal found
        beside = word[m.start() - 1 : m.start()] + word[m.end() : m.end() + 1]
        text = reread(m[0], any(map(str.isalpha, beside)))
        found |= text is not None
        return m[0] if text is None else text

    out = _RUN.sub(back, word)
    return out if found else None


_JAPANESE = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_NOT_JAPANESE = re.compile(r"[^\x20-\x7e\u3000-\u30ff\u4e00-\u9fff\uff01-\uff5e]")


def double_byte(word: str) -> tuple[str, bool] | None:
    """A word decoded back to plain Japanese, and whether all of it was; None if it isn't that.

    The last byte may be half a character, as ASCII punctuation at the end of a word is cut off. Kanji
    alone count only for EUC-JP, which leaves no ASCII between, and if they are of the first level.
    """
    to_byte = _to_byte("cp1252")
    try:
        raw = bytes([to_byte[ord(c)] for c in word])
    except KeyError:
        return None
    for right in DOUBLE_BYTE:
        for cut in (raw, raw[:-1]):
            try:
                text = cut.decode(right)
            except UnicodeDecodeError:
                continue
            letters = _JAPANESE.findall(text)
            if len(letters) < 2 or _NOT_JAPANESE.search(text):
                continue
            common = right == "euc_jp" and len(letters) > 2 and all(_KANA.match(c) or c.encode(right) < b"\xd0" for c in letters)
            if common or len(_KANA.findall(text)) >= 2:
                return text, cut is raw
    return None


def single_byte(word: str) -> list[tuple[str, int]]:
    """What a word of a single-byte chain may have been, each with the chain's bit; only words that can't be clean, or have no ASCII letter."""
    letters = sum(map(str.isalpha, word))
    if letters < 3 or well_formed(word) and any(c.isascii() and c.isalpha() for c in word):
        return []
    out = []
    for n, (right, wrong) in enumerate(SINGLE_BYTE, len(WRONG) + 1 + len(TWICE)):
        to_byte = _to_byte(wrong)
        try:
            text = bytes([to_byte[ord(c)] for c in word]).decode(right)
        except (KeyError, UnicodeDecodeError):
            continue
        core = text.strip(_EDGES)
        if text == word or core.isascii() or not well_formed(core) or not core.replace("-", "").replace("’", "").isalpha():
            continue
        cyrillic = all(0x400 <= ord(c) < 0x530 for c in core if c.isalpha())
        if speakable(core) if cyrillic else all(c.isascii() or c in _ACCENTS for c in core):
            out.append((text, 1 << n))
    return out


def decoded_words(counts: DataFrame) -> DataFrame:
    """(word, df, original, original_df, chains, shaped, better): words decoded back by single-byte chains, as if met with an original of no text.

    Latin letters all of which are accented are no clean word.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, df, o, 0, chain, well_formed(w) and w[0] >= "\u0250", False) for w, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for o, chain in single_byte(w)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "df", "original", "original_df", "chains", "shaped", "better"])

    return counts.select("word", "df").mapInArrow(run, "word string, df bigint, original string, original_df bigint, chains bigint, shaped boolean, better boolean")


def in_quotes(token: str) -> str | None:
    """What a token has in quotation marks, if it is in them, apart from what follows them."""
    t = token.rstrip(_AFTER).lstrip("([")
    return t[1:-1] if len(t) > 2 and t[0] in OPENING and t[-1] in CLOSING else None


def quoted(token: str, text: str) -> bool:
    """Whether a token of a text is quoted in order to talk about it: at most QUOTED foreign characters, or a word whose sound form is in the text too."""
    inside = in_quotes(token)
    if inside is None:
        return False
    if len(inside) <= QUOTED and not any(c.isascii() and c.isalnum() for c in inside):
        return True
    original = repaired(inside)
    return original is not None and original in text


def cores(token: str) -> list[str]:
    """The words that a token with foreign characters may be: without the ASCII punctuation around it, and without quotation marks at its ends.

    In some encodings a mark can be part of a garbled word, so the word with it counts as well.
    """
    inside = in_quotes(token)
    core = (token if inside is None else inside).strip(_ASCII_EDGES)
    if core and (core[0] in OPENING or core[-1] in CLOSING):
        bare = core.lstrip(OPENING).rstrip(CLOSING)
        return [w for w in (core, bare) if not w.isascii()]
    return [] if core.isascii() else [core]


def foreign_words(text: str) -> set[str]:
    """The words of a text with foreign characters, without the ASCII punctuation around them and without quoted sequences."""
    if text.isascii():
        return set()
    for c in _SPACE:
        text = text.replace(c, " ")
    tokens = {t for t in text.split(" ") if not t.isascii()}
    return {w for t in tokens if not quoted(t, text) for w in cores(t)}


def text_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """(t1, t2, words): each distinct text with foreign characters once, by its hash, with those words separated by spaces."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(foreign_words(t))) if t else "" for t in batch.column(2).to_pylist()]
            at = pa.array([n for n, w in enumerate(words) if w], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(filter(None, words), pa.string())], ["t1", "t2", "words"])

    return hashed(documents, text).select("t1", "t2", text).mapInArrow(run, "t1 bigint, t2 bigint, words string").distinct()


def hashed(documents: DataFrame, text: str = "text") -> DataFrame:
    first, second = key128(text)
    return documents.filter(F.col(text).isNotNull()).withColumns({"t1": first, "t2": second})


def form_table(counts: DataFrame) -> DataFrame:
    """(form, original, original_df, chains): the garbled forms of every distinct clean word."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, originals, dfs, chains = [], [], [], []
            for word, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clean = word.strip(_EDGES)
                if clean and not clean.isascii() and well_formed(clean):
                    new = garbled_forms(clean)
                    forms += new
                    chains += new.values()
                    originals += [clean] * len(new)
                    dfs += [df] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(originals, pa.string()), pa.array(dfs, pa.int64()), pa.array(chains, pa.int64())], ["form", "original", "original_df", "chains"])

    return counts.mapInArrow(run, "form string, original string, original_df bigint, chains bigint")


def repaired_words(counts: DataFrame) -> DataFrame:
    """(word, original): words that chains decode back, whose original need not be in the corpus; a null original can't be restored."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for w in batch.column(0).to_pylist():
                original = None if LOST in w else repaired(w)
                if LOST in w or original is not None:
                    kept.append((w, original))
                elif (back := double_byte(w)) is not None:
                    kept.append((w, back[0] if back[1] else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.string())], ["word", "original"])

    return counts.select("word").mapInArrow(run, "word string, original string")


def garbled_words(texts: DataFrame) -> DataFrame:
    """(t1, t2, word, original, how): the garbled words of each distinct text, with their originals where these are known.

    how: "joined" for forms of clean words of the corpus, "decoded" for words that one chain decodes back,
    "together" for words of which several in a text come out by one chain.
    Of several originals the most frequent counts, on a tie the first in order. df counts distinct texts,
    so copies of a garbled one don't make its words frequent. Where near copies do, SEVERAL forms of one
    chain in one text are garbled whatever their df, if one of them at least can't be a clean word
    and the others have no ASCII letters.
    Word counts and met forms are checkpointed: several steps read them.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Words and forms meet by hash: what only shares the hash goes.
            met = [w in garbled_forms(o) for w, o in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            batch = batch.filter(pa.array(met, pa.bool_()))
            words, originals = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            shaped = pa.array([well_formed(w) for w in words], pa.bool_())
            better = pa.array([speakable(o) and not speakable(w) and len(w) > 3 for w, o in zip(words, originals)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, shaped, better], ["word", "df", "original", "original_df", "chains", "shaped", "better"])

    words = texts.select("t1", "t2", F.explode(F.split("words", " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df")).checkpoint()
    # Forms are many and long: their hashes travel instead. A single letter is a form of other single letters
    # by chance: clean texts hold such letters too.
    forms = form_table(counts).select(F.xxhash64("form").alias("h"), "original", "original_df", "chains")
    met = counts.filter("length(word) > 1").withColumn("h", F.xxhash64("word")).join(forms, "h").select("word", "df", "original", "original_df", "chains")
    met = met.mapInArrow(run, "word string, df bigint, original string, original_df bigint, chains bigint, shaped boolean, better boolean").checkpoint()
    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, originals = [], [], []
            for n, forms in enumerate(batch.column(2).to_pylist()):
                of_chain = defaultdict(list)
                for f in forms:
                    for chain in range(f["chains"].bit_length()):
                        if f["chains"] >> chain & 1:
                            of_chain[chain].append(f)
                best: dict[str, tuple[int, str]] = {}
                for fs in of_chain.values():
                    if len({f["word"] for f in fs}) >= SEVERAL and not all(f["shaped"] for f in fs):
                        for f in fs:
                            best[f["word"]] = min(best.get(f["word"], (1, "")), (-f["original_df"], f["original"]))
                at += [n] * len(best)
                out += best
                originals += [o for _, o in best.values()]
            k = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(k), batch.column(1).take(k), pa.array(out, pa.string()), pa.array(originals, pa.string())], ["t1", "t2", "word", "original"])

    # A clean word with one foreign letter can be a form of a garbled one: "Don’t" of "Donít".
    directed = met.filter("length(word) > 2 AND NOT (shaped AND word RLIKE '[A-Za-z]')").select("word", "original", "original_df", "chains", "shaped")
    directed = directed.unionByName(decoded_words(counts).select(directed.columns))
    forms = words.join(directed, "word").groupBy("t1", "t2").agg(F.collect_list(F.struct("word", "original", "original_df", "chains", "shaped")).alias("forms"), F.bool_and("shaped").alias("sound"))
    forms = forms.filter(~F.col("sound") & (F.size("forms") >= SEVERAL)).drop("sound")
    together = forms.mapInArrow(several, "t1 bigint, t2 bigint, word string, original string").withColumn("rank", F.lit(2))
    # What is garbled in a text by itself is no original, however many texts have it.
    wrong = together.groupBy("word").agg(F.min("original").alias("right")).checkpoint()
    joined = met.filter(f"original_df >= df AND (NOT shaped OR better OR original_df >= {RATIO} * df)")
    joined = joined.join(wrong.select(F.col("word").alias("original")), "original", "left_anti")
    best = joined.groupBy("word").agg(F.min(F.struct((-F.col("original_df")).alias("rank"), "original")).alias("best")).select("word", "best.original", F.lit(1).alias("rank"))
    either = best.unionByName(repaired_words(counts).withColumn("rank", F.lit(2)))
    known = either.groupBy("word").agg(F.min(F.when(F.col("original").isNotNull(), F.struct("rank", "original"))).alias("best"), F.min("rank").alias("how")).select("word", F.col("best.original").alias("original"), "how")
    told = words.join(known, "word").select("t1", "t2", "word", "original", F.lit(1).alias("rank"), "how")
    best = F.min(F.when(F.col("original").isNotNull(), F.struct("rank", "original")))
    both = told.unionByName(together.withColumn("how", F.lit(3))).groupBy("t1", "t2", "word").agg(best.alias("best"), F.min("how").alias("how")).select("t1", "t2", "word", F.col("best.original").alias("original"), "how")
    both = both.join(wrong.select(F.col("word").alias("original"), "right"), "original", "left")
    return both.select("t1", "t2", "word", F.coalesce("right", "original").alias("original"), F.element_at(F.array(*map(F.lit, HOW)), F.col("how")).alias("how"))


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): the documents some of whose text is garbled. Null and empty texts are none; repeated keys come once."""
    use_checkpoints(documents.sparkSession)
    found = garbled_words(text_words(documents, text).checkpoint()).select("t1", "t2").distinct()
    return hashed(documents, text).select(key, "t1", "t2").join(found, ["t1", "t2"], "left_semi").select(key).distinct()


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_restored, n_lost): the garbled documents with the originals put in, whole texts.

    n_lost counts distinct garbled words without a known original; they stay as they are.
    """
    import pyarrow as pa

    use_checkpoints(documents.sparkSession)
    found = garbled_words(text_words(documents, text).checkpoint())
    words = found.groupBy("t1", "t2").agg(F.collect_list(F.struct("word", "original")).alias("words"))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_restored, n_lost = [], [], []
            for t, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = {p["word"]: p["original"] for p in pairs if p["original"] is not None}

                def put(m: re.Match, known=known, t=t) -> str:
                    core = next((w for w in cores(m[0]) if w in known), None)
                    return m[0] if core is None or quoted(m[0], t) else m[0].replace(core, known[core])

                texts.append(re.sub(r"[^ \t\n\r\x0b\x0c]+", put, t))
                n_restored.append(len(known))
                n_lost.append(len(pairs) - len(known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_restored, pa.int32()), pa.array(n_lost, pa.int32())], [key, "text", "n_restored", "n_lost"])

    return hashed(documents, text).select(key, text, "t1", "t2").join(words, ["t1", "t2"]).select(key, text, "words").mapInArrow(run, f"{key} {kind}, text string, n_restored int, n_lost int")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return garbled(table(spark, directory, "documents"))


def p8_how(spark: SparkSession, directory: str) -> DataFrame:
    """(how, n_texts, n_words): how the garbled words were told, of each distinct text the surest way: joined, then decoded, then together."""
    documents = table(spark, directory, "documents")
    use_checkpoints(spark)
    of_text = garbled_words(text_words(documents).checkpoint()).groupBy("t1", "t2").agg(F.min(F.array_position(F.array(*map(F.lit, HOW)), F.col("how"))).alias("at"), F.count("*").alias("n"))
    return of_text.groupBy("at").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_words")).select(F.element_at(F.array(*map(F.lit, HOW)), F.col("at").cast("int")).alias("how"), "n_texts", "n_words")


def p8_restored(spark: SparkSession, directory: str) -> DataFrame:
    return restored(table(spark, directory, "documents"))


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored, "p8_how": p8_how}
ORACLE_SQL: dict[str, str] = {}
