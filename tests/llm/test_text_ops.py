"""The text operators against brute force and exact round trips, with nulls, empty, very long and repeated texts."""

import itertools
import random
import re
import unicodedata
from pathlib import Path

import pytest

from triplane.llm import canonical, canonical_values, crosssplit, formdupes, leakage, lookalikes, mojibake, tokens

TOKENIZERS = Path(tokens.TOKENIZERS)
Q = "SELECT DISTINCT ?x WHERE { ?x wdt:P31 wd:Q1 . ?x wdt:P2 ?v . FILTER(?v > 2.5) . }"


# Records that differ in form


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Who is  X?", "who is (X)", True), ("over 2.5 m", "over 25 m", False), ("over -5", "over 5", False), ("in 1904, who", "IN 1904 WHO!", True), ("1 2", "12", False), ("a > b", "a < b", False), ("5,000", "5000", True), ("é", "e", False),
    ],
)
def test_utterance_form(a, b, same):
    assert (canonical.utterance_form(a) == canonical.utterance_form(b)) is same


@pytest.mark.parametrize(
    ("b", "same"),
    [
        ("select distinct ?x where{\n?x wdt:p2 ?v.\t?x wdt:p31 wd:q1. filter(?v > 2.5)}", True), (Q.replace("2.5", "25"), False), (Q.replace(">", "<"), False), (Q.replace("?x wdt:P2 ?v", "?v wdt:P2 ?x"), False), (Q.replace("> 2.5", "> -2.5"), False), (Q.replace("?v", "?w"), False),
    ],
)
def test_query_form(b, same):
    assert (canonical.query_form(Q) == canonical.query_form(b)) is same


def test_query_form_prefixes_and_iris():
    a = "PREFIX a: <http://k.e/1/> PREFIX b: <http://k.e/2/> ASK WHERE { <http://k.e/entity/Q1> a:x b:y . b:z a:u b:w . }"
    b = "prefix b: <http://k.e/2/>\nprefix a: <http://k.e/1/>ask where{ b:z a:u b:w.<http://k.e/entity/Q1> a:x b:y }"
    assert canonical.query_form(a) == canonical.query_form(b)
    nested = "ASK { { ?a ?b ?c . ?d ?e ?f } UNION { ?g ?h ?i } }"
    assert canonical.query_form(nested) != canonical.query_form(nested.replace("?a ?b ?c . ?d ?e ?f", "?d ?e ?f . ?a ?b ?c"))


def test_query_meaning():
    full = "PREFIX wdt: <http://kg.example/prop/direct/> SELECT ?uri WHERE { ?uri wdt:P31 <http://kg.example/entity/Q1> } LIMIT 1000"
    assert canonical.query_meaning(full) == canonical.query_meaning("SELECT DISTINCT ?x WHERE { ?x wdt:P31 wd:Q1 . }")
    assert canonical.query_meaning(full) != canonical.query_meaning("SELECT DISTINCT ?x WHERE { wd:Q1 wdt:P31 ?x . }")


def examples(spark, rows):
    extra = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(extra, "row_id bigint, utterance string, sparql string, split string, source string, q1 bigint, keep_id string")


def test_copies(spark):
    rnd, rows = random.Random(1), []
    for i in range(400):
        u = rnd.choice(["who is it", "what is 5", "what is -5", None, "", "???", "x" * 50_000]) if i % 3 else "hot question"
        s = rnd.choice([Q, Q.lower(), "ASK { wd:Q1 wdt:P2 wd:Q3 }", "ask{wd:q1  wdt:p2 wd:q3.}", "ASK { wd:Q3 wdt:P2 wd:Q1 }", None, ""])
        rows.append((i, u if u is None or rnd.random() < 0.5 else f" {u.upper()}! ", s, "train"))
    groups = {}
    for i, u, s, _ in rows:
        if u and s and canonical.utterance_form(u):
            groups.setdefault((canonical.utterance_form(u), canonical.query_form(s)), []).append(i)
    want = {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    df = examples(spark, rows)
    assert {tuple(r) for r in formdupes.copies(df).collect()} == want
    assert {(r.keep_id, r.n_copies) for r in formdupes.collapsed(df).collect()} == {(min(v), len(v)) for v in groups.values()}
    assert formdupes.copies(df.limit(0)).collect() == []


# Overlaps across splits


def test_overlaps_against_all_pairs(spark):
    rnd, rows = random.Random(2), []
    words = "what is the capital owner of lake zanebo river mizoth in which year please now".split()
    base = [" ".join(rnd.choices(words, k=9)) for _ in range(12)]
    for i in range(300):
        u = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            u[rnd.randrange(len(u))] = rnd.choice("abcdefg ")
        u = rnd.choice(["".join(u), "".join(u), None, "", "a" * 30_000]) if i % 4 else base[0]
        rows.append((i, u, rnd.choice([Q, Q.replace("?x", "?uri"), "ASK { wd:Q1 wdt:P2 wd:Q3 }", None]), rnd.choice(["train", "dev", "test", None])))
    grams = lambda u: {x[i : i + 3] for x in [canonical.utterance_form(u)] for i in range(max(1, len(x) - 2))}
    want = set()
    for (i, u, s, a), (j, w, t, b) in itertools.product(rows, rows):
        if a == "train" and b in ("dev", "test") and u and w and s and t and canonical.query_meaning(s) == canonical.query_meaning(t):
            x, y = grams(u), grams(w)
            if len(x & y) >= crosssplit.SIMILARITY * len(x | y) - 1e-9:
                want.add((min(i, j), max(i, j)))
    got = [tuple(r) for r in crosssplit.overlaps(examples(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert crosssplit.overlaps(examples(spark, rows).limit(0)).collect() == []


# Text that looks the same


def test_looks():
    reader = lookalikes.Reader(lookalikes.pair_counts({"capital": 5, "мир": 3, "of": 9}))
    form = reader.text
    assert form("саpit​al") == form("ｃａｐｉｔａｌ") == "capital"
    assert form("café") == form("café") == "café"
    assert form("ﬁne\xa0day") == "fine day" and form("a‑b") == "a-b"
    for differs in ("x²", "x2"), ("№5", "No5"), ("10½", "101/2"), ("Ab", "ab"), ("e", "é"), ("a b", "a  b"), ("ø", "o"):
        assert form(differs[0]) != form(differs[1])
    assert form("мир") == form("миp") == "мир" and form("") == ""
    assert len(form("с" * 10_000)) == 10_000


def test_same_looking_against_all_pairs(spark):
    rnd, rows = random.Random(3), []
    for i in range(200):
        t = rnd.choice(["Lake Corop", "Port Zosi", "Мир", "café", None, "", "z" * 5000])
        if t and rnd.random() < 0.5:
            t = t.replace("o", rnd.choice(["о", "ο", "o"])).replace(" ", rnd.choice([" ", "\xa0"])).replace("é", "é")
        rows.append((rnd.choice(["labels", "examples"]), i, t, "x"))
    df = spark.createDataFrame(rows, "src string, id bigint, text string, form string").select("src", "id", "text")
    got = [tuple(r) for r in lookalikes.same_looking(df).collect()]
    fold = lambda t: unicodedata.normalize("NFC", t.translate({0x43E: "o", 0x3BF: "o", 0xA0: " "}))
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] and b[2] and a[2] != b[2] and fold(a[2]) == fold(b[2])}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert lookalikes.same_looking(df.limit(0)).collect() == []


# Values mapped to entities


def test_one_slip():
    def slow(a, b):
        near = {b} | {b[:i] + b[i + 1 :] for i in range(len(b))} | {b[:i] + b[i + 1] + b[i] + b[i + 2 :] for i in range(len(b) - 1)}
        near |= {b[:i] + c + b[i + 1 :] for i in range(len(b)) for c in set(a)} | {b[:i] + c + b[i:] for i in range(len(b) + 1) for c in set(a)}
        return a in near

    strings = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)]
    assert all(canonical_values.one_slip(a, b) is slow(a, b) for a in strings for b in strings)


def test_mapped(spark):
    entities = spark.createDataFrame([("Q7000001", "Lake Zanebo", "lake"), ("Q7000002", "Zanebo", "city"), ("Q7000003", "The Hodavim Quartet", "band"), ("Q7000004", "Irika Mopidas", "human"), ("Q7000005", "Galazor", "city"), ("Q7000006", "Galazor", "film")], "id string, label string, domain_name string")
    aliases = spark.createDataFrame([("Q7000001", "de", "Zanebosee")], "id string, lang string, alias string")
    cases = [
        ("q 7,000,001", None, None, "Q7000001"), ("Ｑ07000002", "?", None, "Q7000002"), ("<http://kg.example/entity/Q7000003>", "", None, "Q7000003"), (None, "[Q7000004]", None, "Q7000004"), ("Q9999999", "lake zanebo", None, "Q7000001"),
        (None, "LAKE  ZANEBO", "lake", "Q7000001"), (None, "Zanebo, Lake", None, "Q7000001"), (None, "Lake Znaebo (lake)", None, "Q7000001"), (None, "zanebosee", None, "Q7000001"), (None, "The Hodavim 4tet", None, "Q7000003"), (None, "TheHodavimQuartet", None, "Q7000003"),
        (None, "I. Mopidas", None, "Q7000004"), (None, "Galazor", "film", "Q7000006"), (None, "Galazor", None, "Q7000005"), (None, "Zanebo Airport", None, "none"), (None, "Castle Zanebo", None, "none"), (None, "tbd", None, "none"), (None, "???", None, "none"), ("junk", None, None, "none"), (None, "Olona Mopidas", None, "none"), (None, "w" * 20_000, None, "none"),
    ]
    rows = [("m", i, *c[:3]) for i, c in enumerate(cases)] + [("m", 100, None, None, "lake"), ("m", 101, " ", "\t", None)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, typed string, value string, domain string")
    got = {r.row_id: r.id for r in canonical_values.mapped(df, entities, aliases).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    assert canonical_values.mapped(df.limit(0), entities, aliases).collect() == []
    assert {r.id for r in canonical_values.mapped(df.filter("row_id = 5"), entities.limit(0), aliases.limit(0)).collect()} == {"none"}


# Token ids


@pytest.mark.skipif(not TOKENIZERS.exists(), reason="needs the vocabulary files")
def test_encoding_is_the_vocabulary_s_own(spark):
    import tiktoken

    ranks = tokens.read_ranks(str(TOKENIZERS / "byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    letters = "ab Z9 \t\n\r\x0b\x1c\x85\xa0　'sé½²Ж_-中​\x00🙂"
    texts = [None, "", " ", "<|endoftext|>", "<unk> ▁", "word " * 30_000, "x" * 20_000, *("".join(rnd.choices(letters, k=rnd.randint(1, 40))) for _ in range(800))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == []
    encoder = tokens.encoder(str(TOKENIZERS / "byte_bpe_50k.tiktoken"))
    for i, t in enumerate(texts):
        assert got[i] == (own.encode_ordinary(t) if t else [])
        assert encoder.decode(got[i]) == (t or "")
    assert tokens.encode_corpus(df.limit(0)).collect() == []


# Leaked evaluation items

VERBS = "renamed split counted merged exported described".split()
NOUNS = "archive lake harbour registry census novella glacier orchard".split()


def passage(rnd, n=6):
    return " ".join(f"The {rnd.choice(NOUNS)} of {''.join(rnd.choices('bdfgklmnprstvz', k=3))}a{''.join(rnd.choices('bdfklmn', k=3))}o {rnd.choice(VERBS)} {rnd.randint(2, 9999)} rows for the {rnd.choice(NOUNS)} of Q{rnd.randint(1, 10**7)}." for _ in range(n))


def test_leaks(spark):
    rnd = random.Random(5)
    items = [(i, passage(rnd)) for i in range(30)] + [(90, None), (91, ""), (92, "too short")]
    docs, want = [(0, None), (1, ""), (2, "   "), (3, "word " * 50_000)], set()
    for d in range(10, 110):
        i, t = rnd.choice(items[:30])
        w, before, after = t.split(), passage(rnd, 3), passage(rnd, 3)
        kind = d % 5
        if kind == 0:  # whole, in other case and layout
            body = "\n".join(x.upper() for x in w)
        elif kind == 1:  # two thirds, with slips
            w = w[: len(w) * 7 // 10]
            w[len(w) // 2] = "often"
            body = " ".join(w)
        elif kind == 2:  # a scrap
            body = " ".join(w[: len(w) // 5])
        elif kind == 3:  # the same words in another order
            rnd.shuffle(w)
            body = " ".join(w)
        else:  # the same template with other names and numbers
            body = re.sub(r"\b\d+\b", lambda m: str(rnd.randint(2, 9999)), re.sub(r"of [a-z]+|Q\d+", lambda m: "of " + "".join(rnd.choices("bdfgklmn", k=7)), t))
        docs.append((d, f"{before} {body} {after}"))
        if kind < 2:
            want.add((d, i))
    D = spark.createDataFrame([(*x, "y") for x in docs], "doc_id bigint, text string, item_id string")
    B = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == want
    assert leakage.leaks(D.limit(0), B).collect() == [] and leakage.leaks(D, B.limit(0)).collect() == []


def test_blocks_don_t_change_leaks(spark, monkeypatch):
    rnd = random.Random(6)
    items = [(i, passage(rnd)) for i in range(6)]
    D = spark.createDataFrame([(i, passage(rnd, 2) + " " + t) for i, t in items], "doc_id bigint, text string")
    B = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == {(i, i) for i, _ in items}


def test_a_copy_beside_its_own_template(spark):
    rnd = random.Random(8)
    items = [(i, passage(rnd)) for i in range(6)]
    other = lambda t: re.sub(r"\b\d+\b", lambda m: str(rnd.randint(2, 9999)), re.sub(r"of [a-z]+|Q\d+", lambda m: "of " + "".join(rnd.choices("bdfgklmn", k=7)), t))
    docs = []
    for i, t in items:
        w = t.split()
        docs.append((i, " ".join([other(t), "far away " * 100, " ".join(w[: len(w) * 6 // 10]), "far away " * 100, other(t)])))
    D, B = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == {(i, i) for i, _ in items}


def test_items_without_slots_or_template(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("bdfgklmnprstvz", k=4)) + "a" + "".join(rnd.choices("bdfklmn", k=3))
    lone = [" ".join(word() for _ in range(40)) for _ in range(3)]
    repeated = " ".join(word() for _ in range(40))
    a, b = [word() for _ in range(20)], [word() for _ in range(20)]
    items = [*enumerate(lone), (10, repeated), (11, repeated.upper()), (20, " ".join(a + b)), (21, " ".join(a[::-1])), (22, " ".join(b[::-1]))]
    docs = [(i, f"some words before {t} and after") for i, t in items] + [(99, " ".join(word() for _ in range(80)))]
    D, B = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, i) for i, _ in items} | {(10, 11), (11, 10)}
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == want


# Garbled text


@pytest.mark.parametrize("wrong", ["latin-1", *mojibake.WRONG])
def test_repaired(wrong):
    for word in ("Übergröße", "“déjà”", "Привет", "日本語"):
        garbled = mojibake.misread(word.encode(), wrong)
        assert mojibake.repaired(garbled) == word
        assert mojibake.repaired(word) is None
    twice = mojibake.misread(mojibake.misread("naïve—".encode(), "cp1252").encode(), "cp1252")
    assert mojibake.repaired(twice) == "naïve—"


@pytest.mark.parametrize("sound", ["SÃO PAULO", "├── x", "√2 ≈ 1.4", "Â LA CARTE, ÂGE D’OR", "10⁻³", "👩‍💻", "Рёбра", "naïve", "«Âge»", "x² ½"])
def test_sound_words(sound):
    assert all(mojibake.repaired(w) is None for w in mojibake.foreign_words(sound))


def test_garbled_documents(spark):
    clean = ["Die Größe der Straße", "Кто добавил словарь", "une déjà vue", "plain text only"] * 6
    bad = ["Die GrÃ¶ÃŸe", "йРН добавил", mojibake.misread("словарь".encode("koi8_r"), "cp1251") + " x", "d├®j├á vue", "Stra�e here"]
    quoted = ["the sequence 'Ã¼' (should read ü)", 'printed “â€™” for ’', 'if you see "�" here']
    texts = [None, "", *clean, *quoted, "long é " * 20_000, *bad]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")
    want = set(range(len(texts) - len(bad), len(texts)))
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == want
    fixed = {r.doc_id: r.text for r in mojibake.restored(df).collect()}
    first = len(texts) - len(bad)
    assert fixed[first] == "Die Größe" and fixed[first + 1] == "Кто добавил" and fixed[first + 2] == "словарь x" and fixed[first + 3] == "déjà vue"
    assert mojibake.garbled(df.limit(0)).collect() == []


def test_copies_of_garbled_documents(spark):
    words = "Добавил словарь озера города реки каталога"
    sound = [f"{words} {i}" for i in range(8)] + [f"{words.upper()} {i}" for i in range(3)]
    other = [mojibake.misread(words.encode("cp1251"), wrong) for wrong in ("cp1252", "koi8_r", "mac_roman", "cp866")]
    french = "une déjà vue, élève forêt très âgée"
    other += [mojibake.misread("déjà élève forêt".encode("cp1252"), wrong) for wrong in ("cp437", "cp850")]
    texts = sound + [f"{french} {i}" for i in range(3)] + [x for x in other for _ in range(30)]
    # Near copies: each text is another one.
    texts += [f"{other[1]} {i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == set(range(len(sound) + 3, len(texts)))
    fixed = {r.doc_id: r.text for r in mojibake.restored(df).collect()}
    assert fixed[len(texts) - 1] == f"{words} 99" and fixed[len(sound) + 3] == words


def test_originals_that_are_nowhere_else(spark):
    japanese = "このデータはカタログに登録されています。"
    french = "déjà élève forêt"
    bad = [mojibake.misread(japanese.encode(right), "cp1252") for right in mojibake.DOUBLE_BYTE]
    bad += [mojibake.misread(french.encode("cp1252"), "cp437"), mojibake.misread("Добавил словарь озера".encode("cp1251"), "cp1252")]
    sound = ["répétée éléphant Žižek Škoda", "10 µmol αmax °C", "ÀÉÈÊ", "Россия ТРУХА хруст", japanese[:6] + " x"]
    df = spark.createDataFrame(list(enumerate(bad + sound)), "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == set(range(4))
    fixed = {r.doc_id: r.text for r in mojibake.restored(df).collect()}
    assert fixed[1] == japanese and fixed[2] == french and fixed[3] == "Добавил словарь озера"
