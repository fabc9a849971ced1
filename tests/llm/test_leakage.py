"""A leak depends on the document, the item and the corpus only, and re-parameterised items are told from copies."""

import random
import re

import pytest

from triplane.llm import leakage

from test_text_ops import passage


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_one_item_and_near_equal_items(spark):
    rnd = random.Random(20)
    text = passage(rnd)
    near = text.replace("archive", "annals")
    D, B = frames(spark, [(1, f"before {text} after")], [(1, text)])
    assert [tuple(r) for r in leakage.leaks(D, B).collect()] == [(1, 1)]
    D, B = frames(spark, [(1, text)], [(1, text), (2, near), (3, near)])
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == {(1, 1), (1, 2), (1, 3)}


@pytest.mark.parametrize("words", [50, 100, 2000, leakage.BLOCK_WORDS])
def test_items_alone_and_in_blocks(spark, monkeypatch, words):
    rnd = random.Random(21)
    items = [(i, passage(rnd)) for i in range(8)]
    docs = [(i, f"{passage(rnd, 2)} {t if i % 2 else ' '.join(t.split()[: len(t.split()) * 2 // 3])}") for i, t in items]
    D, B = frames(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", words)
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == {(i, i) for i, _ in items}
    alone = [tuple(r) for i in (0, 5) for r in leakage.leaks(D, B.filter(f"item_id = {i}")).collect()]
    assert alone == [(0, 0), (5, 5)]


def test_short_items(spark):
    items = [(1, "Zanebo"), (2, "the lake of Zanebo"), (3, "..."), (4, "one two three four five")]
    docs = [(1, "near ZANEBO, on foot"), (2, "by the lake, of Zanebo"), (3, "..."), (4, "x one two three four five x"), (5, "one three two")]
    D, B = frames(spark, docs, items)
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == {(1, 1), (2, 1), (2, 2), (4, 4)}


def test_refilled(spark):
    rnd = random.Random(22)
    items = [(i, passage(rnd)) for i in range(6)]

    def other(text, consistent):
        names: dict[str, str] = {}

        def fill(m):
            new = str(rnd.randint(2, 9999)) if m[0].isdigit() else "".join(rnd.choices("bdfgklmn", k=7))
            return names.setdefault(m[0], new) if consistent else new

        return re.sub(r"\b\d+\b|(?<=of )\w+", fill, f"{text} {text}") if consistent is not None else text

    doubled = [(i, f"{t} {t}") for i, t in items]
    docs = [(i, other(t, True)) for i, t in items] + [(10 + i, other(t, False)) for i, t in items] + [(20 + i, f"{t} {t}") for i, t in items]
    docs += [(30, None), (31, ""), *((40 + n, passage(rnd, 3)) for n in range(30))]
    D, B = frames(spark, docs, [*doubled, (90, None)])
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_own) for r in leakage.refilled(D, B).collect()}
    assert {k for k in got if k[0] == k[1]} == {(i, i) for i, _ in items} and all(n > own for n, own in got.values())
    assert not any(d == 20 + i for d, i in got)
    assert {tuple(r) for r in leakage.leaks(D, B).collect()} == {(20 + i, i) for i, _ in items}
    assert leakage.refilled(D.limit(0), B).collect() == [] and leakage.refilled(D, B.limit(0)).collect() == []


def test_common_words(spark):
    docs = [(i, f"The lake, the river and w{i} of 12 km" if i % 2 else "the LAKE") for i in range(300)] + [(999, None), (998, "")]
    D, _ = frames(spark, docs, [(1, "x")])
    assert leakage.common_words(D) == ["and", "lake", "of", "river", "the"]
