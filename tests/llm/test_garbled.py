"""Garbled words in quotation marks, and garbled text whose case was changed afterwards."""

from triplane.llm import mojibake


def test_quoted_words(spark):
    clean = ["une table du Café de Flore", "le café Élysée, déjà vu"] * 3
    bad = ["they met at “CafÃ©” today", "a novel, «ÃŠtre et temps», was read", 'titled "dÃ©jÃ  vu"']
    sound = ["it prints “CafÃ©” for Café", "the sequence “Ã©” is wrong", "«Être» et “déjà”"]
    df = spark.createDataFrame(list(enumerate(bad + sound + clean)), "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == {0, 1, 2}
    fixed = {r.doc_id: r.text for r in mojibake.restored(df).collect()}
    assert fixed[0] == "they met at “Café” today"


def test_changed_case(spark):
    clean = ["edición técnica pública", "Редкий словарь города"] * 4
    bad = [mojibake.misread(t.encode(), "cp1252") for t in clean[:2]]
    texts = clean + [bad[0].lower(), bad[1].lower(), bad[0].upper(), "EDICIÓN TÉCNICA", "редкий словарь"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == {8, 9, 10}
    fixed = {r.doc_id: r.text for r in mojibake.restored(df).collect()}
    assert fixed[8] == "edición técnica pública"
