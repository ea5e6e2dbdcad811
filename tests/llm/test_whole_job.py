"""The training-data operators take the whole of their input."""

import pytest

from scriptorium.llm import license_scan, quality

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"


def labels_of(spark, texts):
    rows = license_scan.report(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    return [(r["labels"], r["n_matches"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_wrapped_notices(spark):
    prose = "some other words\n" * 30
    narrow = "\n\n".join(license_scan.TEMPLATES[9][1].split())
    apart = license_scan.TEMPLATES[1][1].replace("with or", "\n" + "far apart " * 20 + "\nwith or")
    whole = "x\n" + license_scan.TEMPLATES[8][1] + "\nChapter 2"
    got = labels_of(spark, [prose + BSD + "\n" + prose, MPL, narrow, apart, whole, BSD + "\n" + prose + BSD, BSD.replace("\n", " ")])
    assert got == [("bsd", 1), ("mpl-2.0", 1), ("gpl,lgpl-2.1", 1), ("", 0), ("gpl,gpl-3.0", 1), ("bsd", 2), ("bsd", 1)]


def test_sql_states_the_same_rules(spark, tmp_path):
    """Wrapped, doubled and nested notices, in the query and in its SQL."""
    import duckdb

    from scriptorium.llm import queries

    prose, bsd, mit = "some other words\n" * 9, BSD, "Released under the MIT License."
    gpl2, gpl3 = license_scan.TEMPLATES[7][1], license_scan.TEMPLATES[8][1]
    texts = [None, "", prose + bsd + "\n" + prose + bsd, MPL + "\n" + MPL, f"{mit} {bsd} {mit}", f"{gpl3} {gpl2}", f"{gpl3}\n{gpl2}\n{prose}", "CC-BY-NC 4.0 licensed\nunder", gpl2.replace(" ", "\n"), f"{mit}\n" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.report(license_scan.scan(df))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    rel = con.execute(queries.license_sql())
    names = [c[0] for c in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())


@pytest.mark.parametrize("filler", ["\U0001f600 a ", "日本語 é ", "𝔘 \U0001f468\u200d\U0001f469 ß1 ", "x", "a b\n", "İ ſ \u212a "])
def test_long_texts_of_any_script(spark, filler):
    """100,000 repetitions, of one and two UTF-16 units and of changing width, before and after a notice and a phrase."""
    notice = "Released under the MIT License."
    text = f"{filler * 100_000} All rights reserved. {filler * 50_000}\n{notice}"
    row = license_scan.report(license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    n = len(license_scan.all_words(filler * 100_000))
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (1, n, n, "mit,reserved")
    assert row["n_words"] == len(license_scan.all_words(text))


def test_every_notice_of_a_block(spark):
    mit, apache, gpl3 = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", license_scan.TEMPLATES[8][1]
    texts = [f"{mit} {apache}", gpl3, f"{gpl3} {license_scan.TEMPLATES[7][1]}", "Licensed under CC BY-NC 4.0.", f"{apache} {BSD} {MPL} {mit}".replace("\n", " ")]
    assert labels_of(spark, texts) == [("apache-2.0,mit", 2), ("gpl,gpl-3.0", 1), ("gpl,gpl-2.0,gpl-3.0", 2), ("cc-by,cc-by-nc-4.0", 1), ("apache-2.0,bsd,mit,mpl-2.0", 4)]


def test_every_unlabelled_document_can_be_pseudo_labelled(spark):
    n = 9000
    make = lambda i: (i, "good clear prose" if i % 2 else "buy cheap pills", "en", "a" if i % 2 else "b", 16)
    docs = spark.createDataFrame([make(i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    sums = []
    whole, quality.pseudo_labelled = quality.pseudo_labelled, lambda *a: sums.append(whole(*a)) or sums[-1]
    try:
        model = quality.train(docs, labels)
    finally:
        quality.pseudo_labelled = whole
    assert sums[-1].n == n - 400 == sum(sums[-1].tuples.values())
    assert all(r["kept"] == bool(r["doc_id"] % 2) for r in quality.scored(docs, model).collect())


def test_shape_counts_whole_classes():
    of = lambda raw: quality.shape(raw, raw.split(), len(set(raw.split())))
    plain = of(b"abcd")
    for i, junk in ((8, b"()[]"), (9, b"BCDZ"), (10, b"4698")):
        assert of(junk)[i] == plain[i] + quality.LEVELS - 1
    assert of(b"a " * 500)[11] > of(b"a\n" * 500)[11]
    assert len(of(b"")) == quality.SHAPES
