import random
import re

import duckdb

from aerolens.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
             if words[i:i + len(phrase.split())] == phrase.decode().split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(2)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "gnu", "é", "x1", "\n", "the", "(mit)", "license.license", "version 3", "_"]
    made = ["-".join(rng.choices(parts, k=rng.randint(1, 60))) if i % 2 else " ".join(rng.choices(parts, k=rng.randint(1, 60))) for i in range(300)]
    return [*made, None, "", "...", "general public license " * 3000, "ＭＩＴ license", "MIT license"]


def test_base_places_equal_brute_force(spark):
    some = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(some)], "doc_id long, text string, other int, source string").repartition(5)
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == len(some)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(some[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_templates_are_found_in_long_texts_and_need_their_key_phrase(spark, prose):
    filler = prose(400, 3)
    notices = {0: "Licensed under CC BY-NC 4.0.", 1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
               2: "Licensed under CC terms 4.0.", 3: "Redistribution and use in source and binary forms, with or without modification, are permitted",
               4: "licensed under the agreement version 2 0"}
    df = spark.createDataFrame([(i, f"{filler}\n{n}\n{filler}") for i, n in notices.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df).collect()}
    assert got[0] == ("cc-by-nc", 1.0) and got[1][0] == "mit" and got[3] == ("bsd", 1.0)
    assert got[2] == ("", 0.0) and got[4] == ("", 0.0)


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_the_names_of_outputs_come_out_renamed(spark):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = spark.createDataFrame([(1, "under the mit license", *range(7))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    row = licenses.scan_licenses(docs).first()
    assert [row[f"{n}_given"] for n in names] == list(range(7)) and row["n_words"] == 4 and row["base_labels"] == "mit"


def test_every_notice_is_found_as_it_is_worded(spark, prose):
    filler = prose(300, 5)
    made = licenses.TEMPLATES
    df = spark.createDataFrame([(i, f"{filler} {text.decode()} {filler}") for i, (_, text, _) in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(df).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(made))


def labels_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [set(r["labels"].split(",")) for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_versions_are_told_apart(spark):
    header = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software "
              "Foundation, either version {} of the License, or (at your option) any later version.")
    clause = "other materials provided with the distribution. "
    disclaimer = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED"
    conditions = "this list of conditions and the following disclaimer in the documentation and/or " + clause
    third = "3. Neither the name of ACME nor the names of its contributors may be used to endorse or promote products derived from this software without "
    got = labels_of(spark, [
        header.format("GNU General Public License", "2"), header.format("GNU General Public License", "3"),
        header.format("GNU Lesser General Public License", "2.1"), header.format("GNU Affero General Public License", "3"),
        conditions + disclaimer, conditions + third + "specific prior written permission. " + disclaimer,
        "// SPDX-License-Identifier: GPL-3.0-or-later", "// SPDX-License-Identifier: GPL-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "the GNU General Public License, version 4"])
    assert got == [{"gpl", "gpl-2.0"}, {"gpl", "gpl-3.0"}, {"gpl", "lgpl-2.1"}, {"gpl", "agpl-3.0"}, {"bsd-2-clause"}, {"bsd-3-clause"},
                   {"gpl-3.0"}, {""}, {"cc-by-sa-4.0"}, {"cc-by-3.0"}, {"gpl"}]


def test_all_phrases_must_stand_in_their_places(spark):
    far = "GNU General Public License " + "and so on " * 10 + "either version 3 of the License"
    assert labels_of(spark, [far]) == [{"gpl"}]


def test_scan_equals_its_sql_on_mixed_and_cut_notices(spark, tmp_path, prose):
    rng = random.Random(7)
    notices = [text.decode().split() for _, text, _ in licenses.TEMPLATES]
    made = []
    for _ in range(200):
        some = []
        for words in rng.choices(notices, k=rng.randint(1, 4)):
            cut = words[rng.randint(0, 2):len(words) - rng.randint(0, 4)]
            some += [w if rng.random() < 0.95 else "other" for w in cut] + prose(rng.randint(0, 6), rng.randint(0, 99)).split()
        made.append(" ".join(some))
    path = str(tmp_path)
    spark.createDataFrame([*enumerate(made), (200, None), (201, "")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["op2_licenses"](spark, path).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(queries.CHECKS["op2_licenses"]).fetchall()) and len(got) == 202
