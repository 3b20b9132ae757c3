"""Junk that passes the base rules, wide windows of repeats, rows without ids, letters that change length in lower case, clashing names."""

import random

import duckdb
import pytest

SCHEMA = "doc_id long, text string"


def plain_removal(texts, length):
    seen, left = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone, own = bytearray(len(b)), set()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen or s in own:
                gone[i : i + length] = b"\1" * length
            own.add(s)
        seen |= own
        left[d] = sum(gone)
    return left


@pytest.mark.parametrize("length", [100, 288, 400, 800])
def test_repeats_of_any_length(spark, length):
    from wakeline.llm.suffix_dedup import remove_repeats

    rng = random.Random(length)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2100))
    texts = {1: base, 2: "x" + base[5:1900] + "yy" + base[200:1500], 3: base[1000:1000 + length] + "-" + base[: length - 1], 4: base * 2}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs, length=length).collect()} == plain_removal(texts, length)


def test_verdict_of_the_model(spark):
    """Labels of the given table, which the model never sees: what it rejects beyond the base rules is what they call low quality."""
    from wakeline.llm.quality_rules import judge

    sf = "/root/testdata/sf0.1"
    got = judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("quality is not null").collect()
    low, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in low) >= 0.95 * len(low) and len(low) > 400
    assert sum(not r.kept for r in good) <= 0.01 * len(good) and len(good) > 2000
    assert sum(not r.kept and not r.base_failed for r in low) > 200


def test_junk_that_passes_base_rules(spark):
    from wakeline.llm.quality_rules import judge

    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("stone", "river", "light", "paper", "green", "house", "table") for b in ("s", "er", "ing", "ed", "", "y", "ly")]
    line = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    prose = [(k, "\n".join(line() for _ in range(rng.randrange(15, 40)))) for k in range(400)]
    junk = [(1000 + k, " ".join(w + rng.choice(["###", "&&&", "%%%", "$$"]) for w in "\n".join(line() for _ in range(25)).split(" "))) for k in range(30)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(prose + junk, SCHEMA)).collect()}
    assert not any(got[d].base_failed for d, _ in prose + junk)
    assert all(got[d].kept for d, _ in prose) and not any(got[d].kept for d, _ in junk)


def test_raw_elements_behind_letters_that_grow_in_lower_case():
    from wakeline.llm.html_wrapper import parse

    for letter in ("İ", "K", "ß"):
        page = f"<html><body><article><p>{letter * 60}</p><script>var a = 1 < 2;</SCRIPT ><p>after</p><style>p {{}}</style><p>{letter} end</p></article></body></html>"
        assert [t for _, t in parse(page)[1]][-2:] == ["after", f"{letter} end"]
        assert not any("var a" in t and not n.out for n, t in parse(page)[1])


def test_decontamination_of_rows_without_id(spark):
    from wakeline.llm.decontaminate import clean_documents, contaminated

    item = "what is the tallest mountain on the second largest continent of earth"
    rows = [(None, f"well {item} indeed"), (None, f"well {item} indeed"), (None, f"then {item}"), (None, "nothing of that kind is here at all"), (None, None), (1, item), (1, item), (2, "other words stand here instead")]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(docs, items, without_id=True).collect()) == [(0, 7), (0, 7), (1, 7)]
    assert sorted(r.text or "" for r in clean_documents(docs, items).collect()) == ["", rows[3][1], rows[7][1]]


def test_near_duplicates_of_rows_without_id(spark):
    from wakeline.llm.jaccard_join import near_duplicates, one_of_each

    rng = random.Random(4)
    text = [f"w{rng.randrange(900)}" for _ in range(120)]
    a, b, c = " ".join(text), " ".join(text[:60] + ["x"] + text[61:]), " ".join(text[:60] + ["x"] + text[61:118])
    rows = [(5, a), (None, b), (9, c), (None, a), (None, "some other words that only a row without id holds"), (None, "some other words that only a row without id holds"), (3, "alone here")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.component_id or 0) for r in near_duplicates(docs, n=5, percent=80).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 0, 5), (0, 5, 5), (3, 3, 3), (5, 5, 5), (9, 9, 5)]
    clash = docs.selectExpr("*", "'k' as _key", "'l' as _key_").union(spark.createDataFrame([(5, "again " + a, "k", "l")], "doc_id long, text string, a string, b string"))
    assert sorted(r.doc_id or 0 for r in one_of_each(clash).collect()) == [0, 3, 5]


def test_labels_of_repeated_documents(spark):
    """What the driver collects is a row a label, not a row a document."""
    from wakeline.llm import toxicity

    bad, good = "vile slur curse", "kind calm soft"
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice((bad if k % 4 == 0 else good).split() + ["the", "a", "of"]) for _ in range(40))) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    once, often = toxicity.fit(docs, labels), toxicity.fit(docs.union(docs).union(docs), labels)
    assert (once.words == often.words).all() and abs(once.weights - often.weights).max() < 1e-9 and len(once.words)


def test_decontamination_sql_keeps_rows_without_id():
    from wakeline.llm.oracles import ORACLES

    con = duckdb.connect()
    con.execute("create view documents as select null::bigint doc_id, 'one two three four five six' as text")
    con.execute("create view benchmark as select 1 item_id, 'one two three four five six' as text")
    assert con.execute(ORACLES["op3_decontamination"]).fetchall()


#: Notices as they stand in files, in wordings that no template has whole.
NOTICES = {
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "epl": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/",
}


def test_licences_in_files(spark, sf_dir):
    from wakeline.llm.license_scan import background_sample, scan, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(background_sample(docs))
    plain = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(len(NOTICES)).collect()]
    rows = [(k, text) for k, text in enumerate(NOTICES.values())] + [(100 + k, f"{body}\n\n{text}") for k, (body, text) in enumerate(zip(plain, NOTICES.values(), strict=True))]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, SCHEMA), model).collect()}
    for k, family in enumerate(NOTICES):
        assert got[k].families == family, (family, got[k])
        assert family in got[100 + k].families.split(","), (family, got[100 + k])
