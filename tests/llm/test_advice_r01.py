"""The cases of the first review."""

import zlib

import numpy as np


def test_added_tokens(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from wakeline.llm.queries import QUERIES

    texts = ["ab <|endoftext|> cd", "<|endoftext|><|endoftext|>", "l'été<|endoftext|>\n\n日本 \x1c x", "<|endoftext| >", "plain words", None]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for k, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert want[0][1] == 5
    for out in (QUERIES["op6_token_store"](spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["tokens"](spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in out.collect()} == want


def _main_text(spark, rows):
    from wakeline.llm.html_wrapper import main_text

    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_are_not_template(spark):
    story = "<h1>The long story</h1><p>It was told many times, always in these words and no others, over and over again.</p>"
    rows = []
    for k in range(120):
        inner = story if k >= 12 else f"<h1>Another title {k}</h1><p>Quite another story, number {k}, that nobody has copied so far.</p>"
        menu = "<div><p>Welcome to our site</p></div>"
        rows.append((k, f"https://marked.example/{k}", f"<body>{menu}<article>{inner}<p>Share this story</p></article><footer>{k}</footer></body>"))
        rows.append((1000 + k, f"https://plain.example/{k}", f"<body>{menu}<div>{inner}</div><div><p>Page {k}</p></div></body>"))
    got = _main_text(spark, rows)
    for k in range(120):
        want = "The long story\nIt was told many times" if k >= 12 else f"Another title {k}\nQuite another story, number {k}"
        assert got[k].startswith(want) and "Share" not in got[k], got[k]
        assert got[1000 + k].startswith(want) and "Welcome" not in got[1000 + k], got[1000 + k]


def test_template_goes_by_its_text(spark):
    rows = [(k, f"https://a.example/{k}", f"<article><h1>Title {k}</h1><h2>{'No summary' if k % 10 else f'Summary of {k}'}</h2><p>The text of article {k} at some length.</p></article>") for k in range(40)]
    got = _main_text(spark, rows)
    for k in range(0, 40, 10):
        assert got[k] == f"Title {k}\nSummary of {k}\nThe text of article {k} at some length."


def test_small_hosts_have_a_template(spark):
    rows = []
    for size in (1, 2, 3, 10):
        for k in range(size):
            body = f"<div><p>Home</p><p>All about our site</p></div><div><p>Story {k} of {size} starts in this way</p><p>and number {k} ends so</p></div><div><p>All prices without tax</p></div>"
            rows.append((100 * size + k, f"https://h{size}.example/{k}", f"<body>{body}</body>"))
    rows.append((299, "https://h2.example/again", rows[1][2]))
    got = _main_text(spark, rows)
    for size in (2, 3, 10):
        for k in range(size):
            assert got[100 * size + k] == f"Story {k} of {size} starts in this way\nand number {k} ends so"
    assert got[299] == got[200] and got[100].startswith("Home\n")


def test_slugs_in_an_article(spark):
    rows = []
    for k in range(12):
        inside = (
            f"<h1 class='article-header'>Title {k}</h1><p class='header'>Lead {k}</p><h2 id='related-work'>Related work {k}</h2><section id='search-strategy'><p>Searched {k}</p></section>"
            f"<div id='social-impact'><p>Impact {k}</p></div><h3 id='Comments_on_method'>Comments {k}</h3><p class='alert-levels'>Levels {k}</p>"
            f"<div class='box Ad'><p>Buy {k}</p></div><div class='comments'><h3>Me too {k}</h3></div><div role='complementary'>See {k}</div>"
        )
        rows.append((k, f"https://a.example/{k}", f"<body><div id='site-header'>Site {k}</div><article class='related'>{inside}</article></body>"))
    got = _main_text(spark, rows)
    for k in range(12):
        assert got[k] == "\n".join(f"{x} {k}" for x in ("Title", "Lead", "Related work", "Searched", "Impact", "Comments", "Levels"))


def test_wrapped_and_hidden_licences(spark):
    from wakeline.llm.license_scan import background_sample, scan, train

    gnu = "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    plain = [f"w{k % 397} the w{k % 211} of v{k % 89}" for k in range(4_000)]
    texts = {
        1: ("gpl", f"This program is free software:\n{gnu}, either version 3."),
        2: ("bsd", f"Some words before.\n\n{bsd}\n * a list\n"),
        3: ("mit", " ".join([*plain[:2_500], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", *plain[2_500:]])),
        4: ("", " ".join(["the public use of the source and the license of a version under the terms in general"] * 1_200)),
        5: ("", "you can redistribute it and/or modify\n\nit under the table"),
        6: ("apache", "Text.\nLicensed under the Apache\nLicense, Version 2.0.\nMore text"),
    }
    docs = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()] + [(7, None), (8, "\n \n")], "doc_id long, text string")
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in scan(docs, train(background_sample(sample))).collect()}
    assert {k: got[k].families for k in texts} == {k: f for k, (f, _) in texts.items()}
    assert all(got[k].n_licences == (1 if f else 0) and got[k].n_candidates >= got[k].n_licences for k, (f, _) in texts.items())
    assert got[1].n_paragraphs == 4 and got[7].n_paragraphs == got[8].n_paragraphs == 0


def test_near_duplicates_by_row(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [
        (1, text(1)), (5, text(1)), (5, text(2)),  # one id, two texts: only the copy of 1 goes
        (7, text(3)), (7, text(3)), (7, text(3) + " more"),  # repeated rows
        (None, text(4)), (None, text(4)), (None, text(5)),  # copies without an id
        (9, text(6)), (None, text(6)),  # a row with an id stays before one without
        (20, text(7)), (21, text(7)), (22, text(8)),
        (30, ""), (30, ""), (None, None),  # empty sets link with nothing
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    third = [t for i, t in got if i == 7]
    assert len(third) == 1 and third[0].startswith(text(3))
    want = [(1, text(1)), (5, text(2)), (7, third[0]), (None, text(4)), (None, text(5)), (9, text(6)), (20, text(7)), (22, text(8)), (30, ""), (30, ""), (None, None)]
    assert got == sorted(want, key=str)


def test_stages_go_by_row(spark, sf_dir):
    from wakeline.llm.decontaminate import clean_documents, contaminated
    from wakeline.llm.mixing import mix, repeat_documents
    from wakeline.llm.toxicity import not_toxic

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k, n=40: " ".join(f"a{k}b{j}" for j in range(n))
    # mixing: a blank row, or one of another source, under the same id doesn't take the others with it
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in [(None, "", "x"), (None, words(1), "x"), (None, words(2), None), (4, " ", "x"), (4, words(4), "x"), (4, words(5), None), (6, words(6), "x"), (6, words(6), "x")]], schema)
    got = [r.text for r in repeat_documents(docs, mix(docs, share=2.0)).collect()]
    assert sorted(got) == sorted([words(k) for k in (1, 2, 4, 5, 6, 6)] * 2)
    # benchmark: rows without an id are checked, items are told apart by their texts
    items = spark.createDataFrame([(1, words(11)), (1, words(12)), (None, words(13)), (None, words(14))], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"x {words(11)} y", "en", "s", 1), (2, words(12), "en", "s", 1), (2, words(20), "en", "s", 1), (None, words(14), "en", "s", 1), (None, None, "en", "s", 1)], schema)
    assert sorted((r.doc_id or 0, r.text or "") for r in clean_documents(docs, items).collect()) == [(0, ""), (2, words(20))]
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()] == [(2, 1)]
    # toxicity: a toxic row without an id goes, a plain one under a toxic one's id stays
    rows = [(k, ("foul vile rotten " * 5 if k % 2 else "") + words(k % 7), "en", "s", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(150)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (None, rows[1][1], "en", "s", 1), (199, words(3), "en", "s", 1)], schema)
    kept = not_toxic(docs, labels).collect()
    assert len(kept) == 101 and not any("foul" in r.text for r in kept) and 199 in {r.doc_id for r in kept}
