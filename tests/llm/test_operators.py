"""Each operator against a plain version of itself, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The smallest documents table, and rows with every oddity."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(3)]
    odd = [
        (9000, None, None, None, None),
        (9001, "", "en", None, 0),
        (9002, " \n\t ", "en", "odd", 4),
        (9003, "one", "en", "odd", 3),
        (9004, "one", "en", "odd", 3),
        (9005, "ONE two\nthree", "en", "odd", 13),
        (9006, "a" * 900, "xx", "odd", 900),
        (9007, "ab" * 300 + "é" + "ab" * 300, "en", "odd", 1201),
        (9008, "don't l'été 12a<|endoftext|>  \n\n x y \x1c z ½² ǅ日本 中'll ́a", "en", "odd", 40),
        (9009, "… € 12 —", "de", "odd", 8),
    ]
    for k, text in enumerate(base):
        for j in range(8):
            w = text.split()
            for _ in range(j):
                w[rng.randrange(len(w))] = f"x{k}{j}"
            odd.append((9100 + 10 * k + j, " ".join(w), "en", "copies", len(text)))
    odd.append((9200, " ".join(rng.choice(words) for _ in range(30_000)), "en", "long", 1))
    full = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    table = full.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("size", F.lit(1)).withColumn("component_id", F.lit("x"))
    table = table.withColumn("n", F.lit(2)).withColumn("a", F.lit(3)).withColumn("target", F.lit(4.0)).cache()
    return table


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r.doc_id)


def empty(docs):
    return docs.limit(0)


def test_mix(spark, docs, rows):
    from wakeline.llm.mixing import mix, repeat_documents

    got = {r.doc_id: r for r in mix(docs).collect()}
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    sums = defaultdict(int)
    for r in rows:
        sums[r.source] += size[r.doc_id]
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sums.values()), set()
    while True:
        level = (total - sum(2 * sums[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * sums[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * sums[s] if s in full else level * weight[s] for s in order}
    assert set(got) == set(size)
    taken = defaultdict(int)
    for d, r in got.items():
        assert r["size"] == size[d] and r.source_size == sums[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) < 1
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {d: r.taken for d, r in got.items()}
    out = repeat_documents(docs, mix(docs))
    assert out.columns == docs.columns
    counts = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(got[d].epochs <= counts[d] <= got[d].epochs + 1 for d in got)
    assert mix(empty(docs)).count() == 0


def test_contaminated(spark, docs, rows):
    from wakeline.llm.decontaminate import clean_documents, contaminated

    passage = " ".join(f"q{i}" for i in range(40))
    extra = [(9300, f"Some words. {passage.upper()}, and more", "en", "s", 1), (9301, " ".join(passage.split()[:20]), "en", "s", 1), (9302, "just Two, words here", "en", "s", 1), (9303, " ".join(passage.split()[2:36]), "en", "s", 1)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, SCHEMA))
    items = [(1, passage), (2, None), (3, ""), (4, "two words"), (5, passage), (6, "\n. !")]
    items = spark.createDataFrame(items, "item_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select((F.col("item_id") + 100).alias("item_id"), "text"))

    def grams(t, n):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for i in items.collect():
        w, _ = grams(i.text, 5)
        if not w:
            continue
        k = min(5, len(w))
        own = grams(i.text, k)[1]
        for d in table.collect():
            both = len(own & grams(d.text, k)[1])
            if both >= 0.8 * len(own):
                want[d.doc_id, i.item_id] = (both, len(own))
    for bound in (500_000, 0):
        got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in contaminated(table, items, broadcast_rows=bound).collect()}
        assert got == want
    assert {(9300, 1), (9300, 5), (9302, 4), (9303, 1)} <= set(want) and (9301, 1) not in want
    clean = clean_documents(table, items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in table.collect()} - {d for d, _ in want}
    assert contaminated(table, items.limit(0)).count() == 0
    assert contaminated(table.limit(0), items).count() == 0


def test_suffix_dedup(spark, docs, rows):
    from wakeline.llm.suffix_dedup import remove_repeats

    for length, bound in ((100, 64 << 20), (40, 0)):
        got = {r.doc_id: r for r in remove_repeats(docs, length=length, with_text=True, broadcast_bytes=bound).collect()}
        seen = set()
        for r in rows:
            b = (r.text or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - length + 1):
                s = b[i : i + length]
                if s in seen:
                    gone[i : i + length] = b"\1" * length
                seen.add(s)
            kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
            g = got[r.doc_id]
            assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, g.kept) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept), r.doc_id
    assert remove_repeats(empty(docs)).count() == 0


def test_suffix_classes():
    from wakeline.llm.suffix_dedup import suffix_classes

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    at = np.arange(480)
    for length in (5, 20):
        classes = suffix_classes(data, at, length)
        strings = [data[i : i + length].tobytes() for i in at]
        order = sorted(range(480), key=lambda i: (strings[i], i))
        assert [strings[i] for i in np.lexsort((at, classes))] == [strings[i] for i in order]
        assert len(set(classes.tolist())) == len(set(strings))


def _sets(rows, n):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = {}
    for r in rows:
        w = WORD.findall((r.text or "").translate(lower))
        out[r.doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, rows, n, percent):
    from wakeline.llm.jaccard_join import near_duplicates, one_of_each

    sets = _sets(rows, n)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, n=n, percent=percent, hubs=2).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    if n == 5:
        kept = {r.doc_id for r in one_of_each(docs, n=n, percent=percent).collect()}
        assert kept == {d for d in sets if find(d) == d}
        assert near_duplicates(empty(docs), n=n).count() == 0


def test_components(spark):
    from wakeline.llm.graph import components
    from wakeline.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(30)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, *range(200, 230))}, 400: 400, 500: 400, 450: 400}


def test_toxicity(spark):
    from wakeline.llm.toxicity import fit, not_toxic, score

    rng = random.Random(1)
    plain, bad = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["foul", "vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(400):
        dose = (0, 0, 0, 0.02, 0.08, 0.2)[i % 6]
        words = [rng.choice(bad) if rng.random() < dose else rng.choice(plain) for _ in range(150)]
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 4:
            labels.append((i, 1, int(dose > 0)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "…", "en", "s", 1), (1003, "FOUL! Vile? rotten nasty foul.", "en", "s", 1)]
    labels += [(None, 1, 1), (77777, 1, 1), (1000, 1, None)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score(docs, fit(docs, labels)).collect()}
    wrong = sum(got[i].toxic != (any(w in r[1].split() for w in bad)) for i, r in enumerate(rows[:400]))
    assert wrong <= 12
    means = [np.mean([got[i].severity for i in range(400) if i % 6 == k]) for k in (0, 3, 4, 5)]
    assert means == sorted(means) and not got[1000].toxic and not got[1001].toxic and not got[1002].toxic and got[1003].toxic
    kept = {r.doc_id for r in not_toxic(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if not r.toxic}
    assert not any(r.toxic for r in score(docs, fit(docs, labels.limit(0))).collect())
    assert score(docs.limit(0), fit(docs, labels)).count() == 0


def test_ordinal_gradient():
    from wakeline.llm.toxicity import fit_ordinal

    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=3000), rng.logistic(size=3000)
    grade = np.searchsorted([-1.0, 1.0], 2 * x + noise)
    w, theta = fit_ordinal(np.arange(3000), np.zeros(3000, int), x, grade, 1, rounds=800)
    assert w[0] == pytest.approx(2, abs=0.25) and theta == pytest.approx([-1, 1], abs=0.2)


def test_token_store(spark, docs, rows, tmp_path):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from wakeline.llm.token_store import encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in encode(docs, tokenizer=path, folder=f"file://{tmp_path}/t", length=64).collect()}
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    start, stream = 0, []
    for r in rows:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        start += len(ids)
        stream += ids
    read = []
    for f in sorted((tmp_path / "t" / "files").glob("ids-*.arrow")):
        table = pa.ipc.open_file(pa.memory_map(str(f)))
        assert table.schema.field("ids").type.list_size == 64
        for k in range(table.num_record_batches):
            b = table.get_batch(k)
            ids, mask = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
            read += ids[mask].tolist()
    assert read == stream
    assert encode(empty(docs), tokenizer=path).count() == 0


def test_quality_rules(spark, docs, rows):
    from wakeline.llm.quality_rules import fit, judge, posterior

    rng = random.Random(5)
    junk = [(9400, "\n".join(["same line again and again"] * 40), "en", "s", 1), (9401, " ".join(f"{w}$$$ ###" for w in ["abc"] * 80), "en", "s", 1), (9402, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + "&&&" for _ in range(200)), "en", "s", 1)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(junk, SCHEMA))
    got = {r.doc_id: r for r in judge(table).collect()}
    for r in table.collect():
        t = r.text or ""
        w = WORD.findall(t)
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        seen, same = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                same += line in seen
                seen.add(line)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), same, len(again)), r.doc_id
        assert g.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (g.base_failed and g.kept)
    assert not got[9400].kept and not got[9401].kept and not got[9402].kept and got[9200].kept
    assert judge(empty(docs)).count() == 0
    # votes drawn from known accuracies are told apart
    draw = np.random.default_rng(2)
    y = draw.random(20_000) < 0.85
    votes = np.where(draw.random((20_000, 6)) < np.where(y, 0.02, 0.5)[:, None], -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table_ = fit(patterns, counts.astype(float))
    p = posterior(votes, prior, table_)
    assert ((p >= 0.5) == y).mean() > 0.95


def test_language_id(spark, docs):
    from wakeline.llm.language_id import family_of, fit, predict

    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    table = full.unionByName(docs.where("doc_id >= 9000").select(*full.columns))
    model = fit(full)
    got = {r.doc_id: r for r in predict(table, model).collect()}
    held = [r for r in full.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (9000, 9001, 9002, 9009))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert family_of("fr") == family_of("es_MX") != family_of("de") and family_of("zz") == "zz"
    assert {r.lang_pred for r in predict(table, fit(full.limit(0))).collect()} == {"und"}
    one = fit(full.where("lang = 'de'"))
    assert {r.lang_pred for r in predict(full, one).collect()} == {"de"}


def test_license_scan(spark, docs):
    from wakeline.llm.license_scan import background_sample, scan, train

    extra = [
        (9500, "Some text here.\nLicensed under the Apache License, Version 2.0.\nMore text", "en", "s", 1),
        (9501, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "en", "s", 1),
        (9502, "the license of a driver is under version control, and the public works in general", "en", "s", 1),
        (9503, "All rights reserved.\nThis work is licensed under the GNU General Public License, version 3.", "en", "s", 1),
        (9504, "license under version apache the 2.0", "en", "s", 1),
    ]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r.doc_id: r for r in scan(table, train(background_sample(table))).collect()}
    assert got[9500].families == "apache" and got[9500].n_paragraphs == 3
    assert got[9501].families == "mit" and got[9502].families == "" and got[9503].families == "gpl,reserved" and got[9504].families == ""
    cues = re.compile(r"licen[cs]e|rights reserved", re.I)
    for r in docs.collect():
        assert (got[r.doc_id].n_licences > 0) == bool(cues.search(r.text or "")), r.doc_id
    assert scan(empty(docs), train([])).count() == 0


def test_main_text(spark):
    from wakeline.llm.html_wrapper import main_text

    def page(k, body):
        return f"<html><head><title>t{k}</title><script>var t='</p>'</script></head><body><nav><ul><li><a>Home</a><li>Menu {k}</ul></nav>{body}<footer>&copy; site</footer></body>"

    rows = [(k, f"https://a.example/{k}", page(k, f"<article><h1>Title {k}</h1><p><b>First {k} &amp; more<br>line<p>Second\n  {k}<p>Share this story<aside>see also</aside><div class='comments'><p>me too</p></div></article><p>after</p>")) for k in range(20)]
    rows += [(100 + k, f"http://B.example/{k}", page(k, f"<div id=wrap><div><p>Welcome to our site</p></div><div><p>Story {k} starts</p><p>and ends {k}</p></div></div>")) for k in range(20)]
    rows += [(200, None, None), (201, "x", ""), (202, "x", "just text &lt;b&gt;"), (203, None, "<p>one<p>two</div><table><tr><td>a<td>b</table>"), (204, "https://a.example/z", "<article><p>cut o"), (0, "https://a.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y"))
    for bound in (64 << 20, 0):
        got = {r.page_id: r for r in main_text(pages, broadcast_bytes=bound).collect()}
        for k in range(20):
            assert got[k].text == f"Title {k}\nFirst {k} & more line\nSecond {k}"
            assert got[100 + k].text == f"Story {k} starts\nand ends {k}"
        assert got[200].text == "" and got[201].text == "" and got[202].text == "just text <b>" and got[203].text == "one\ntwo\na\nb" and got[204].text == "cut o"
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert main_text(pages.limit(0)).count() == 0


def test_tree_matching():
    from wakeline.llm.html_wrapper import align, parse

    a, b = parse("<div><p>1</p><ul><li>x<li>y</ul><p>2</p></div>")[0], parse("<div><p>1</p><p>new</p><ul><li>x</ul><p>3</p></div>")[0]
    out = {}
    assert align(a, b, out) == 6  # root, div, p, ul, li, p
    assert {k: n.tag for k, n in out.items()}[0] == ""


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == columns, name
        if name != "mixing":
            assert 0 < out.count() <= docs.count()
        docs, before = out, docs
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and before is not None
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), sf_dir).count() == 0, name


def test_queries_are_registered():
    from wakeline.llm.oracles import ORACLES
    from wakeline.llm.queries import QUERIES

    assert [n.split("_")[0] for n in QUERIES][:10] == [f"op{k}" for k in range(1, 11)] and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)
