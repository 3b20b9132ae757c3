"""License scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are the lines of a text.  Each is scored by itself if it has at most LONG words.  As a notice may be wrapped, or stand in a very
long line, runs of non-blank lines, and longer lines, are also scored in overlapping windows of words, of several sizes up to more
than twice the longest template, which cross line breaks and together cover the whole text.  Features are hashed runs of one to three words in lower case, over the closed vocabulary of the
templates below, so a paragraph without any of their words costs one look-up a word.  Multinomial logistic regression tells licence
families and "unknown" apart.  It learns from templates with words left out or put in from around, and, as unknown, from a
bounded sample of the corpus' own paragraphs and from templates' words in random order.  A temperature and the least probability for a
licence are calibrated on examples held back from the fit.  A predicted family is confirmed by comparison with its
templates: enough of one template's word pairs, in the paragraph.

Defined cases: null and blank texts have no paragraphs; repeated rows are scanned alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import textops as T

#: Short forms of public licence notices, by family.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "apache": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "distributed under the apache 2.0 license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "use of this source code is governed by a bsd style license that can be found in the license file"],
    "cc0": ["released under cc0 1.0 universal public domain dedication", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "this work is dedicated to the public domain"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by-nc-sa 4.0", "licensed under cc by-nc-nd 4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2.1", "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "you can redistribute it and/or modify it under the terms of the gnu library general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the software is provided as is without warranty of any kind express or implied"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"],
    "zlib": ["in no event will the authors be held liable for any damages arising from the use of this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "reserved": ["all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without prior written permission of the publisher"],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
#: Word bytes: letters, digits, and all beyond ASCII.
_INSIDE = T.LETTER.copy()
_INSIDE[48:58] = True
RUNS = (1, 2, 3)
#: Words of a window; windows start every half of it.  The longest template, a quarter longer, fits into half of the largest.
LONG = 2 * (5 * max(len(_WORD.findall(t)) for ts in TEMPLATES.values() for t in ts) // 4 + 1)
WINDOWS = (LONG // 4, LONG // 2, LONG)


def _placed_grams(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of one to three words within each row, their rows, first words and lengths."""
    row = T.row_of(rows)
    out, where, first, length = [], [], [], []
    k = np.uint64(0xD6E8FEB86659FD93)
    for n in RUNS:
        if len(words) < n:
            break
        s = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            s = s * k + words[j : len(words) - n + 1 + j]
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        out.append(T.mix(s[at], n))
        where.append(row[at])
        first.append(at)
        length.append(np.full(len(at), n))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return np.concatenate(out), np.concatenate(where), np.concatenate(first), np.concatenate(length)


def _grams(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _placed_grams(words, rows)[:2]


def _lines(c: T.Chunk) -> tuple[T.Chunk, np.ndarray]:
    """A chunk of the lines of a chunk, and each line's row."""
    cut = np.unique(np.concatenate([np.flatnonzero(c.data == 10) + 1, c.start, c.end]))
    start, end = cut[:-1], cut[1:]
    row = np.searchsorted(c.start, start, "right") - 1
    end = np.where(c.data[end - 1] == 10, end - 1, end) if len(end) else end
    return T.Chunk(0, len(start), c.data, start, end), row


def _spanned_words(lines: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ws, we, rows = T.word_spans(lines, _INSIDE[lines.data])
    return T.mix(T.span_hash(T.prefix_hash(T.fold_case(lines.data)), ws, we)), rows, ws, we


def _line_words(lines: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    return _spanned_words(lines)[:2]


def _windows(offsets: np.ndarray, row: np.ndarray, first: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``size`` words that each gram lies in: grams, windows, and all windows' first word, end and row.

    offsets: of the words of each row.  A row has windows from every size // 2 words on, until one reaches its end.
    """
    step = size // 2
    words = np.diff(offsets)
    last = np.maximum(0, -(-(words - size) // step))
    base = np.concatenate([[0], np.cumsum(last + 1)])
    at = first - offsets[row]
    grams, windows = [], []
    for back in range(-(-size // step)):
        j = at // step - back
        here = np.flatnonzero((j >= 0) & (j <= last[row]) & (at + length <= j * step + size))
        grams.append(here)
        windows.append(base[row[here]] + j[here])
    of = np.repeat(np.arange(len(words)), last + 1)
    begin = offsets[of] + (np.arange(base[-1]) - base[of]) * step
    return np.concatenate(grams), np.concatenate(windows), begin, np.minimum(begin + size, offsets[1:][of]), of


def _told(family: int, words: set[int], share: float, family2: int, words2: set[int], share2: float) -> bool:
    """Whether a notice has been told by the second: of the same family in the same place, or of another that fits most of its words better."""
    if family == family2:
        return min(words) <= max(words2) and min(words2) <= max(words)
    return share <= share2 and 2 * len(words & words2) > min(len(words), len(words2))


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # [vocabulary, family and unknown]
    bias: np.ndarray
    temperature: float
    least: float
    templates: list[tuple[int, frozenset, frozenset]] = field(default_factory=list)  # family, word pairs, words that no other family has


def _own_words(family: str) -> set[str]:
    """Words of a family's templates that stand in no other family's."""
    words = {f: {w for t in ts for w in _WORD.findall(t)} for f, ts in TEMPLATES.items()}
    return words[family] - set().union(*(w for f, w in words.items() if f != family))


def _pairs(words: list[str]) -> frozenset:
    return frozenset(zip(["", *words], words, strict=False)) if words else frozenset()


def _examples(background: list[str], rng: np.random.Generator, copies: int) -> tuple[list[str], np.ndarray]:
    texts, labels = [], []
    around = [w for t in background[:400] for w in t.split()[:30]] or ["text"]
    for k, name in enumerate(FAMILIES):
        for template in TEMPLATES[name]:
            words = template.split()
            for i in range(copies):
                kept = [w for w in words if i == 0 or rng.random() > 0.08] or words
                before = rng.choice(around, rng.integers(0, 6)).tolist() if i % 2 else []
                after = rng.choice(around, rng.integers(0, 6)).tolist() if i % 3 == 1 else []
                texts.append(" ".join([*before, *kept, *after]))
                labels.append(k)
                if i % 2:  # the same words in disorder, or too few of them, say nothing
                    mixed = rng.permutation(words).tolist()
                    texts.append(" ".join(mixed[: max(1, len(mixed) // 2)] + rng.choice(around, 4).tolist()))
                    labels.append(UNKNOWN)
    for t in background:
        texts.append(t)
        labels.append(UNKNOWN)
    return texts, np.array(labels)


def _matrix(texts: list[str], vocabulary: T.Vocabulary | None):
    column = pa.array(texts)
    hashes, rows = [], []
    for c in T.chunks(column):
        words, at = _line_words(c)
        g, r = _grams(words, at)
        hashes.append(g)
        rows.append(r + c.lo)
    g, r = np.concatenate(hashes), np.concatenate(rows)
    if vocabulary is None:
        return g, r
    at, place = vocabulary.find(g)
    return r[at], place


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _logits(row, place, n, weights, bias):
    out = np.zeros((n, len(bias)))
    np.add.at(out, row, weights[place])
    return out + bias


def train(background: list[str], *, copies: int = 24, rounds: int = 150, seed: int = 1) -> Model:
    """Fit on the templates, with background paragraphs as unknown."""
    rng = np.random.default_rng(seed)
    known = T.Vocabulary(_matrix([t for ts in TEMPLATES.values() for t in ts], None)[0])
    own = [_pairs(_WORD.findall(t)) for ts in TEMPLATES.values() for t in ts]
    background = [t for t in background if not any(len(p & _pairs(_WORD.findall(t.lower()))) >= 0.6 * len(p) for p in own)]
    texts, y = _examples(background, rng, copies)
    held = np.arange(len(texts)) % 4 == 3
    row, place = _matrix(texts, known)
    classes = UNKNOWN + 1
    w, b = np.zeros((len(known.hashes), classes)), np.zeros(classes)
    goal = np.eye(classes)[y]
    fit = ~held
    state = [np.zeros_like(w), np.zeros_like(w)]
    use = fit[row]
    r, p = row[use], place[use]
    for t in range(1, rounds + 1):
        d = (_softmax(_logits(r, p, len(texts), w, b)) - goal) * fit[:, None] / fit.sum()
        g = np.zeros_like(w)
        np.add.at(g, p, d[r])
        g += 1e-5 * w
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        w -= 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        b -= 0.5 * d.sum(axis=0)
    z = _logits(row, place, len(texts), w, b)[held]
    truth = y[held]
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(losses, key=losses.get)
    prob = _softmax(z / temperature)
    wrong = prob[truth == UNKNOWN][:, :UNKNOWN].max(axis=1) if (truth == UNKNOWN).any() else np.zeros(1)
    least = float(np.clip(np.quantile(wrong, 0.995), 0.5, 0.9))
    templates = [(k, _pairs(_WORD.findall(t)), frozenset(_own_words(name) & set(_WORD.findall(t)))) for k, name in enumerate(FAMILIES) for t in TEMPLATES[name]]
    return Model(known.hashes, w, b, temperature, least, templates)


def background_sample(docs: DataFrame, *, sample: int = 2000, text: str = "text", doc_id: str = "doc_id") -> list[str]:
    """One window of words, as long as those that are scanned, of one paragraph of each of at most ``sample`` documents.

    Documents are taken in order of a hash of doc_id and text, paragraph and window by another, so the sample is the same in each run.
    """
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("body")).where(F.length(F.trim("body")) > 0)
    rows = rows.select("key", "body", F.xxhash64("key", "body", F.lit(1)).alias("place"), F.md5("body").alias("sum"))
    picked = rows.select("place", "key", "sum").orderBy("place", "key", "sum").limit(sample).distinct()
    picked = picked.select(F.col("place").alias("place2"), F.col("sum").alias("sum2"))
    rows = rows.join(F.broadcast(picked), (F.col("place") == F.col("place2")) & (F.col("sum") == F.col("sum2")))  # sample rows of 40 bytes
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = rows.select("place", lines.alias("lines")).where(F.size("lines") > 0)
    line = F.element_at("lines", (F.pmod(F.xxhash64("place", F.lit(3)), F.size("lines")) + 1).cast("int"))
    words = F.filter(F.split(line, r"\s+"), lambda x: (x != "") & (F.length(x) <= 100))  # no word of a notice is as long
    rows = rows.select("place", words.alias("words"))
    first = F.pmod(F.xxhash64("place", F.lit(4)), F.greatest(F.size("words") - LONG, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(F.array_join(F.slice("words", first, LONG), " ").alias("p")).distinct()
    return sorted(r.p for r in rows.collect() if r.p)


def scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", overlap: float = 0.6) -> DataFrame:
    """(doc_id, n_paragraphs, n_candidates, n_licences, families, best, probability) for each document.

    A candidate is a paragraph, or a window where none overlaps it, with a licence probability of at least model.least; a licence is
    a candidate that has at least ``overlap`` of the word pairs of a template of its family, and half of those of its words that no other family has.  The words of one notice count once for a
    family, however many windows hold them; a window that confirms a notice which no paragraph does is a candidate too.  families: those of the licences, in order of name, joined by commas; best
    and probability are those of the most probable licence, null if there is none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        vocabulary = T.Vocabulary(m.vocabulary)
        for b in batches:
            n = len(b)
            paragraphs, candidates, licences = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            found: dict[int, list[tuple[float, str]]] = {}
            for c in T.chunks(b.column(1)):
                if not len(c.data):
                    continue
                lines, row = _lines(c)
                words, at, ws, we = _spanned_words(lines)
                some = T.row_sums(~T.WHITE[c.data], lines) > 0
                paragraphs[c.lo : c.hi] = np.bincount(row[some], minlength=c.hi - c.lo)
                # runs of non-blank lines; those of one line that is scored itself need no windows
                starts = np.concatenate([[True], (row[1:] != row[:-1]) | ~some[:-1]])
                run_of = np.cumsum(starts) - 1
                per_line = np.diff(at)
                runs = np.concatenate([[0], np.cumsum(np.bincount(run_of, per_line).astype(np.int64))])
                run_row = row[starts]
                alone = (np.bincount(run_of, per_line > 0) <= 1) & (np.diff(runs) <= LONG)
                seen: dict[int, list[tuple[int, set[int], float]]] = {}  # confirmed notices by row: family, words, share of the template
                tried: dict[int, list[tuple[int, int]]] = {}  # words of candidates by row

                def judge(unit, place, begin, end, unit_row, window):
                    busy, back = np.unique(unit, return_inverse=True)
                    if not len(busy):
                        return
                    p = _softmax(_logits(back, place, len(busy), m.weights, m.bias) / m.temperature)
                    best = p[:, :UNKNOWN].argmax(axis=1)
                    top = p[np.arange(len(busy)), best]
                    for k in np.flatnonzero((top >= m.least) & (p[:, UNKNOWN] < top)):
                        lo, hi = int(begin[busy[k]]), int(end[busy[k]])
                        i, family = c.lo + int(unit_row[busy[k]]), int(best[k])
                        spoken = bytes(c.data[ws[lo] : we[hi - 1]]).decode("utf-8", "replace").lower()
                        spoken = _WORD.findall(spoken)
                        follow = list(zip(["", *spoken], spoken, strict=False))
                        pairs = frozenset(follow)
                        of = [t for f, t, own in m.templates if f == family and len(t & pairs) >= overlap * len(t) and 2 * len(own.intersection(spoken)) >= len(own)]
                        if of:
                            t = max(of, key=lambda t: len(t & pairs))
                            hits = [x for x, pair in enumerate(follow) if pair in t] if len(spoken) == hi - lo else range(hi - lo)
                            own, share = {lo + x for x in hits}, len(t & pairs) / len(t)
                            if window and any(_told(family, own, share, *x) for x in seen.get(i, ())):
                                continue
                            seen.setdefault(i, []).append((family, own, share))
                            licences[i] += 1
                            found.setdefault(i, []).append((float(top[k]), FAMILIES[family]))
                        elif window and any(x[0] < hi and lo < x[1] for x in tried.get(i, ())):
                            continue
                        tried.setdefault(i, []).append((lo, hi))
                        candidates[i] += 1

                grams, line, first, length = _placed_grams(words, at)
                hit, place = vocabulary.find(grams)
                line = line[hit]
                use = (np.bincount(line, minlength=len(row)) >= 3)[line] & (per_line <= LONG)[line]
                judge(line[use], place[use], at[:-1], at[1:], row, False)
                grams, of_run, first, length = _placed_grams(words, runs)
                hit, place = vocabulary.find(grams)
                keep = ~alone[of_run[hit]]
                hit, place = hit[keep], place[keep]
                for size in WINDOWS:
                    gram, window, begin, end, of_window = _windows(runs, of_run[hit], first[hit], length[hit], size)
                    enough = (np.bincount(window, minlength=len(begin)) >= 3) & (np.bincount(window, length[hit][gram] == 2, minlength=len(begin)) >= 2)
                    use = enough[window]
                    judge(window[use], place[gram[use]], begin, end, run_row[of_window], True)
            names = [",".join(sorted({x[1] for x in found[i]})) if i in found else "" for i in range(n)]
            best = [max(found[i]) if i in found else (None, None) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(paragraphs), pa.array(candidates), pa.array(licences), pa.array(names, pa.string()), pa.array([x[1] for x in best], pa.string()), pa.array([x[0] for x in best], pa.float64())],
                ["doc_id", "n_paragraphs", "n_candidates", "n_licences", "families", "best", "probability"],
            )

    schema = "doc_id long, n_paragraphs long, n_candidates long, n_licences long, families string, best string, probability double"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
