"""Language, quality, tokens, decontamination and licences against plain versions on small inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.core.broadcast import Broadcast

from veilspark.llm import decontaminate, language, licenses, quality, tokens

WORDS = {"en": "the and of that with this from have which their".split(), "fr": "le la les des une dans pour avec qui sur".split(), "ru": "это что как для они был его все так уже".split()}


def text_of(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n)).capitalize() + "."


def plain_phrases(reference, text):
    """Greedy parse of a whole folded text into the longest phrases of the reference."""
    count = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in reference:
            j += 1
        i = max(i + 1, j - 1)
        count += 1
    return count


def fold(text):
    return "".join(chr(c) if c else " " for c in language.letters([text])[0])


@pytest.mark.parametrize("options", [{}, {"dense": 0}, {"together": 1}])
def test_cross_parsing_matches_a_plain_parse(options, monkeypatch):
    rng = random.Random(4)
    samples = {k: [text_of(rng, k, 80)] for k in WORDS} | {"zh": ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(1200))]}
    model = language.Model(samples, **options)
    texts = [text_of(rng, rng.choice(list(WORDS)), n) for n in (1, 5, 40, 700)] + ["", None, "123 !!", "Ünß 9 x", "日本 the " * 30, samples["fr"][0] * 5, samples["zh"][0] * 3]
    for block in (1000, 7, 1):
        monkeypatch.setattr(language, "BLOCK", block)
        counts, size, letters = model.parse(texts)
        for k, name in enumerate(model.names):
            reference = fold(samples[name][0])
            assert [plain_phrases(reference, fold(t)) for t in texts] == counts[k].tolist()
    names, scores = model.predict(texts)
    assert names[4:7] == ["und"] * 3 and (scores >= 0).all() and (scores <= 1).all()
    assert letters[6] == 0 and names[10] == "zh"


def test_any_number_of_languages():
    rng = random.Random(6)
    alphabets = {f"l{i:03}": [chr(0x3400 + 12 * i + j) for j in range(12)] for i in range(300)}
    model = language.Model({k: ["".join(rng.choice(v) for _ in range(200))] for k, v in alphabets.items()})
    texts = ["".join(rng.choice(v) for _ in range(30)) for v in alphabets.values()]
    assert model.predict(texts)[0] == list(alphabets)


def test_ties_repeated_rows_and_a_very_long_text():
    text = "abc abd " * 20
    model = language.Model({"b": [text], "a": [text], "c": ["xyz" * 50]})
    names, scores = model.predict([text, text, text * 40_000])
    assert names == ["a"] * 3 and scores[0] == scores[1] and abs(scores[0] - 0.5) < 1e-6


def test_languages_are_found_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, k, rng.randrange(5, 60)), k) for i, k in enumerate(rng.choices(list(WORDS), k=300))] + [(900, None, "en"), (901, "", None), (None, "the and of", None), (902, "42", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    out = {r.doc_id: r for r in language.identify_documents(spark, df).collect()}
    assert len(out) == len(rows)
    for i, _, k in rows[:300]:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and out[i].lang_pred == k
    assert out[900].lang_pred == out[901].lang_pred == out[902].lang_pred == "und"
    assert language.identify_documents(spark, df.limit(0)).count() == 0


def brute_marginals(unary, trans):
    n, z, p = len(unary), 0.0, np.zeros(len(unary))
    for mask in range(1 << n):
        y = [(mask >> i) & 1 for i in range(n)]
        w = np.exp(sum(unary[i] / 2 * (1 if y[i] else -1) for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        z, p = z + w, p + w * np.array(y)
    return p / z


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    sizes, trans = [5, 1, 8, 3], rng.normal(size=(2, 2))
    unary, owner = rng.normal(size=sum(sizes)), np.repeat(np.arange(4), sizes)
    p, _ = quality.marginals(unary, owner, trans)
    want = np.concatenate([brute_marginals(unary[owner == k], trans) for k in range(4)])
    assert np.allclose(p, want)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    good = lambda: "\n".join(text_of(rng, "en", rng.randrange(4, 25)) for _ in range(rng.randrange(1, 6)))
    bad = [lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", "### "), lambda: " ".join([rng.choice(WORDS["en"])] * 60), lambda: good().replace(" ", " | ")]
    rows, labels = [], []
    for i in range(400):
        q = int(rng.random() < 0.7)
        rows.append((i, good() if q else rng.choice(bad)()))
        labels.append((i, q))
    rows += [(900, None), (901, ""), (902, " \n "), (None, "the end of it")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as quality"), spark.createDataFrame([*labels, (5, 1 - labels[5][1]), (7, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score_documents(spark, docs, known).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) == len(rows) and all(out[i].held_out for i in held)
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.95
    assert out[900].score == out[901].score == out[902].score
    assert quality.keep_good(spark, docs, known).columns == docs.columns
    assert quality.score_documents(spark, docs.limit(0), known).count() == 0
    assert {r.score for r in quality.score_documents(spark, docs, known.limit(0)).collect()} == {0.5}


def test_capped_sample_keeps_the_balance_of_all_labels(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(text_of(rng, "en", 12) for _ in range(3)), int(i % 8 > 0)) for i in range(1600)]  # texts say nothing of the label
    rows[3:6] = [(3, "long " * 2000, 1), (4, None, 1), (5, "", 1)]
    docs, known = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows] + [(i, 0) for i in range(5000, 5400)], "doc_id long, quality int")
    whole, capped = quality.fit(spark, docs, known), quality.fit(spark, docs, known, documents=150)
    assert whole.prior == capped.prior == 0.875
    texts = [t for _, t, _ in rows if t]
    assert abs(whole.score(texts).mean() - 0.875) < 0.01 and abs(capped.score(texts).mean() - 0.875) < 0.05
    assert capped.score(["", None, " \n"]).tolist() == [0.875] * 3


@pytest.mark.parametrize("rule", ["first", "last", "most", "split"])
def test_tokens_against_a_character_walk(rule):
    encoder, rng = tokens.Encoder.of(tokens.VOCABULARY), random.Random(6)
    for text in ["Hello wörld, 漢字 and 😀😀\n\nnext  line\n", "a" * 50, text_of(rng, "ru", 30)]:
        start, end = encoder.spans(text)
        assert start[0] == 0 and end[-1] == len(text) and (np.diff(start) >= 0).all()
        cuts = sorted(rng.sample(range(len(text)), 6))
        sections = np.array([(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[3], cuts[5])])
        owner = {c: k for k, (a, b) in enumerate(sections) for c in range(a, b)}
        want = np.zeros(4)
        for a, b in zip(start, end, strict=True):
            held = [owner.get(c, 3) for c in range(a, b)]
            if rule == "split":
                for k in held:
                    want[k] += 1 / len(held)
            else:
                want[held[0] if rule == "first" else held[-1] if rule == "last" else max(dict.fromkeys(sorted(held, key=lambda k: (k == 3, k))), key=held.count)] += 1
        got, _ = tokens.attribute(start, end, sections, rule)
        assert np.isclose(got.sum(), len(start))
        if rule != "most":
            assert np.allclose(got, want)


def test_token_rows(spark):
    rows = [(1, "one line\nand two\n"), (2, ""), (3, None), (None, "x"), (1, "one line\nand two\n")]
    out = tokens.count_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.section) for r in out) == [(0, 0), (1, 0), (1, 0), (1, 1), (1, 1), (2, -1), (3, -1)]
    assert sum(r.tokens for r in out if r.doc_id == 1) == 2 * len(tokens.Encoder.of(tokens.VOCABULARY).spans(rows[0][1])[0])


def edits(pattern, text):
    """Least edit distance of a pattern to any substring, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_finds_every_passage_within_the_budget(spark):
    rng = random.Random(9)
    items = [(k, text_of(rng, "en", 14)) for k in range(12)] + [(50, None), (51, " "), (52, "tiny")]
    docs = []
    for i in range(60):
        text = text_of(rng, "fr", rng.randrange(0, 40))
        if i % 2:
            passage = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, 7)):
                j = rng.randrange(len(passage))
                passage[j] = rng.choice(["", "z", passage[j] + "q"])
            text += "\n " + "".join(passage).upper() + "  tail"
        docs.append((i, text))
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, items[3][1]), (92, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.distance) for r in decontaminate.find_leaks(spark, d, b).collect())
    want = []
    for i, t in docs:
        for k, item in items:
            p = decontaminate.normal(item)
            if p and t and (e := edits(p, decontaminate.normal(t))) <= int(0.05 * len(p)):
                want.append((i if i is not None else -1, k, e))
    assert got == sorted(want) and len({w[2] for w in want}) > 2
    kept = decontaminate.drop_leaks(spark, d, b)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {w[0] for w in want if w[0] >= 0} - {None}
    assert decontaminate.find_leaks(spark, d, b.limit(0)).count() == 0 and decontaminate.find_leaks(spark, d.limit(0), b).count() == 0


def test_decontamination_searches_every_block_in_reused_workers(spark, monkeypatch):
    rng, whole, cast, sent = random.Random(12), decontaminate.item_blocks, spark.sparkContext.broadcast, []
    monkeypatch.setattr(decontaminate, "item_blocks", lambda benchmark: whole(benchmark, characters=50))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(cast(value)) or sent[-1])
    items = [(k, f"{k} " + text_of(rng, "en", 14)) for k in range(20)]
    texts = {k: f"{text_of(rng, 'fr', 5)} {t}" for k, t in items}
    d, b = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.find_leaks(spark, d, b, 0.0)
    assert len(sent) == len(items)
    found = set()
    for held in sent:  # one worker: each block is loaded after the last one is freed, often to the same address
        matcher = decontaminate._matcher(Broadcast(path=held._path), 0.0)
        found |= {(k, hit[0]) for k, t in texts.items() for hit in matcher.search(decontaminate.normal(t))}
    assert found == {(k, k) for k, _ in items} == {(r.doc_id, r.item_id) for r in leaks.collect()}
    assert decontaminate._matcher(sent[0], 0.05).items[0][2] == int(0.05 * len(decontaminate.normal(items[0][1]))) > 0 == decontaminate._matcher(sent[0], 0.0).items[0][2]


def test_licences_and_inheritance(spark):
    rows = [(1, "a/b/x.txt", "code\nReleased under the MIT License.\nmore words here to fill the file with code and code"), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/y.txt", "nothing"), (4, "z/q.txt", "nothing"), (5, None, None), (6, "a/w.txt", ""), (7, "a/b/v.txt", "All rights reserved."), (8, "a/b/d/u.txt", "my licence to kill words that match nothing at all here")]
    out = {r.doc_id: r for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(out) == len(rows)
    assert {i: (out[i].license, out[i].origin) for i in out} == {1: ("MIT", "header"), 2: ("Apache-2.0", "file"), 3: ("Proprietary", "a/b"), 4: (None, None), 5: (None, None), 6: ("Apache-2.0", "a"), 7: ("Proprietary", "header"), 8: ("Proprietary", "a/b")}


def brute_licence(scorer, lines):
    """Every window of every line against every header template, by plain TF-IDF vectors."""
    best = None
    for line in lines:
        found = licenses.terms(line)
        for name, text in licenses.HEADERS:
            model = licenses.terms(text)
            for i in range(max(1, len(found) - len(model) + 1)):
                part = found[i : i + len(model)]
                w = {t: part.count(t) * scorer.idf.get(t, scorer.other) for t in part}
                v = {t: model.count(t) * scorer.idf[t] for t in model}
                norm = (sum(x * x for x in w.values()) * sum(x * x for x in v.values())) ** 0.5
                c = sum(w[t] * v[t] for t in w if t in v) / norm if norm else 0
                if c >= scorer.least and (best is None or (-round(c, 9), name) < (-round(best[0], 9), best[1])):
                    best = (c, name)
    return best


def test_header_windows_match_brute_force(spark):
    rng = random.Random(7)
    filler = "the of this is to any work terms public version general free copy under and software".split() + [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 25))]
        if rng.random() < 0.6:
            model = rng.choice(licenses.HEADERS)[1].split()
            model = [w for w in model if rng.random() < 0.85]
            at = rng.randrange(len(words) + 1)
            words[at:at] = model
        texts.append(" ".join(words))
    files = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    n, df = licenses.line_counts(files)
    assert n == sum(bool(licenses.terms(t)) for t in texts) and all(df.get(v, 0) == sum(v in licenses.terms(t) for t in texts) for v in licenses.VOCABULARY)
    scorer = licenses.Scorer(n, df, 0.6)
    out = {r.doc_id: r for r in licenses.scan_licenses(spark, files).collect()}
    for i, t in enumerate(texts):
        want = brute_licence(scorer, [t])
        assert (out[i].own, out[i].cosine) == ((want[1], pytest.approx(want[0], abs=2e-6)) if want else (None, None)), t


def test_usual_headers_and_licence_files(spark):
    mit = dict(licenses.FULL)["MIT"]
    rows = [(1, "p/a.py", "SPDX-License-Identifier: Apache-2.0"), (2, "p/b.py", "// This project is licensed under the MIT License - see the LICENSE file for details"), (3, "q/LICENSE", mit), (4, "q/r/s/t.c", "int x;"), (5, "q/COPYING.txt", None)]
    rows += [(6, "r/c.py", "Copyright (c) 2020 Jane Doe. All rights reserved."), (7, "r/d.py", "x " * 300_000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software" + " y" * 9)]
    rows += [(None, "r/e.py", None), (8, "r/f.py", "All rights reserved."), (1, None, "a"), (1, "a", None), (1, None, "a")]
    df = spark.createDataFrame([(*r, "own", 1.0) for r in rows], "doc_id long, path string, text string, license string, cosine double")
    out = licenses.scan_licenses(spark, df).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.path): (r.license, r.origin) for r in out}
    assert got[1, "p/a.py"] == ("Apache-2.0", "header") and got[2, "p/b.py"][0] == "MIT" and got[3, "q/LICENSE"] == ("MIT", "file")
    assert got[4, "q/r/s/t.c"] == got[5, "q/COPYING.txt"] == ("MIT", "q")
    assert got[6, "r/c.py"] == ("Proprietary", "header") and got[7, "r/d.py"] == ("MIT", "header")
    assert got[None, "r/e.py"] == ("Proprietary", "r") and got[1, None] == (None, None)
    assert licenses.scan_licenses(spark, df.limit(0)).count() == 0
