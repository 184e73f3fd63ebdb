"""Chat formatting, license scans, line rules, language and quality against plain versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ashlar.llm import catalog, chat, language, licenses, line_rules, quality
from ashlar.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_folding_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, "message", "m0", "user", "hi"), (1, 1, "message", "m1", "assistant", ""), (1, 2, "delta", "m1", None, "wro"), (1, 3, "delta", "m1", None, "ng"), (1, 4, "message", "m2", "user", "dropped"),
        (1, 5, "regenerate", "m1", None, None), (1, 6, "delta", "m1", None, "ri"), (1, 7, "delta", "m1", None, "ght"), (1, 8, "message", "m3", "user", "thanks"), (1, 9, "edit", "m0", None, "hello"), (1, 10, "delete", "m9", "user", "x"),
        (2, 0, None, "a", "system", None),
    ]
    random.Random(0).shuffle(events)
    got = [tuple(r) for r in chat.fold_events(spark.createDataFrame(events, "conv_id long, seq long, kind string, msg string, role string, text string").repartition(3)).orderBy("conv_id", "seq").collect()]
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "right"), (1, 8, "user", "thanks"), (2, 0, "system", "")]


def test_rendering_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>\n", "<|im_sep|>\\", "a\n", "", None, "[INST][/INST]<<SYS>><</SYS>><s>", "é\U0001f600<|im_end|>", "$1\\$2", "assistant"]
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["user", "assistant", None, "as<|im_end|>\n", "assistant"] * 3, nasty[c:] + nasty[:c], strict=False))]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "assistant", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).repartition(3)
    rendered = chat.render(chat.fold_events(chat.conversation_events(table)))
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    spans = {r.conv_id: r for r in rendered.collect()}
    for conv in {r[0] for r in rows}:
        mine = [(role or "", text or "") for c, t, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        loss = "".join(t for r, t in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = spans[conv].formatted
        assert r.formatted_chars == len(whole)
        own = [whole[s.start : s.start + s.length] for s in spans[conv].loss_spans]
        assert "".join(re.sub(r"\\(\\?)", r"\1", x) for x in own) == loss
        assert not any(c in x for x in own for c in ("</s>", "[INST]", "<|im_end|>"))
    assert chat.read_back(chat.render(table.limit(0).withColumnRenamed("turn", "seq"))).count() == 0


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    padded = " " + " ".join(words) + " "
    hits = []
    for r in licenses.rules():
        if r["keyword"] in padded:
            hits += [(padded[: m.start()].count(" ") - 1, padded[: m.end()].count(" "), r["priority"], r["rule"], r["label"]) for m in re.finditer(r["pattern"], padded)]
    order = lambda h: (h[0], -h[1], h[2], h[3])
    left = [h for h in hits if not any(g is not h and order(g) < order(h) and g[1] >= h[1] and g[2] <= h[2] for g in hits)]
    labels = sorted({x for _, x in base} | {h[4] for h in left})
    return len(words), len(base), base[0][0] if base else None, max(i for i, _ in base) if base else None, ",".join(sorted({x for _, x in base})), ",".join(labels)


def test_license_scan_matches_plain_scan(spark):
    texts = [
        None, "", "...", "CC BY 4.0 cc by cc-by", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3. General public license", "All rights reserved. all rights reserved", "This is MIT licensed; see the GNU Lesser General Public License v2.1",
        "cc" + "é" + "by cc by", "redistribution and use in source and binary forms, with or without modification, are permitted", "creative commons attribution-sharealike 4.0 international CC0 1.0", "x " * 5000 + "Mozilla Public License 2.0", "K CC BY cc.by",
    ]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, "l", 0) for i, t in enumerate(texts)] + [(None, texts[3], "l", 0)], "doc_id long, text string, labels string, row int")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert len(got) == len(texts) + 1 and len(licenses.rules()) >= 200
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain_scan(t), t
        assert 0 <= r.score <= 1
    assert got[None].labels == got[3].labels and licenses.license_scan(docs.limit(0)).count() == 0


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_line_rules_match_plain_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c d e " * 8, "x y z a b x y z a b x y z a b", "w w v one\x1ctwo", "same line here\nsame line here\n\n\nsame line here"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(None, texts[3], True)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, chars, symbols, twice, again = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, twice, again), t
        assert r.base_failed == (n < 10 or 100 * again > 20 * n) and not (r.base_failed and r.kept)
    assert line_rules.line_rules(docs.limit(0)).count() == 0


def test_line_faults():
    assert line_rules.line_fault("Home | About | Contact | Login") == "navigation"
    assert line_rules.line_fault("We use cookies to improve this page.") == "boilerplate"
    assert line_rules.line_fault("one*** two### three$$$ four%%% five&&& six***") == "symbols"
    assert line_rules.line_fault("spam " * 20) == "repetition"
    assert line_rules.line_fault("this line just stops in the middle of a") == "punctuation"
    assert line_rules.line_fault("A sound sentence of nine words ends right here.") is None
    assert line_rules.line_fault("A heading") is None


def plain_verdict(text):
    """Which lines go and whether the document stays, stated rule by rule over words and characters."""
    lines = (text or "").split("\n")
    blank = [not re.search(r"[^\x20\x09-\x0D]", x) for x in lines]
    ended = [bool(re.search(r"[.!?:;…。！？।][\"'»”’)\] \t\r]*$", x.strip(" \t\n\x0b\x0c\r"))) for x in lines]
    solid = [i for i in range(len(lines)) if not blank[i]]
    short = [not ended[i] and len(lines[i].split()) <= 3 for i in solid]
    menu, k = set(), 0
    while k < len(solid):
        j = k
        while j < len(solid) and short[j]:
            j += 1
        if j - k >= 6:
            menu |= set(solid[k:j])
        k = max(j, k + 1)
    gone = set()
    for i in solid:
        x, w = lines[i], lines[i].split()
        links = sum(len(m) for m in re.findall(r"(?:https?://|www\.)\S+", x))
        bars = sum(c in "|»›•·" for c in x)
        low = x.lower()
        faults = [
            i in menu, links and 2 * links >= len(x.strip()), bars >= 3 and 4 * bars >= len(w), len(w) <= 3 and low.strip(" .!>»") in line_rules.NAVIGATION, len(w) <= 16 and any(b in low for b in line_rules.BOILERPLATE),
            len(w) >= 5 and sum(c in "#*$%&|<>!" for c in x) > len(w) and 2 * len(re.findall(r"[#*$%&|<>!]{2,}(?:\s|$)", x)) > len(w), len(w) >= 10 and 4 * len(set(w)) < len(w), len(w) >= 8 and not re.search(r"[.!?:;…。！？।][\"'»”’)\] \t\r]*$", x),
        ]
        if w and any(faults):
            gone.add(i)
    n, _, _, _, again = plain_counts(text)
    lost = sum(len(lines[i]) for i in gone)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), n >= 10 and 100 * again <= 20 * n and 2 * lost <= sum(map(len, lines)), len(gone)


def test_line_verdicts_match_plain_rules(spark):
    sound = "A sound sentence of nine words ends right here."
    texts = [None, "", "\n".join(["Startseite", "Produkte", "Über uns", "", "Kontakt", "Hilfe", "Karte", sound, sound.lower()]), f"{sound}\nhttps://a.example/b www.c.example\nWir verwenden Cookies\nTodos los derechos reservados 2020\n{sound} x."]
    texts += ["Home | News | Help | Login\n" + sound, "buy!! now!! cheap!! pills!! here!!\n" + sound * 2, "one\ntwo\nthree\nfour\nfive\n" + sound + " " + sound, "this line stops in the middle of a long\n" + sound]
    texts += [r.text for name in ("sf0.001",) for r in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    for i, t in enumerate(texts):
        text, kept, n = plain_verdict(t)
        assert (got[i].cleaned_text, got[i].kept, got[i].n_lines_removed) == (text, kept, n), t
    assert got[2].n_lines_removed == 6 and got[3].n_lines_removed == 3


def test_normal_equations_equal_one_dense_solve(spark):
    """The matrices summed by partition, and the ridge weights, against numpy over all rows; clashing columns and repeated rows."""
    rng = np.random.default_rng(4)
    stats = rng.normal(2, 3, (90, len(quality.NAMES)))
    stats[:30] = stats[30:60]
    y = (stats[:, 0] > 2).astype(float)
    rows = spark.createDataFrame([(int(i % 2), s.tolist(), float(v), "x") for i, (s, v) in enumerate(zip(stats, y, strict=True))], "part int, stats array<double>, y double, score string").repartition(7)
    fourier = quality.Fourier(stats.mean(0), stats.std(0))
    sums = quality.normal_equations(rows, fourier)
    x = fourier(stats)
    for part in (0, 1):
        own = np.hstack([x[part::2], y[part::2, None]])
        assert np.allclose(sums[part], own.T @ own)
    n = len(x)
    hold = np.diag([quality.RIDGE * n] * (x.shape[1] - 1) + [1e-9 * n])
    assert np.allclose(quality.ridge(sums[0] + sums[1]), np.linalg.solve(x.T @ x + hold, x.T @ y), atol=1e-6)


def test_scores_do_not_read_other_columns(spark):
    rows = [(i, f"word{i % 7} " * (5 + i), "en", float(i), 1) for i in range(60)] + [(3, "word3 " * 8, "de", 0.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, quality int")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)], "doc_id long, quality int, score int")
    first = {(r.doc_id, r.score) for r in quality.score_quality(docs, labels).collect()}
    second = {(r.doc_id, r.score) for r in quality.score_quality(docs.select("doc_id", "text"), labels).collect()}
    assert len(first) == 60 and {(i, round(s, 9)) for i, s in first} == {(i, round(s, 9)) for i, s in second}


def test_network_gradient_is_right():
    network = language.Network(["a", "b", "c"], hidden=4, embed=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    codes, lengths = language._matrix([b"abc", b"\xc3\xa9", b"zzzzz"])
    wanted = np.array([0, 2, 1])
    _, grads = network.step(codes, lengths, wanted)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in g.shape)
            if name == "embed":
                at = (int(rng.choice([97, 122, 0xC3])), at[1])
            keep = network.p[name][at]
            losses = []
            for d in (1e-4, -1e-4):
                network.p[name][at] = keep + d
                losses.append(network.step(codes, lengths, wanted)[0])
            network.p[name][at] = keep
            assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 1e-3, name


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    network = language.train(docs)
    got = language.identify(docs, network).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).where("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 100
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "123 --- 456", 1.0), (3, "x" * 9000, 1.0), (3, "x" * 9000, 1.0)], "doc_id long, text string, score double")
    rows = language.identify(odd, network).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[3] == rows[4] and all(0 <= r.score <= 1 for r in rows)
    assert language.train(docs.limit(0)) is None
    assert [r.lang_pred for r in language.identify(odd, None).collect()] == ["und"] * 5
    assert language.identify(odd.limit(0), network).count() == 0


def test_pooled_scores_match_a_plain_loop_over_positions():
    """Every byte of the whole text is labelled once, by states that run on over words."""
    network = language.Network(["a", "b", "c"], hidden=5, embed=4)
    p, h_size = network.p, network.hidden
    rng = random.Random(2)
    texts = ["one two  three", "Two\nTHREE", "été 語り " * 60, "w" * 1000, "x", " ".join("".join(rng.choice("abcdé ") for _ in range(9)) for _ in range(80)), None, "²½①", "12 34"]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(data, s):
        h, out = np.zeros(h_size), []
        for c in data:
            x = p["embed"][c] @ p[f"w{s}"] + p[f"c{s}"]
            r_h = h @ p[f"u{s}"]
            z, r = sigmoid(x[:h_size] + r_h[:h_size]), sigmoid(x[h_size : 2 * h_size] + r_h[h_size : 2 * h_size])
            new = np.tanh(x[2 * h_size :] + r * r_h[2 * h_size :])
            h = new + z * (h - new)
            out.append(h)
        return out

    names, scores = language.Labeller(network).label(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not any(map(str.isalpha, text or "")):
            assert (name, score) == ("und", 0.0)
            continue
        data, total, n = language.content(text), np.zeros(3), 0
        for first, start, stop, last in language.windows(data):
            own = data[first:last]
            own.decode()
            for t, (f, b) in enumerate(zip(states(own, "f"), states(own[::-1], "b")[::-1], strict=True)):
                if start <= first + t < stop:
                    logits = np.concatenate([f, b]) @ p["out"] + p["bias"]
                    total += logits - np.log(np.exp(logits).sum())
                    n += 1
        assert n == len(data)
        chances = np.exp(total / n) / np.exp(total / n).sum()
        assert name == "abc"[int(chances.argmax())] and abs(score - chances.max()) < 1e-4


def test_labels_do_not_depend_on_the_company():
    network = language.Network(["a", "b"])
    texts = ["one two three", "Two THREE", "été " * 300, "w" * 700]
    together = language.Labeller(network).label(texts)
    for i, t in enumerate(texts):
        name, score = language.Labeller(network).label([t])
        assert name[0] == together[0][i] and abs(score[0] - together[1][i]) < 1e-5


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "z" * 30_000)], "doc_id long, text string")
    rows = quality.score_quality(docs.select("doc_id", "text").union(extra), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()}
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count() + 3
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert {r.score for r in quality.score_quality(extra, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_isotonic_is_the_closest_rising_sequence():
    assert quality.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    assert quality.isotonic(np.array([3.0, 2, 1]), np.array([1.0, 1, 2])).tolist() == [1.75] * 3


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline_on_planted_cases_and_clashing_columns(spark):
    """Exact and near copies go, a passage in mid-line stays once, leaked items go, clean documents stay as they are."""
    rng = random.Random(21)
    pool = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND n_chars > 1500").select("text").limit(60).collect()]
    vocabulary = sorted({w for t in pool for w in t.split() if w.isalpha()})
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").limit(2).collect()]
    clean = [prose(200) for _ in range(8)]
    passage = prose(70)
    copy = clean[0].split()
    near = " ".join([*copy[:100], "different", *copy[101:]])
    carriers = [f"{prose(60)} {passage} {prose(40)}" for _ in range(3)]
    leaked = [f"{prose(80)} {items[0]} {prose(50)}"]
    texts = [*clean, clean[1], clean[1], *carriers, *leaked, near]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, 3, "g") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int, _doc int, _hash int, _own int, _gone string").repartition(3)
    trained = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = trained.where("doc_id > 100").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars"), F.lit(1).alias("_doc"), F.lit(2).alias("_hash"), F.lit(3).alias("_own"), F.lit("g").alias("_gone"))
    now = docs.unionByName(more)
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, SF), "planted")
        assert now.columns == docs.columns
    left = {r.doc_id: r.text for r in now.where("doc_id < 1000").collect()}
    assert {i: left.get(i) for i in range(8)} == dict(enumerate(clean))
    assert not {8, 9, 13, 14} & set(left)
    assert [passage in left[i] for i in (10, 11, 12)] == [True, False, False]
    assert left[10] == carriers[0] and all(len(left[i].split()) == 100 for i in (11, 12))
    assert now.select("_doc", "_gone").distinct().count() == 1


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5), (None, docs.first().text, "en", "s", 1)], docs.schema)
    now = docs.union(odd)
    counts = [now.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, SF), "test")
        assert now.columns == docs.columns, name
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[0] - 3 and counts[-1] < counts[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0
