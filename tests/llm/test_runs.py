"""Verbatim runs across line breaks, hard-wrapped paragraphs and scripts without spaces."""

import random

import pytest

from ashlar.llm import paragraphs, runs


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def wrapped(w, width):
    return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))


def brute(texts):
    """Word places in windows of 51 words that other documents hold, and those that an earlier one holds."""
    tokens = [[w.decode() for w in runs.split_words((t or "").encode().lower())] for t in texts]
    at = {}
    for d, w in enumerate(tokens):
        for i in range(len(w) - 50):
            at.setdefault(tuple(w[i : i + 51]), set()).add(d)
    repeated, gone = set(), set()
    for d, w in enumerate(tokens):
        for i in range(len(w) - 50):
            held = at[tuple(w[i : i + 51])]
            places = {(d, k) for k in range(i, i + 51)}
            if len(held) > 1:
                repeated |= places
                if min(held) < d:
                    gone |= places
    return repeated, gone


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    p, exact, short = words(rng, 70), words(rng, 51), words(rng, 50)
    out = [" ".join(words(rng, 150) + p + words(rng, 90)), wrapped(words(rng, 33) + p + words(rng, 20), 9), " ".join(words(rng, 200) + [x.upper() for x in p[10:]])]
    out += [" ".join(words(rng, 60) + exact + words(rng, 60)), wrapped(words(rng, 7) + exact + words(rng, 80), 30)]
    out += [" ".join(words(rng, 60) + short + words(rng, 60)), " ".join(words(rng, 70) + short + words(rng, 60))]
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80))
    out += [han + "abc", "x" * 4 + " " + han[5:62]]
    loop = words(rng, 5) * 30
    return [*out, " ".join(loop), wrapped(loop[2:], 11), None, "", "one"]


def test_runs_match_every_window(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = runs.repeated_runs(docs).collect()
    repeated, gone = brute(texts)
    span = lambda rows: {(r.doc_id, k) for r in rows for k in range(r.first_word, r.first_word + r.n_words)}
    assert span(got) == repeated and span(r for r in got if not r.kept) == gone
    assert {d for d, _ in repeated} == {0, 1, 2, 3, 4, 7, 8, 9, 10}
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()}
    for d, t in enumerate(texts[:9]):
        w = runs.split_words(t.encode())
        assert runs.split_words(left[d].encode()) == [x for k, x in enumerate(w) if (d, k) not in gone]
    assert left[0] == texts[0] and runs.repeated_runs(docs.limit(0)).count() == 0


def test_hard_wrapped_near_copies_are_one_paragraph(spark):
    rng = random.Random(3)
    p = words(rng, 100)
    near = [*p[:30], "changed", *p[31:60], "other", *p[61:]]
    docs = spark.createDataFrame([(1, "Head\n\n" + wrapped(p, 10) + "\n\nend"), (2, wrapped(near, 8))], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph, r.n_lines, r.n_words, r.first_word, r.kept) for r in paragraphs.repeated_passages(docs).collect()}
    assert got == {(1, 2, 10, 100, 1, True), (2, 0, 13, 100, 0, False)}
    assert [r.text for r in paragraphs.remove_repeats(docs).collect()] == ["Head\n\n" + wrapped(p, 10) + "\n\nend"]


def test_components_of_one_document_differ(spark):
    rng = random.Random(4)
    p, q = (" ".join(words(rng, 30)) for _ in range(2))
    docs = spark.createDataFrame([(1, f"{p}\n{q}"), (2, p), (3, q), (None, "a " + p), (None, "b " + q)], "doc_id long, text string")
    name = lambda r: (r.component_id, r.component_text, r.component_paragraph, r.component_word)
    rows = paragraphs.repeated_passages(docs).collect()
    assert {r.doc_id: (r.component_id, r.component_paragraph, r.component_word) for r in rows if r.doc_id in (2, 3)} == {2: (1, 0, 0), 3: (1, 1, 30)}
    assert len({name(r) for r in rows}) == 2 and len(rows) == 6
    anonymous = paragraphs.repeated_passages(spark.createDataFrame([(None, x + t) for t in (p, q) for x in ("a ", "b ")], "doc_id long, text string")).collect()
    assert len({name(r) for r in anonymous}) == 2 and len(anonymous) == 4
