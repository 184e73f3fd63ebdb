"""Sharding, packing, near duplicates, passages and decontamination against brute force on small tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ashlar.llm import decontamination, packing, paragraphs, sharding, simhash
from ashlar.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp string, node long, hash long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(spark, texts):
    """A table with a null id, repeated rows and columns named like the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2, 3) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    near = []
    for t in base[:6]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    passage = words(rng, 60)
    carriers = [words(rng, 40) + ".\n" + passage + "\n" + words(rng, 40) for _ in range(3)]
    return base + near + carriers + [base[1], base[1], None, "", "  \n ", "one", "Über MASSE maß", "q" * 50_000, words(rng, 9000)]


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100), (None, 3), (7, 7)] + [(200 + i, 201 + i) for i in range(20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(300, [(a, b) for a, b in edges if a is not None])
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference_fingerprint(text):
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        data = data.replace(c, " ")
    w = [x for x in data.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_match_all_pairs(spark, texts):
    docs = corpus(spark, texts)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = [reference_fingerprint(t) for t in texts]
    want = components(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    for r in got:
        i = 0 if r.doc_id is None else r.doc_id
        assert (r.fingerprint, r.component_id) == (f"{fps[i]:016x}", want[i])
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_every_mask_set_finds_every_close_pair():
    rng = np.random.default_rng(0)
    for distinct in (100, 10**6, 10**9, 10**12):
        masks = simhash.block_masks(distinct)
        for _ in range(200):
            bits = rng.choice(64, 4, replace=False)
            difference = sum(1 << int(b) for b in bits)
            assert any(difference & m == 0 for m in masks)


def test_dense_bucket_links_equal_all_pairs(spark):
    from ashlar.llm.components import hamming, link_buckets

    rng = np.random.default_rng(2)
    nodes = np.unique(np.array([sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 9), replace=False)) for _ in range(150)]))
    members = spark.createDataFrame([(b, int(x)) for b in (0, 1) for x in nodes], "bucket long, node long")
    found = link_buckets(members, lambda x, y: hamming(F.col(f"node_{x}"), F.col(f"node_{y}")) <= 3, "dense")
    got = {r.node: r.component for r in found.collect()}
    want = components(len(nodes), [(i, j) for i in range(len(nodes)) for j in range(i) if bin(int(nodes[i]) ^ int(nodes[j])).count("1") <= 3])
    groups = {}
    for x, c in got.items():
        groups.setdefault(c, set()).add(x)
    expected = {}
    for i, c in enumerate(want):
        expected.setdefault(c, set()).add(int(nodes[i]))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_ring_is_balanced_gapless_and_follows_the_walk(spark, texts):
    docs = corpus(spark, texts)
    shards = 7
    got = sharding.bounded_ring(docs, shards).collect()
    n = docs.count()
    assert len(got) == n
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        t = (texts[0] if r.doc_id is None else texts[r.doc_id]) or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    # With room to spare nobody moves on: each key sits where plain consistent hashing puts it.
    wide = sharding.bounded_ring(docs, shards, load=float(shards)).collect()
    ring = sharding._ring(spark, shards, sharding.VIRTUAL_NODES)
    keys = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for r in wide:
        assert r.shard == next((s for p, s in ring if p >= keys[r.doc_id]), ring[0][1])
    assert sharding.bounded_ring(docs.limit(0), shards).count() == 0


def test_ring_cuts_crowded_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    docs = spark.range(120).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.bounded_ring(docs, 7).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 120 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_route_walks_clockwise():
    assert sharding.route([(0, 5), (2, 1)], [0, 1, 0], [2, 4]) == [(0, 0, 2, 0, 0), (0, 2, 3, 1, 0), (2, 0, 1, 1, 3)]
    with pytest.raises(ValueError):
        sharding.route([(0, 5)], [0], [4])


def test_packing_covers_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    texts = [*texts, "a  b\n\n c \t d", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "  <|endoftext|>  \n", "don't  stop now "]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = corpus(spark, texts)
    rows = packing.pack(docs, limit=64, group_docs=16).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    by_doc, by_sequence = {}, {}
    for r in rows:
        own = ids[0 if r.doc_id is None else r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in by_doc.items():
        copies = 2 if doc == 0 else 1
        total = len(ids[0 if doc is None else doc])
        assert sum(n for _, n in parts) == copies * total
        assert {x for s, n in parts for x in range(s, s + n)} == set(range(total))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(docs.limit(0)).count() == 0


def test_first_fit_matches_a_plain_scan():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = b
        room[b] -= sizes[i]
    assert (bins == want).all() and offsets.max() < 100


def brute_passages(texts, least):
    found = []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).split()
            if len(w) >= least:
                found.append((i, k, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}))
    edges = [(a, b) for a in range(len(found)) for b in range(a) if len(found[a][2] & found[b][2]) >= 0.8 * len(found[a][2] | found[b][2])]
    root = components(len(found), edges)
    groups = {}
    for x, r in enumerate(root):
        groups.setdefault(r, []).append(found[x][:2])
    return {p for g in groups.values() if len({d for d, _ in g}) > 1 for p in g}, {min(g) for g in groups.values()}


def test_repeated_passages_match_all_pairs(spark, texts):
    docs = corpus(spark, texts)
    got = paragraphs.repeated_passages(docs).where("doc_id IS NOT NULL").collect()
    want, _ = brute_passages([*texts, texts[0]], 20)
    assert {(r.doc_id, r.paragraph) for r in got} == {(d if d < len(texts) else 0, k) for d, k in want}
    firsts = [r for r in got if r.kept]
    assert all(r.component_id == r.doc_id for r in firsts)
    cleaned = paragraphs.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    left = {r.doc_id: r.text for r in cleaned.collect()}
    carriers = range(30, 33)
    assert [left[i].count("\n") for i in carriers] == [2, 1, 1]
    assert all(r.text.strip() for r in cleaned.collect()) and paragraphs.repeated_passages(docs.limit(0)).count() == 0


def test_dense_families_of_paragraphs_match_all_pairs(spark):
    """Copies that are each a few edits off: they share their buckets, and the links between them make chains."""
    rng = random.Random(12)
    family = [words(rng, 60).split()]
    for _ in range(120):
        w = list(rng.choice(family))
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        family.append(w)
    texts = [" ".join(w) for w in family]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, _ = brute_passages(texts, 20)
    got = paragraphs.repeated_passages(docs).collect()
    assert {(r.doc_id, r.paragraph) for r in got} == want
    shingles = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in family]
    root = components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])])
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, c in enumerate(root) if root.count(c) > 1}


def test_slices_hold_each_paragraphs_distinct_shingles():
    rng = random.Random(6)
    lines = [words(rng, n) for n in (1, 3, 5, 20, 21, 300)] + ["x y " * 40, "z " * 30]
    near = lines[5].replace(lines[5].split()[150], "changed", 1)
    own = paragraphs.Slice(["\n\n".join(lines), None, "", near], 1)
    want = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (x.split() for x in [*lines, near])]
    assert [x[0] for x in own.rows] == [0] * 8 + [3]
    assert [len(own.shingles(i)) for i in range(9)] == [len(w) for w in want]
    assert len(np.intersect1d(own.shingles(5), own.shingles(8))) == len(want[5] & want[8]) > 250
    maps = own.bitmaps()
    for i in range(9):
        for j in range(9):
            apart = np.unpackbits((maps[i] ^ maps[j]).view(np.uint8)).sum()
            assert apart <= len(want[i] ^ want[j])


def brute_contained(text, item):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in low).split()

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    w = split(item)
    n = min(5, len(w))
    a, b = runs(w, n) if n else set(), runs(split(text), n) if n else set()
    return (len(a), len(a & b)) if a and 5 * len(a & b) >= 4 * len(a) else None


def test_decontamination_matches_exact_containment(spark, texts):
    rng = random.Random(9)
    items = [words(rng, n) for n in (3, 5, 6, 14, 40, 70, 200)] + [None, "", "a b c d e", "One", "changed, changed!", "這是一個很長的句子"]
    leaked = []
    for t in items[1:7]:
        w = t.split()
        leaked.append(words(rng, 300) + " " + t.upper().replace(" ", ", ") + ". " + words(rng, 200))
        w[len(w) // 2] = "other"
        leaked.append(words(rng, 50) + " " + " ".join(w) + " " + words(rng, 50))
        leaked.append(words(rng, 30) + " " + " ".join(w[: len(w) // 2]) + " " + words(rng, 30))
    everything = [*texts, *leaked, items[0], words(rng, 30) + " " + items[0] + " x", items[0][:-1] + "q", "前 這是一個很長的句子 後", "one"]
    docs = corpus(spark, everything)
    bench = spark.createDataFrame([*[(i, t, "x") for i, t in enumerate(items)], (None, items[4], "x"), (4, items[4], "y")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_found) for r in decontamination.contaminated(docs, bench).collect()}
    want = {(d, i): f for d, t in enumerate(everything) for i, item in enumerate(items) if (f := brute_contained(t, item))}
    want |= {(d, None): f for (d, i), f in want.items() if i == 4}
    assert got == want and len(got) >= 10
    kept = {r.doc_id for r in decontamination.without_benchmark(docs, bench).collect()}
    assert kept == ({*range(len(everything)), None} - {d for d, _ in want})
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 == decontamination.contaminated(docs.limit(0), bench).count()
