"""Near-duplicate passages: paragraph MinHash bands, exact Jaccard checks, components, removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import discard, free_shuffles, spare, stage, table
from .components import hamming, link_buckets, sorted_join
from .runs import cut_words, repeated_runs, split_words

SHINGLE, SIMILARITY = 5, 0.8
#: Paragraphs with fewer words are left alone: headings, slogans and set phrases repeat in sound texts.
LEAST_WORDS = 20
#: 64-bit words of the parity bitmap that rules out most pairs without reading their shingles.
BITMAP = 4
#: Documents that a worker turns into paragraphs before it hands their rows on.
SLICE = 256
#: Ids of documents to read again are broadcast up to this many (some 64 bytes each), else joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Bands of two values each: at similarity 0.8 a pair meets in one of 12 bands but for (1 - 0.64) ** 12 = 0.000005.
BANDS, ROWS = 12, 2
_SEED = 42
_BASE = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(20240117).integers(0, 1 << 63, (2, BANDS * ROWS), np.int64).view(np.uint64)
_FACTOR, _SHIFT = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def units(text: str | None, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(first line, lines, first word, words) of the paragraphs of a text that have enough words.

    A line with enough words is one, and so are neighbouring shorter lines up to a blank or long line,
    as in hard-wrapped text. Words are those of split_words() after A-Z are lower-cased.
    """
    first, at, short = 0, 0, []
    for i, line in enumerate([*text.encode().lower().split(b"\n"), b""] if text else ()):
        words = split_words(line)
        if words and len(words) < least_words:
            if not short:
                first = i
            short += words
        else:
            if len(short) >= least_words:
                yield first, i - first, at - len(short), short
            short = []
            if words:
                yield i, 1, at, words
        at += len(words)


class Slice:
    """The paragraphs of some texts, with their shingles worked out together.

    rows has (text, first line, lines, first word, words, node) of each, text being a place in texts and node the XXH64 of the
    words joined by spaces. Shingles are hashes of SHINGLE words in 52 bits, distinct within a paragraph; those of
    paragraph i stand at starts[i] : starts[i + 1] in hashes, sorted. A paragraph of fewer words has one.
    """

    def __init__(self, texts: list[str | None], least_words: int = LEAST_WORDS):
        digest = xxhash.xxh64_intdigest
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        every: list[bytes] = []
        for r, text in enumerate(texts):
            for i, lines, at, words in units(text, least_words):
                self.rows.append((r, i, lines, at, len(words), digest(b" ".join(words), _SEED)))
                every += words
        sizes = np.fromiter((x[4] for x in self.rows), np.int64, len(self.rows))
        words_hashed = np.fromiter(map(digest, every), np.uint64, len(every))
        ends = np.cumsum(sizes)
        width = np.minimum(sizes, SHINGLE)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rolled = words_hashed.copy()
        for k in range(1, SHINGLE):
            ahead = np.zeros_like(rolled)
            ahead[: len(rolled) - k] = words_hashed[k:]
            longer = rolled * _BASE + ahead
            rolled = longer if (width > k).all() else np.where((width > k)[owner], longer, rolled)
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        whole = np.arange(len(rolled)) <= (ends - width)[owner]
        self.hashes, self.starts = self._distinct(rolled[whole] >> np.uint64(12), owner[whole], len(sizes))

    @staticmethod
    def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each owner's distinct hashes, sorted, and where they start. Up to 4096 owners share a sort: 12 bits in front of 52."""
        parts = []
        for first in range(0, n, 4096):
            lo, hi = np.searchsorted(owner, [first, first + 4096])
            keys = np.sort(((owner[lo:hi] - first).astype(np.uint64) << np.uint64(52)) | hashes[lo:hi])
            parts.append((keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys, first))
        out = np.concatenate([k & np.uint64((1 << 52) - 1) for k, _ in parts]) if parts else hashes
        counts = np.concatenate([np.bincount((k >> np.uint64(52)).astype(np.int64), minlength=min(4096, n - first)) for k, first in parts]) if parts else np.zeros(0, np.int64)
        return out, np.concatenate([[0], np.cumsum(counts)])

    def shingles(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i + 1]].view(np.int64)

    def band_keys(self) -> list[np.ndarray]:
        """BANDS keys of 32 bits for each paragraph, from BANDS * ROWS minima."""
        out = []
        for band in range(BANDS):
            key = np.full(len(self.rows), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = (key ^ np.minimum.reduceat(self.hashes * _FACTOR[k] + _SHIFT[k], self.starts[:-1])) * _BASE
                key ^= key >> np.uint64(31)
            out.append((key >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return out

    def bitmaps(self) -> np.ndarray:
        """BITMAP words a paragraph; each shingle flips one bit, so two bitmaps differ in no more bits than the sets in shingles."""
        n, bits = len(self.rows), 64 * BITMAP
        owner = np.repeat(np.arange(n), np.diff(self.starts))
        flips = np.bincount(owner * bits + ((self.hashes >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
        return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _place(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


_PLACE = ["text_hash", "paragraph", "n_lines", "first_word", "n_words", "node"]
_LIGHT = ["n", *[f"x{i}" for i in range(BITMAP)]]
_KEYS = [f"k{i}" for i in range(BANDS)]


def paragraph_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, paragraph, n_lines, first_word, n_words, node, n, x0 .., k0 ..) of every long enough paragraph of every document.

    n counts distinct shingles, x0 .. are the parity bitmap and k0 .. the band keys. Equal nodes have equal ones.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = [*_PLACE, *_LIGHT, *_KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                texts = some.column(1).to_pylist()
                own = Slice(texts, least_words)
                if not own.rows:
                    continue
                r, *place = np.array([x[:5] for x in own.rows], np.int64).T
                node = np.array([x[5] for x in own.rows], np.uint64).view(np.int64)
                hashes = {i: _signed(xxhash.xxh64_intdigest(texts[i], _SEED)) for i in set(r.tolist())}
                text_hash = np.array([hashes[i] for i in r.tolist()], np.int64)
                columns = [text_hash, *place, node, np.diff(own.starts), *np.ascontiguousarray(own.bitmaps().T), *own.band_keys()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(r)), *map(pa.array, columns)], names=["doc_id", *names])

    return _place(docs).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {'int' if c in _KEYS else 'long'}" for c in names))


def shingle_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(node, shingles) of the paragraphs of docs(text, wanted) whose node is among wanted, a list of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some, found = batch.slice(start, SLICE), {}
                wanted = [set(w) for w in some.column(1).to_pylist()]
                own = Slice(some.column(0).to_pylist(), least_words)
                for i, row in enumerate(own.rows):
                    if _signed(row[5]) in wanted[row[0]]:
                        found[_signed(row[5])] = own.shingles(i)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("text", "wanted").mapInArrow(run, "node long, shingles array<long>")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def may_be_similar(similarity: float, x: str, y: str) -> Column:
    """A condition on sizes and bitmaps that all pairs of sets as similar as that meet.

    Similar sets of n_x and n_y share at least s / (1 + s) of n_x + n_y, so they differ in at most the rest, and so do their bitmaps.
    """
    total = F.col(f"n_{x}") + F.col(f"n_{y}")
    differ = sum((hamming(F.col(f"x{i}_{x}"), F.col(f"x{i}_{y}")) for i in range(BITMAP)), F.lit(0))
    apart = total - 2 * F.ceil(total * (similarity / (1 + similarity)) - 1e-9)
    return (F.abs(F.col(f"n_{x}") - F.col(f"n_{y}")) <= apart) & (differ <= apart)


class ExactJaccard:
    """Decides on pairs of paragraphs by their shingles, which are worked out anew for the few that are asked for."""

    def __init__(self, docs: DataFrame, holders: DataFrame, similarity: float, least_words: int):
        """holders(node, holder) names a document, by _key(), with each paragraph."""
        self.docs, self.holders, self.similarity, self.least_words = docs, holders, similarity, least_words

    def shingles(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of nodes(node). Only documents that hold one are tokenized again."""
        wanted = stage(self.holders.join(nodes.distinct(), "node").groupBy("holder").agg(F.collect_list("node").alias("wanted")), "passage-holders")
        few = wanted.count() <= BROADCAST_IDS
        texts = self.docs.select("doc_id", "text").join(F.broadcast(wanted.select("holder")) if few else wanted.select("holder"), _key(F.col("doc_id")) == F.col("holder"), "left_semi")
        again = texts.select("text", _key(F.col("doc_id")).alias("holder")).join(wanted, "holder")
        return stage(shingle_table(again, self.least_words).dropDuplicates(["node"]), "passage-shingles")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        known = self.shingles(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        a, b = (known.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        return stage(pairs.join(a, "a").join(b, "b").where(jaccard(F.col("sa"), F.col("sb")) >= self.similarity).select("a", "b"), "passage-similar")

    def to_giant(self, few: DataFrame, many: DataFrame) -> DataFrame:
        open_ones = many.join(few.select("bucket").distinct(), "bucket", "left_semi")
        known = self.shingles(few.select(F.col("node_x").alias("node")).union(open_ones.select("node_y")))
        x = few.join(known.select(F.col("node").alias("node_x"), F.col("shingles").alias("sx")), "node_x")
        y = open_ones.join(known.select(F.col("node").alias("node_y"), F.col("shingles").alias("sy")), "node_y")
        holds = may_be_similar(self.similarity, "x", "y") & (jaccard(F.col("sx"), F.col("sy")) >= self.similarity)
        return stage(sorted_join(x, y, (x.bucket == y.bucket) & (x.part == y.part) & holds, "left_semi").select(F.col("cx").alias("a"), F.col("giant").alias("b")).distinct(), "passage-to-giant")


def _key(doc_id: Column) -> Column:
    """doc_id with null as a value of its own, for joins."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, paragraph, n_lines, first_word, n_words, component_id, component_text, component_paragraph, component_word, kept)
    of every paragraph that repeats across documents.

    Paragraphs are the units() of at least least_words words, numbered by their first line. Two are linked if the Jaccard similarity of
    their sets of five-word shingles is at least `similarity`, checked exactly on pairs that meet in a band;
    links are closed to components. Components within one document are left out. component_id is
    the smallest doc_id in the component and kept marks its first paragraph, by doc_id, text and place, whose
    text_hash, paragraph and first_word are component_*: together with component_id they name one component;
    rows without doc_id come last. Rows of equal doc_id and text count as one document. Null and empty texts have no
    paragraphs; an empty table gives an empty result; other columns are not read.

    Equal paragraphs share a 64-bit node, so copies cost a row each and no pair. Only documents that
    hold a colliding paragraph are read again for the exact check.
    """
    whole = stage(paragraph_table(docs, least_words), "passages")
    nodes = stage(whole.groupBy("node").agg(F.min(_key(F.col("doc_id"))).alias("holder"), *[F.min(c).alias(c) for c in (*_LIGHT, *_KEYS)]), "passage-nodes")
    found = stage(whole.select("doc_id", *_PLACE).distinct(), "passage-places")
    discard(whole)
    free_shuffles(docs.sparkSession)
    bucket = lambda i: F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.col(f"k{i}").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    members = nodes.select(F.explode(F.array(*[bucket(i) for i in range(BANDS)])).alias("bucket"), "node")
    exact = ExactJaccard(docs, nodes.select("node", "holder"), similarity, least_words)
    near = link_buckets(members, lambda x, y: may_be_similar(similarity, x, y), "passages", nodes.select("node", *_LIGHT), exact)
    free_shuffles(docs.sparkSession)
    placed = found.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("paragraph"), F.col("first_word"))
    spans = placed.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("doc_id").alias("component_id"))
    spans = spans.where("first.text_hash <> last.text_hash OR NOT (first.doc_id <=> last.doc_id)")
    kept = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("paragraph") == F.col("first.paragraph"))
    return placed.join(spans, "component").select("doc_id", "text_hash", "paragraph", "n_lines", "first_word", "n_words", "component_id", F.col("first.text_hash").alias("component_text"), F.col("first.paragraph").alias("component_paragraph"), F.col("first.first_word").alias("component_word"), kept.alias("kept"))


@F.pandas_udf(StringType())
def _cut(text: pd.Series, lines: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    rest = lambda x: [] if x is None else list(x)
    return pd.Series([None if t is None else cut_words(t, rest(a), rest(b), rest(c)) for t, a, b, c in zip(text, lines, starts, sizes, strict=True)], dtype=object)


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with all but the first copy of each repeated paragraph and verbatim run taken out of the texts.

    Documents without any word left are dropped, and so are those that had none. n_chars, where it is
    a column, is counted anew.
    """
    lines = F.sequence(F.col("paragraph"), F.col("paragraph") + F.col("n_lines") - 1)
    near = repeated_passages(docs, least_words=least_words).where("NOT kept").select("doc_id", "text_hash", F.explode(lines).alias("line"), F.lit(None).cast("struct<s:bigint,n:bigint>").alias("run"))
    same = repeated_runs(docs).where("NOT kept").select("doc_id", "text_hash", F.lit(None).cast("long").alias("line"), F.struct(F.col("first_word").alias("s"), F.col("n_words").alias("n")).alias("run"))
    doc, own, lost, runs = spare(docs, "_doc", "_hash", "_gone", "_runs")
    gone = near.union(same).groupBy(_key(F.col("doc_id")).alias(doc), F.col("text_hash").alias(own)).agg(F.collect_set("line").alias(lost), F.collect_set("run").alias(runs))
    joined = docs.withColumns({doc: _key(F.col("doc_id")), own: F.xxhash64("text")}).join(gone, [doc, own], "left")
    left = _cut(F.when(F.col(lost).isNotNull(), F.col("text")), lost, F.col(f"{runs}.s"), F.col(f"{runs}.n"))
    out = joined.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(left)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and every verbatim run of over 50 words that repeats across documents.

    For a run, paragraph is the line it begins in, and component_id the document with its first copy.
    component_id, component_text, component_paragraph and component_word are the place of the first copy.
    """
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "paragraph", "n_words", "component_id", "kept", "first_word", "verbatim", "component_text", "component_paragraph", "component_word"]
    near = repeated_passages(docs).withColumn("verbatim", F.lit(False)).select(*columns)
    return near.union(repeated_runs(docs).withColumn("verbatim", F.lit(True)).select(*columns))


QUERIES = {"op10_paragraph_dedup": op10_paragraph_dedup}
SQL: dict[str, str] = {}
