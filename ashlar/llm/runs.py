"""Word runs that repeat verbatim across documents, wherever lines break: anchors, windows, spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_shuffles, stage

#: Least words of a run: passages of over 50 words.
RUN = 51
#: Words of an anchor; a window of RUN words holds RUN - ANCHOR + 1 of them and is known by the smallest.
ANCHOR = 25
#: Bits of a place that count words; the ones above count documents.
PLACE_BITS = 25
#: Ids of later copies are broadcast up to this many (some 64 bytes each), else joined by shuffle.
BROADCAST_IDS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: Characters of scripts written without spaces, in UTF-8: Thai, Lao, Myanmar, Khmer, kana, Han.
_SINGLE = rb"(?:\xe0[\xb8-\xbb].|\xe1[\x80-\x82\x9e\x9f].|\xe3[\x81-\x83\x90-\xbf].|[\xe4-\xe9]..|\xf0[\xa0-\xaf]..)"
_SINGLES = re.compile(_SINGLE)
_WORDS = re.compile(_SINGLE + rb"|(?:(?!" + _SINGLE + rb")\S)+")
_PLAIN = re.compile(rb"\S+")


def split_words(line: bytes) -> list[bytes]:
    """Words between ASCII white space; each character of a script without spaces is a word."""
    return _WORDS.findall(line) if _SINGLES.search(line) else line.split()


def _spans(line: bytes) -> list[tuple[int, int]]:
    return [x.span() for x in (_WORDS if _SINGLES.search(line) else _PLAIN).finditer(line)]


class _Powers:
    """Powers of the base and of its inverse, worked out once up to the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1024)
            of = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            self.up, self.down = of(_BASE), of(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the hashes, each times a power of the base."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.add.accumulate(hashes * _POWERS.upto(len(hashes))[0], out=out[1:])
    return out


def _windows(sums: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` values, from _sums()."""
    n = len(sums) - width
    out = sums[width:] - sums[:-width]
    out *= _POWERS.upto(n)[1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def run_hashes(text: str | None, whole: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray] | None:
    """(anchor, hash, line) of the window of RUN words at each word of a text that has one; without hashes unless whole."""
    parts = [split_words(line) for line in text.encode().lower().split(b"\n")] if text else []
    sizes = [len(x) for x in parts]
    n = sum(sizes)
    if n < RUN:
        return None
    sums = _sums(np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(parts)), np.uint64, n))
    lines = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    return _smallest(_windows(sums, ANCHOR), RUN - ANCHOR + 1).view(np.int64), _windows(sums, RUN).view(np.int64) if whole else None, lines[: n - RUN + 1]


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _anchors(own: DataFrame) -> DataFrame:
    """(own, anchor, n_words, line) of own(own, text): a row for each anchor, and one without anchor that has the words of the text and its first line that holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 256):
                mine, found, whole = [], [], []
                for i, text in enumerate(batch.column(1).slice(at, 256)):
                    h = run_hashes(text.as_py(), False)
                    if h:
                        found.append(np.unique(h[0]))
                        mine.append(np.full(len(found[-1]), ids[at + i]))
                        whole.append((ids[at + i], len(h[0]) + RUN - 1, h[2][0]))
                if found:
                    none = pa.nulls(sum(map(len, found)), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mine)), pa.array(np.concatenate(found)), none, none], names=["own", "anchor", "n_words", "line"])
                    o, n, line = np.array(whole, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(o), pa.nulls(len(o), pa.int64()), pa.array(n), pa.array(line)], names=["own", "anchor", "n_words", "line"])

    return own.select("own", "text").mapInArrow(run, "own long, anchor long, n_words long, line long")


def _numbered(own: DataFrame, held: DataFrame) -> DataFrame:
    """(own, doc_id, text_hash, ord) of the documents of held, numbered from 0 by doc_id and text, rows without doc_id last."""
    rows = own.select("own", "doc_id", "text_hash").join(held.select("own"), "own", "left_semi").distinct()
    rows = stage(rows.orderBy(F.col("doc_id").isNull(), "doc_id", "text_hash").withColumn("m", F.monotonically_increasing_id()), "run-documents")
    part = F.shiftright("m", 33).cast("int")
    offsets, before = [], 0
    for p, n in sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))
        before += n
    known = F.broadcast(own.sparkSession.createDataFrame(offsets, "p int, before long"))
    return rows.withColumn("p", part).join(known, "p").select("own", "doc_id", "text_hash", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord"))


def _candidates(held: DataFrame) -> DataFrame:
    """(hash, place, line) of the windows of held(ord, text, live) with a live anchor; place is ord and the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 256):
                cols = []
                some = batch.slice(at, 256)
                for i, (text, live) in enumerate(zip(some.column(1), some.column(2), strict=True)):
                    h = run_hashes(text.as_py())
                    if not h:
                        continue
                    if len(h[0]) >> PLACE_BITS:
                        raise ValueError(f"a text of over {1 << PLACE_BITS} words")
                    pos = np.flatnonzero(np.isin(h[0], live.values.to_numpy(zero_copy_only=False)))
                    cols.append((h[1][pos], (int(ords[at + i]) << PLACE_BITS) + pos, h[2][pos]))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], names=["hash", "place", "line"])

    return held.select("ord", "text", "live").mapInArrow(run, "hash long, place long, line int")


def _place(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("own", F.xxhash64(_key(F.col("doc_id")), "text_hash"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, paragraph, first_word, n_words, component_id, component_text, component_paragraph, component_word, kept).

    Every run of RUN or more words that stands verbatim in several documents, but for case and white space; lines do
    not matter. Documents of equal text are one run each, from the first word to the last, and only the first
    of them (by doc_id; rows without doc_id last) is held against the other texts. There a window of RUN words is known by its hash and
    its smallest anchor, so equal windows have equal anchors and only windows whose anchor several texts share
    are written down: all repeats are found and no pairs are made. A run is a stretch of windows with one first copy; component_* tell
    the first copy's place (by doc_id, text and word) and kept marks runs of the document that holds it.
    paragraph and first_word count lines and words of the text from 0. Rows of equal doc_id and text count as one.
    """
    spark = docs.sparkSession
    every = _place(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("own"))
    same = every.groupBy("text_hash").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first.own <> last.own").select("text_hash", F.col("first.own").alias("first_own"), F.col("first.doc_id").alias("first_id"))
    copies = stage(every.select("doc_id", "text_hash", "own").join(same, "text_hash").distinct(), "run-copies")
    later = copies.where("own <> first_own").select("own")
    own = every.join(F.broadcast(later) if later.count() <= BROADCAST_IDS else later, "own", "left_anti")
    anchors = stage(_anchors(own), "run-anchors")
    known = anchors.where("anchor IS NOT NULL").select("own", "anchor")
    live = known.groupBy("anchor").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("anchor")
    held = stage(known.join(live, "anchor").groupBy("own").agg(F.collect_set("anchor").alias("live")), "run-live")
    of_copies = anchors.where("anchor IS NULL").select(F.col("own").alias("first_own"), "n_words", "line")
    component = [F.col("first_id").alias("component_id"), F.col("text_hash").alias("component_text"), F.col("line").alias("component_paragraph"), F.lit(0).cast("long").alias("component_word")]
    whole = stage(copies.join(of_copies, "first_own").select("doc_id", "text_hash", F.col("line").alias("paragraph"), F.lit(0).cast("long").alias("first_word"), "n_words", *component, (F.col("own") == F.col("first_own")).alias("kept")), "run-whole")
    discard(anchors)
    free_shuffles(spark)
    ids = stage(_numbered(own, held), "run-numbers")
    texts = own.select("own", "text").join(held.join(ids.select("own", "ord"), "own"), "own")
    alike = Window.partitionBy("hash").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    document = lambda place: F.shiftright(place, PLACE_BITS)
    windows = _candidates(texts).select("place", "line", F.first("place").over(alike).alias("there"), F.first("line").over(alike).alias("there_line"), F.last("place").over(alike).alias("last"))
    repeated = stage(windows.where(document("there") < document("last")).drop("last"), "run-windows")
    discard(held)
    free_shuffles(spark)
    # A stretch goes on while the place and that of the first copy move together, by one word (or none, in rows that repeat).
    walk = Window.partitionBy(document("place")).orderBy("place")
    goes_on = lambda near: F.coalesce((F.abs(F.col("place") - near("place").over(walk)) <= 1) & (F.col("place") - near("place").over(walk) == F.col("there") - near("there").over(walk)), F.lit(False))
    edges = repeated.select("*", (~goes_on(F.lag)).alias("begins"), (~goes_on(F.lead)).alias("ends")).where("begins OR ends")
    stretches = edges.withColumn("to", F.when(F.col("ends"), F.col("place")).otherwise(F.lead("place").over(walk))).where("begins")
    side = lambda x, i, t: ids.select(F.col("ord").alias(x), F.col("doc_id").alias(i), F.col("text_hash").alias(t))
    named = stretches.withColumns({"o": document("place"), "f": document("there")}).join(side("o", "doc_id", "text_hash"), "o").join(side("f", "component_id", "component_text"), "f")
    word = lambda place: F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    out = named.select(
        "doc_id", "text_hash", F.col("line").cast("long").alias("paragraph"), word("place").alias("first_word"), (F.col("to") - F.col("place") + RUN).alias("n_words"),
        "component_id", "component_text", F.col("there_line").cast("long").alias("component_paragraph"), word("there").alias("component_word"), (F.col("o") == F.col("f")).alias("kept"),
    )
    out = stage(out.unionByName(whole), "runs")
    discard(repeated, whole, copies)
    free_shuffles(spark)
    return out


def cut_words(text: str, lines: list[int], starts: list[int], sizes: list[int]) -> str:
    """text without whole lines and without ranges of words; a line that loses all its words goes too."""
    gone_lines, out, at = set(lines), [], 0
    ranges = sorted(zip(starts, sizes, strict=True))
    gone = np.zeros(max((s + n for s, n in ranges), default=0), bool)
    for s, n in ranges:
        gone[s : s + n] = True
    for i, line in enumerate(text.encode().split(b"\n")):
        spans = _spans(line)
        mine = gone[at : at + len(spans)]
        at += len(spans)
        if i in gone_lines:
            continue
        if not mine.any():
            out.append(line)
            continue
        mine = np.concatenate([mine, np.zeros(len(spans) - len(mine), bool)])
        left = np.flatnonzero(~mine)
        if len(left):
            parts = np.split(left, np.flatnonzero(np.diff(left) > 1) + 1)
            out.append(b" ".join(line[spans[p[0]][0] : spans[p[-1]][1]] for p in parts))
    return b"\n".join(out).decode()
