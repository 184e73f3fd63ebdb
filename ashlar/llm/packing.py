"""Packing of tokenized documents into fixed-length sequences: first-fit decreasing on a tournament tree."""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 1024
#: Documents to a randomised group on average; a group is one task's unit of work.
GROUP_DOCS = 1024
#: Where white space follows white space the full pattern is needed; elsewhere its look-ahead never matters.
_RUN = re.compile(r"\s\s")


def vocabulary_path() -> str:
    """The vocabulary as ranks, the same ids as byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def special_tokens() -> dict[str, int]:
    """The strings that byte_bpe_50k.json makes one id of wherever they stand."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; a special token's string is its id wherever it stands.

    Most texts hold no two adjacent white spaces. There the pattern's alternative with a look-ahead
    cannot match anything but what the next one matches too, and the pattern without it runs faster.
    """

    def __init__(self, path: str, special: dict[str, int] | None = None):
        import public_tokenizers

        self._special = special_tokens() if special is None else special
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        full = public_tokenizers.PATTERN
        plain = full.replace(r"|\s+(?!\S)", "").replace("'s|'t|'re|'ve|'m|'ll|'d", "'(?:[stmd]|re|ve|ll)")
        self._full, self._plain = (tiktoken.Encoding("packing", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (full, plain))

    def encode(self, text: str) -> bytes:
        ids = array("I")
        for part in self._marks.split(text) if self._marks and self._marks.search(text) else (text,):
            if part in self._special:
                ids.append(self._special[part])
            elif part:
                ids.extend((self._full if _RUN.search(part) else self._plain)(part))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nonce): each document's ids cut after every `limit`.

    A document is its ids and then end_id, so a null or empty text is the end id alone. nonce numbers
    the pieces by input partition and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, n = Encoder(path), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                rows += [(i, s, min(limit, total - s), zlib.crc32(ids[4 * s : 4 * (s + limit)]), total) for s in range(0, total, limit)]
            if not rows:
                continue
            at, start, length, crc, total = np.array(rows, np.int64).T
            nonce = (task << 40) + n + np.arange(len(rows))
            n += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, (start, length, crc, total, nonce))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nonce"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nonce long")


class Tournament:
    """A complete tree over bins; each node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.top = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Puts size into the first bin with room for it and returns that bin."""
        top, at = self.top, 1
        while at < self.leaves:
            at *= 2
            if top[at] < size:
                at += 1
        top[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            most = max(top[2 * at], top[2 * at + 1])
            if top[at] == most:
                break
            top[at] = most
        return found


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each size; sizes lie in 1..room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == room).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree, used = Tournament(len(rest), room), np.zeros(max(1, len(rest)), np.int64)
    for i in rest:
        size = int(sizes[i])
        found = tree.take(size)
        bins[i], offsets[i] = full + found, used[found]
        used[found] += size
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every document.

    Pieces are dealt to groups at random, evenly whatever their text or id (equal rows too), and each
    group is packed on its own by first-fit decreasing. The number of groups follows the number of
    documents, so a group stays small at any size. An empty table gives an empty result; extra columns
    are ignored; rows without doc_id are packed like any other.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nonce", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), limit)
        return group.drop(columns=["nonce", "part"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    cut = pieces(docs, path or vocabulary_path(), limit).withColumn("part", F.pmod(F.xxhash64("nonce"), F.lit(groups)))
    kind = dict(docs.dtypes)["doc_id"]
    return cut.groupBy("part").applyInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over documents."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
