"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: The training sample, for each language: documents, and stretches of so many characters from each.
SAMPLE_DOCS, SAMPLE_STRETCHES, STRETCH = 400, 12, 48
#: Bytes of a text that a sequence labels, and bytes of its neighbourhood on each side that it reads besides.
SPAN, CONTEXT = 240, 8
STEPS, BATCH, HIDDEN, EMBED = 400, 192, 12, 12
#: Texts and sequences that a worker labels together.
SLICE, TOGETHER = 256, 1024
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """True if a character of the text is alphabetic; superscripts and circled numbers are not."""
    found = _LETTER.search(text or "")
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def content(text: str) -> bytes:
    """What the network reads: the text in lower case as UTF-8, with one blank for each run of white space."""
    return " ".join(text.lower().split()).encode()


def _whole(data: bytes, at: int) -> int:
    """The place, at or before `at`, where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(data: bytes, span: int = SPAN, context: int = CONTEXT) -> list[tuple[int, int, int, int]]:
    """(first, start, stop, last) of the sequences of a text: bytes first to last are read and start to stop labelled.

    Every byte is labelled once, whatever the length; characters are never cut.
    """
    out, start = [], 0
    while start < len(data):
        stop = _whole(data, min(start + span, len(data)))
        stop = stop if stop > start else min(start + span, len(data))
        out.append((_whole(data, max(0, start - context)), start, stop, _whole(data, min(stop + context, len(data)))))
        start = stop
    return out


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by word and position, zero after the end, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = max(1, int(lengths.max(initial=1)))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over languages at each byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.p = {"embed": rng.normal(0, 0.5, (256, embed)).astype(np.float32), "out": draw(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": draw(embed, 3 * hidden), f"u{side}": draw(hidden, 3 * hidden), f"c{side}": np.zeros(3 * hidden, np.float32)}

    def _pass(self, side: str, codes: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States by position; positions run backwards for side b. Outside a word the state stays zero."""
        h_size, n, width = self.hidden, *codes.shape
        inputs = (self.p["embed"] @ self.p[f"w{side}"] + self.p[f"c{side}"])[codes]
        u, h = self.p[f"u{side}"], np.zeros((n, h_size), np.float32)
        states, trace = np.zeros((n, width, h_size), np.float32), []
        for t in range(width) if side == "f" else range(width - 1, -1, -1):
            x, r_h = inputs[:, t], h @ u
            gates = _sigmoid(x[:, : 2 * h_size] + r_h[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            new = np.tanh(x[:, 2 * h_size :] + r * r_h[:, 2 * h_size :])
            mask = live[:, t, None]
            after = (new + z * (h - new)) * mask
            if keep:
                trace.append((t, h, z, r, new, r_h[:, 2 * h_size :], mask))
            h = after
            states[:, t] = h
        return states, trace

    def _live(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return (np.arange(codes.shape[1]) < lengths[:, None]).astype(np.float32)

    def label(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probabilities by word, position and language."""
        live = self._live(codes, lengths)
        states = np.concatenate([self._pass(s, codes, live, False)[0] for s in "fb"], axis=2)
        scores = states @ self.p["out"] + self.p["bias"]
        scores -= scores.max(2, keepdims=True)
        return scores - np.log(np.exp(scores).sum(2, keepdims=True))

    def step(self, codes: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over all positions and its gradients, by backpropagation through time."""
        live, h_size = self._live(codes, lengths), self.hidden
        passes = {s: self._pass(s, codes, live, True) for s in "fb"}
        states = np.concatenate([passes[s][0] for s in "fb"], axis=2)
        scores = states @ self.p["out"] + self.p["bias"]
        scores -= scores.max(2, keepdims=True)
        chances = np.exp(scores)
        chances /= chances.sum(2, keepdims=True)
        rows = np.arange(len(codes))
        total = live.sum()
        loss = float(-(np.log(chances[rows, :, wanted] + 1e-9) * live).sum() / total)
        error = chances
        error[rows, :, wanted] -= 1
        error *= live[:, :, None] / total
        grads = {"out": np.einsum("ntk,ntc->kc", states, error, optimize=True), "bias": error.sum((0, 1)), "embed": np.zeros_like(self.p["embed"])}
        back = error @ self.p["out"].T
        table_of_inputs = self.p["embed"]
        for s, d_states in (("f", back[:, :, :h_size]), ("b", back[:, :, h_size:])):
            u, w = self.p[f"u{s}"], self.p[f"w{s}"]
            d_u, d_in, d_h = np.zeros_like(u), np.zeros((256, 3 * h_size), np.float32), np.zeros((len(codes), h_size), np.float32)
            for t, h, z, r, new, r_h, mask in reversed(passes[s][1]):
                d = (d_h + d_states[:, t]) * mask
                d_new = d * (1 - z) * (1 - new * new)
                d_gates = np.concatenate([d * (h - new) * z * (1 - z), d_new * r_h * r * (1 - r)], axis=1)
                d_rec = np.concatenate([d_gates, d_new * r], axis=1)
                d_u += h.T @ d_rec
                d_h = d * z + d_rec @ u.T
                np.add.at(d_in, codes[:, t], np.concatenate([d_gates, d_new], axis=1))
            grads |= {f"u{s}": d_u, f"w{s}": table_of_inputs.T @ d_in, f"c{s}": d_in.sum(0)}
            grads["embed"] += d_in @ w.T
        return loss, grads

    def fit(self, words: list[bytes], wanted: np.ndarray, weights: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 8e-3, seed: int = 11) -> list[float]:
        """Adam on batches drawn by weight, evenly over languages; gives the losses."""
        rng = np.random.default_rng(seed)
        codes, lengths = _matrix(words)
        share = weights / np.bincount(wanted, weights, len(self.languages))[wanted]
        edges = np.cumsum(share / share.sum())
        first, second, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, []
        for i in range(1, steps + 1):
            own = np.minimum(np.searchsorted(edges, rng.random(batch)), len(words) - 1)
            width = max(1, int(lengths[own].max()))
            loss, grads = self.step(codes[own, :width], lengths[own], wanted[own])
            losses.append(loss)
            pace = rate * min(1, 2 * (1 - i / (steps + 1)))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.p[k] -= pace * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
        return losses


class Labeller:
    """Labels every byte of whole texts and pools: mean log-probability over all bytes, then a softmax.

    The states run on over words and lines. Sequences of one length are worked out together, positions in turn.
    """

    def __init__(self, network: Network):
        p, h = network.p, network.hidden
        self.languages, self.hidden, self.bias = network.languages, h, p["bias"][:, None]
        self.inputs = {s: np.ascontiguousarray((p["embed"] @ p[f"w{s}"] + p[f"c{s}"]).T) for s in "fb"}
        self.recur = {s: np.ascontiguousarray(p[f"u{s}"].T) for s in "fb"}
        self.out = {"f": np.ascontiguousarray(p["out"][:h].T), "b": np.ascontiguousarray(p["out"][h:].T)}
        # Log-scores of all positions of the sequences in hand are held at once.
        self.together = max(16, min(TOGETHER, (1 << 22) // ((SPAN + 2 * CONTEXT) * len(self.languages))))

    def _run(self, side: str, codes: np.ndarray, live: np.ndarray | None, scores: np.ndarray) -> None:
        """Adds one direction's share to scores(position, language, sequence); the state stays zero outside a sequence."""
        h_size, inputs, recur, out = self.hidden, self.inputs[side], self.recur[side], self.out[side]
        h = np.zeros((h_size, codes.shape[1]), np.float32)
        x, r = np.empty((3 * h_size, codes.shape[1]), np.float32), np.empty((3 * h_size, codes.shape[1]), np.float32)
        gates, z, reset, new = r[: 2 * h_size], r[:h_size], r[h_size : 2 * h_size], r[2 * h_size :]
        for t in range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1):
            np.take(inputs, codes[t], axis=1, out=x)
            np.matmul(recur, h, out=r)
            gates += x[: 2 * h_size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new *= reset
            new += x[2 * h_size :]
            np.tanh(new, out=new)
            h -= new
            h *= z
            h += new
            if live is not None:
                h *= live[t]
            scores[t] += out @ h

    def sums(self, data: list[bytes], spans: list[tuple[int, int, int, int]]) -> np.ndarray:
        """The sum of log-probabilities over the labelled bytes of each sequence, one of spans in each of data, by language."""
        lengths = np.array([last - first for first, _, _, last in spans])
        result = np.zeros((len(spans), len(self.languages)))
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), self.together):
            own = order[i : i + self.together]
            size = int(lengths[own].max())
            rows = b"".join(data[k][spans[k][0] : spans[k][3]].ljust(size, b"\0") for k in own)
            codes = np.ascontiguousarray(np.frombuffer(rows, np.uint8).reshape(len(own), size).T).astype(np.intp)
            at = np.arange(size)[:, None]
            live = (at < lengths[own]).astype(np.float32) if lengths[own].min() < size else None
            scores = np.empty((size, len(self.languages), len(own)), np.float32)
            scores[:] = self.bias
            for side in "fb":
                self._run(side, codes, live, scores)
            scores -= scores.max(1, keepdims=True)
            scores -= np.log(np.exp(scores).sum(1, keepdims=True))
            lo, hi = (np.array([spans[k][j] - spans[k][0] for k in own]) for j in (1, 2))
            wanted = ((at >= lo) & (at < hi)).astype(np.float32)
            result[own] = np.einsum("tcn,tn->nc", scores, wanted)
        return result

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its score for each text."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for start in range(0, len(texts), SLICE):
            data, spans, owner, size = [], [], [], {}
            for i in range(start, min(start + SLICE, len(texts))):
                if has_letter(texts[i]):
                    read = content(texts[i])
                    mine = windows(read)
                    data += [read] * len(mine)
                    spans += mine
                    owner += [i] * len(mine)
                    size[i] = len(read)
            if not spans:
                continue
            ids, place = np.unique(owner, return_inverse=True)
            total = np.zeros((len(ids), len(self.languages)))
            np.add.at(total, place, self.sums(data, spans))
            mean = total / np.array([size[i] for i in ids.tolist()])[:, None]
            chances = np.exp(mean - mean.max(1, keepdims=True))
            chances /= chances.sum(1, keepdims=True)
            for i, row in zip(ids.tolist(), chances, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, stretches: int = SAMPLE_STRETCHES) -> Network | None:
    """A network fitted to stretches of rows of docs with text and lang that are not held out.

    The sample is bounded: of each language about sample_docs documents by a hash of their id, and of each of these
    `stretches` runs of STRETCH characters from places drawn by hash over the whole text. Every language that occurs is learned. None
    without any such row.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    shares = docs.sparkSession.createDataFrame([(lang, min(1_000_000, 1 + 1_000_000 * sample_docs // n)) for lang, n in counts.items()], "lang string, share long")
    sampled = known.join(F.broadcast(shares), "lang").where(chosen < F.col("share"))  # one row a language
    length = F.char_length("text")
    starts = F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda k: F.pmod(F.xxhash64(F.lit("stretch"), "doc_id", k), F.greatest(F.lit(1), length - STRETCH)).cast("int") + 1)
    pieces = sampled.select("lang", F.explode(F.array_distinct(F.transform(starts, lambda s: F.substr("text", s, F.lit(STRETCH))))).alias("piece"))
    languages = sorted(counts)
    parts, wanted = [], []
    for r in sorted(pieces.collect()):
        data = content(r.piece) if has_letter(r.piece) else b""
        if data:
            parts.append(data)
            wanted.append(languages.index(r.lang))
    network = Network(languages)
    if parts:
        network.fit(parts, np.array(wanted), np.ones(len(parts)))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score for every row, from the whole text alone.

    Null texts and texts without a letter get `und` and 0; so does every row without a network.
    Columns of docs named lang_pred or score are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(network) if network else None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                n = some.num_rows
                names, scores = labeller.label(some.column(at).to_pylist()) if labeller else ([UNKNOWN] * n, [0.0] * n)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(docs.select(*rest).schema.fields[:]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.select(*rest).mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
