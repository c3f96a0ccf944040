"""Quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages: runs of PASSAGE words of its whole text. Each passage is described by byte-class shares, word
lengths, repetition and log counts of hashed words, encoded by one tanh layer; gated attention weights, learned from the documents'
labels alone, give the weighted representation that is scored. Training is full-batch Adam on at most SAMPLE distinct labelled
documents of the training folds (those of smallest hash, texts up to LONGEST bytes). Scoring is one Arrow pass.

Cases: a null or empty text is a bag of one empty passage and gets a score; unlabelled or null-labelled rows are not learned
from; a document labelled twice counts with the larger label; repeated rows each give a row, and are learned from once; with one class
or no labels the score is that class's share (0.5 without labels); a text longer than SEGMENT bytes is read in segments of whole passages
with running attention sums, so its length costs no memory (a segment without PASSAGE words is one passage); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, renamed, small_batches
from quarry.llm.folds import fold, sampled
from quarry.llm.textkernel import SPACES, U, column, pieces, words

PASSAGE, SAMPLE, LONGEST, SEGMENT, HIDDEN, GATE, STEPS, THRESHOLD = 64, 6000, 1 << 20, 1 << 20, 16, 8, 160, 0.3

# Byte classes: lower, upper, digit, space, line end, full stop and comma, other marks one by one, non-ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[46, 44]] = 3, 4, 5
for _i, _c in enumerate("!|#$%&*?;:-<>\"'()/@="):
    _CLASS[ord(_c)] = 8 + _i
CLASSES, HASHED = 28, 64
WIDTH = CLASSES + 5 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts, and n + 1 offsets of the texts' passages."""
    h, rows = words(data, offsets, SPACES)
    count = np.diff(rows)
    parts = np.maximum(1, -(-count // PASSAGE))
    at = np.concatenate([[0], np.cumsum(parts)])
    n = int(at[-1])
    # The passage of each word, and of each byte by the words begun before it.
    inner = np.arange(len(h)) - np.repeat(rows[:-1], count)
    of_word = np.repeat(at[:-1], count) + inner // PASSAGE
    x = np.zeros((n, WIDTH), np.float32)
    if len(data):
        inside = ~SPACES[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] |= inside[offsets[:-1][np.diff(offsets) > 0]]
        begun = np.cumsum(start) - 1
        byte_row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        # blanks before a text's first word belong to its first passage
        ahead = begun < rows[byte_row]
        of_byte = np.where(ahead, at[byte_row], of_word[np.minimum(np.maximum(begun, 0), max(len(h) - 1, 0))] if len(h) else at[byte_row])
        x[:, :CLASSES] = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    total = np.maximum(x[:, :CLASSES].sum(1), 1)
    nw = np.bincount(of_word, minlength=n).astype(np.float32) if len(h) else np.zeros(n, np.float32)
    letters = x[:, 0] + x[:, 1] + x[:, 7]
    x[:, :CLASSES] /= total[:, None]
    if len(h):
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        x[:, CLASSES] = np.bincount(of_word, same, minlength=n) / np.maximum(nw, 1)
        keys = np.sort((of_word.astype(U) << U(40)) | (h >> U(24)))
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        x[:, CLASSES + 1] = np.bincount((keys[fresh] >> U(40)).astype(np.int64), minlength=n) / np.maximum(nw, 1)
        slot = of_word * HASHED + (h >> U(58)).astype(np.int64)
        x[:, CLASSES + 5 :] = np.log1p(np.bincount(slot, minlength=n * HASHED)).reshape(n, HASHED)
    x[:, CLASSES + 2] = letters / np.maximum(nw, 1) / 10
    x[:, CLASSES + 3] = np.log1p(nw) / 5
    x[:, CLASSES + 4] = nw == 0
    return x, at


def segments(data: np.ndarray, size: int = SEGMENT):
    """Byte ranges of a text, in order, each of whole passages of about `size` bytes: they begin where the passages of the whole text do."""
    at = 0
    while len(data) - at > size:
        part = ~SPACES[data[at : at + size]]
        starts = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
        whole = (len(starts) - 1) // PASSAGE * PASSAGE  # words up to the start of a further one
        end = at + (int(starts[whole]) if whole > 0 else size)
        yield at, end
        at = end
    yield at, len(data)


class Model:
    def __init__(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = STEPS, hidden: int = HIDDEN, gate: int = GATE):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = len(y) > 0 and 0 < self.prior < 1
        if not self.trained:
            return
        self.mean, self.std = x.mean(0), x.std(0) + 0.02
        rng = np.random.default_rng(11)
        g = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"w": g(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "v": g(hidden, gate), "u": g(hidden, gate), "a": g(gate, 1)[:, 0], "c": g(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}
        x = (x - self.mean) / self.std
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        seg, start = np.repeat(np.arange(len(y)), np.diff(at)), at[:-1]
        for step in range(1, steps + 1):
            p = self.p
            h, tv, su, att, z, out = self._forward(x, start, seg)
            err = (1 / (1 + np.exp(-out)) - y) / len(y)
            dz = err[:, None] * p["c"]
            datt = np.einsum("ij,ij->i", dz[seg], h)
            dlog = att * (datt - np.add.reduceat(att * datt, start)[seg])
            dg = dlog[:, None] * p["a"]
            dtv, dsu = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
            dh = (att[:, None] * dz[seg] + dtv @ p["v"].T + dsu @ p["u"].T) * (1 - h**2)
            grad = {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dtv, "u": h.T @ dsu, "a": (dlog[:, None] * tv * su).sum(0), "c": z.T @ err, "d": err.sum(keepdims=True)}
            for k, v in grad.items():
                v = v + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] -= (0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _forward(self, x, start, seg):
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        log = (tv * su) @ p["a"]
        e = np.exp(log - np.maximum.reduceat(log, start)[seg])
        att = e / np.add.reduceat(e, start)[seg]
        z = np.add.reduceat(att[:, None] * h, start)
        return h, tv, su, att, z, z @ p["c"] + p["d"][0]

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(at) - 1, self.prior)
        x = (x - self.mean) / self.std
        out = self._forward(x, at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at)))[5]
        return self._share(out)

    def long_score(self, data: np.ndarray, size: int = SEGMENT) -> float:
        """The score of one text, passage by passage with running sums of the attention."""
        if not self.trained:
            return self.prior
        p, top, total, z = self.p, -np.inf, 0.0, np.zeros(len(self.p["c"]))
        for a, b in segments(data, size):
            x = (passages(data[a:b], np.array([0, b - a]))[0] - self.mean) / self.std
            h = np.tanh(x @ p["w"] + p["b"])
            log = (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]
            new = max(top, float(log.max()))
            e, keep = np.exp(log - new), np.exp(top - new)
            top, total, z = new, total * keep + e.sum(), z * keep + e @ h
        return float(self._share(z / total @ p["c"] + p["d"][0]))

    @staticmethod
    def _share(out):
        return 1 / (1 + np.exp(-np.clip(np.asarray(out, np.float64), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality): at most `sample` rows of the training folds."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__y"))
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    chosen = sampled(renamed(short, "doc_id", cut(marks), "__y").where("__y is not null"), [], sample, "__y")

    def encode(batches):
        for b in batches:
            data, offsets = column(b.column(0))
            out = []
            for lo, hi in pieces(offsets):
                x, at = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out += [x[at[i] : at[i + 1]].astype(np.float16).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(out, pa.binary())], ["y", "x"])

    got = chosen.select("text", F.col("__y").cast("int")).mapInArrow(encode, "y int, x binary").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda i: (got["y"][i], got["x"][i]))
    bags = [np.frombuffer(got["x"][i], np.float16).astype(np.float32).reshape(-1, WIDTH) for i in order]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    y = np.array([float(got["y"][i] > 0) for i in order], np.float32)
    return Model(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), at, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            data, offsets = column(b.column(1))
            model, out = shared.value, np.zeros(b.num_rows)
            for lo, hi in pieces(offsets, SEGMENT):
                part = data[offsets[lo] : offsets[hi]]
                if hi == lo + 1 and len(part) > SEGMENT:
                    out[lo] = model.long_score(part)
                else:
                    out[lo:hi] = model.scores(*passages(part, offsets[lo : hi + 1] - offsets[lo]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality")))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
