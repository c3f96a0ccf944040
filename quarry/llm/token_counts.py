"""Token counts by a unigram model, with prefix scores shared along a trie of distinct pre-tokens.

A pre-token is a word (split at \\x20 and \\x09-\\x0D) with a leading word mark. The vocabulary's pieces come from a public
tokenizer's file; a piece's log probability follows its rank by the Zipf-Mandelbrot rule. The best segmentation of a
prefix does not depend on what follows, so the distinct pre-tokens of a batch are inserted in a trie whose nodes are scored once, depth by
depth: all nodes of a depth look up the pieces that end at them (by hashes of their last characters) at the same time. Terminal nodes
hold the token count. Counts are kept between batches up to a bounded number of words. Characters outside the vocabulary cost one token a
UTF-8 byte.

Cases: null or wordless text has no words and no tokens; ties between segmentations go to fewer tokens; a pre-token longer than LONG
characters is scored on its own with the scores of the last few prefixes alone, so its length costs no memory; texts are read whole, a few
megabytes at a time; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import small_batches
from quarry.llm.textkernel import U, mix

#: Path of the vocabulary file; a parameter, as the file belongs to another package.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, SHIFT, KEEP, LONG, AT_ONCE, CHUNK = "▁", 2.7, 200_000, 48, 50_000, 4 << 20
_BASE, _FILTER = 0x9E3779B97F4A7C15, 18
_BLANK = re.compile(rb"[ \t\n\x0b\f\r]")


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Log probability of every ordinary piece: proportional to 1 / (rank + SHIFT), rank by the file's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = log(sum(1 / (r + SHIFT) for r in range(len(ids))))
    return {model.id_to_piece(i): -log(r + SHIFT) - total for r, i in enumerate(ids)}


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + U(length) * U(0xD6E8FEB86659FD93))


class Counter:
    """Token counts of pre-tokens under a vocabulary."""

    def __init__(self, pieces: dict[str, float], keep: int = KEEP, long: int = LONG):
        self.pieces, self.keep, self.long = pieces, keep, long
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=-1.0) - 5.0  # a byte is less likely than any piece
        self.known: dict[bytes, int] = {}
        # Pieces of each length: sorted hashes with their log probabilities, and a small table that is asked first.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        with np.errstate(over="ignore"):
            for n in sorted({len(p) for p in pieces if p}):
                some = [p for p in pieces if len(p) == n]
                sums = np.zeros(len(some), U)
                for c in np.array([list(map(ord, p)) for p in some], U).reshape(len(some), n).T:
                    sums = sums * U(_BASE) + c + U(1)
                key = _key(sums, n)
                o = np.argsort(key)
                table = np.zeros(1 << _FILTER, bool)
                table[(key >> U(64 - _FILTER)).astype(np.int64)] = True
                self.tables[n] = key[o], np.array([pieces[p] for p in some], np.float64)[o], table

    def _forward(self, words: list[str]) -> np.ndarray:
        """Token counts of sorted distinct words of at most `long` characters."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        most = int(size.max())
        text = np.array(words, f"<U{most}").view(np.int32).reshape(len(words), most)
        here = np.arange(1, most + 1) <= size[:, None]
        same = np.zeros_like(here)
        same[1:] = np.logical_and.accumulate((text[1:] == text[:-1]) & here[1:] & here[:-1], axis=1)
        fresh = here & ~same
        # Nodes are numbered depth by depth; a word's node at a depth is the newest one so far, 0 is the root.
        ids = np.cumsum(fresh.T.ravel()).reshape(most, len(words)).T
        node = np.zeros((len(words), most + 1), np.int32)
        node[:, 1:] = np.maximum.accumulate(np.where(fresh, ids, 0), axis=0)
        total = int(ids[-1, -1]) + 1
        score, tokens, sums = np.full(total, -np.inf), np.zeros(total, np.int64), np.zeros(total, U)
        score[0] = 0.0
        powers = [pow(_BASE, n, 1 << 64) for n in range(self.longest + 1)]
        with np.errstate(over="ignore"):
            for d in range(1, most + 1):
                rows = np.flatnonzero(fresh[:, d - 1])
                at, before, char = node[rows, d], node[rows, d - 1], text[rows, d - 1]
                sums[at] = sums[before] * U(_BASE) + char.astype(U) + U(1)
                best, count, single = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
                for n, (keys, values, table) in self.tables.items():
                    if n > d:
                        break
                    start = node[rows, d - n]
                    key = _key(sums[at] - sums[start] * U(powers[n]), n)
                    some = np.flatnonzero(table[(key >> U(64 - _FILTER)).astype(np.int64)])
                    found = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
                    hit = keys[found] == key[some]
                    some, found = some[hit], found[hit]
                    if n == 1:
                        single[some] = True
                    s, t = score[start[some]] + values[found], tokens[start[some]] + 1
                    better = (s > best[some]) | ((s == best[some]) & (t < count[some]))
                    best[some[better]], count[some[better]] = s[better], t[better]
                n = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
                s, t = score[before] + n * self.byte, tokens[before] + n
                better = ~single & ((s > best) | ((s == best) & (t < count)))
                score[at], tokens[at] = np.where(better, s, best), np.where(better, t, count)
        return tokens[node[np.arange(len(words)), size]]

    def _alone(self, word: str) -> int:
        """The token count of one long word; only the last `longest` prefixes are kept."""
        last: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            char = word[end - 1]
            n = len(char.encode())
            score, tokens = last[-1]
            top = None if char in self.pieces else (score + n * self.byte, -(tokens + n))
            for k in range(1, min(end, self.longest) + 1):
                p = self.pieces.get(word[end - k : end])
                if p is not None:
                    score, tokens = last[-k]
                    if top is None or (score + p, -(tokens + 1)) > top:
                        top = (score + p, -(tokens + 1))
            last.append((top[0], -top[1]))
            del last[: -self.longest]
        return last[-1][1]

    def learn(self, words: Iterable[bytes]) -> None:
        short = []
        for w in words:
            text = MARK + w.decode()
            if len(text) > self.long:
                self.known[w] = self._alone(text)
            else:
                short.append((text, w))
        short.sort()
        for k in range(0, len(short), AT_ONCE):
            part = short[k : k + AT_ONCE]
            self.known.update(zip((w for _, w in part), self._forward([t for t, _ in part]).tolist(), strict=True))

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Words and tokens of each text."""
        if len(self.known) > self.keep:
            self.known.clear()
        split = [t.split() for t in texts]
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        self.learn(new.difference(self.known))
        return [(len(words), sum(map(self.known.__getitem__, words))) for words in split]


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end before a blank."""
    at = 0
    while len(text) - at > size:
        m = _BLANK.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def count(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        counter = Counter(shared.value)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            got: list[list[int]] = [[0, 0] for _ in range(b.num_rows)]
            part, size = [], 0

            def flush(part):
                for (row, _), (w, n) in zip(part, counter.counts([t for _, t in part]), strict=True):
                    got[row][0] += w
                    got[row][1] += n

            for row in range(b.num_rows):
                for t in chunks(texts[row].as_py() or b""):
                    part.append((row, t))
                    size += len(t)
                    if size > CHUNK:
                        flush(part)
                        part, size = [], 0
            flush(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op7(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
