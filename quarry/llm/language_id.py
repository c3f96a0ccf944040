"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are log counts of hashed byte trigrams of the whole lower-cased text, all characters but letters being blanks.
A one-versus-rest linear SVM picks the family, then pairwise SVMs vote inside it. All are trained by dual coordinate
descent (squared hinge) on at most PER_LANGUAGE distinct documents a language, those of smallest hash, from rows that have a
label of their own and are not held out. Prediction is one Arrow pass over the rows, without a shuffle. The model holds one weight vector a
family and a pair of languages of a family; its size follows the languages, not the documents.

Cases: `und` with score 0 for a null text, one without a letter, or when nothing could be learned; null lang rows are
not learned from, whatever other rows share their doc_id; repeated rows each give a row, and are learned from once; a single learned
language is predicted throughout; an empty table gives an empty result; ties go to the alphabetically first language; a text of any length is
read whole, its features have a fixed size; `known` keeps all other columns, and `op4` reads doc_id, text and lang alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches
from quarry.llm.folds import fold, sampled

BITS, PER_LANGUAGE, EPOCHS = 13, 400, 15
#: Families of common languages; a language without one is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl no sv",
    "romance": "ca es fr gl it la pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = bytes(c if (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower()[:2], f"={lang}")


def features(text: str) -> np.ndarray:
    a = np.frombuffer((" " + text.lower() + " ").encode().translate(_LETTERS), np.uint8)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])].astype(np.uint32)  # one blank for a run
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    v = np.log1p(np.bincount((h >> np.uint32(32 - BITS)).astype(np.int64), minlength=1 << BITS)).astype(np.float32)
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; classes weigh alike."""
    c = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    diag = 0.5 / c
    q = np.einsum("ij,ij->i", x, x) + diag
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float32)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            new = max(0.0, alpha[i] - (y[i] * float(w @ x[i]) - 1 + diag[i] * alpha[i]) / q[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Model:
    """Family classifiers and, per family, pairwise classifiers."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        families = np.array([family_of(v) for v in langs])
        self.families = sorted(set(families))
        self.members = {f: sorted(set(names[families == f])) for f in self.families}
        rows = []
        if len(self.families) > 1:
            rows += [train_svm(x, np.where(families == f, 1.0, -1.0)) for f in self.families]
        self.pairs = {}
        for f, langs_in in self.members.items():
            for a, b in combinations(langs_in, 2):
                some = (names == a) | (names == b)
                self.pairs[f, a, b] = len(rows)
                rows.append(train_svm(x[some], np.where(names[some] == a, 1.0, -1.0)))
        self.w = np.stack(rows) if rows else np.zeros((0, x.shape[1]), np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        m = (self.w @ x).astype(float)
        if len(self.families) > 1:
            f = self.families[int(np.argmax(m[: len(self.families)]))]
            top = np.sort(m[: len(self.families)])
            score = 1 / (1 + np.exp(-3 * (top[-1] - top[-2])))
        else:
            f, score = self.families[0], 1.0
        langs = self.members[f]
        votes, worst = dict.fromkeys(langs, 0), dict.fromkeys(langs, np.inf)
        for a, b in combinations(langs, 2):
            v = m[self.pairs[f, a, b]]
            votes[a if v >= 0 else b] += 1
            worst[a], worst[b] = min(worst[a], v), min(worst[b], -v)
        best = max(langs, key=lambda k: (votes[k], worst[k], [-ord(c) for c in k]))
        if len(langs) > 1:
            score *= 1 / (1 + np.exp(-3 * worst[best]))
        return best, float(score)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from docs(doc_id, text, lang): the training folds, at most per_language rows a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sample = sampled(rows, ["lang"], per_language)

    def encode(batches):
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in keep], pa.string()), pa.array([features(texts[i]).astype(np.float16).tobytes() for i in keep], pa.binary())], ["lang", "x"]
            )

    got = sample.select("text", "lang").mapInArrow(encode, "lang string, x binary").toArrow().to_pydict()
    if not got["lang"]:
        return None
    order = sorted(range(len(got["lang"])), key=lambda i: (got["lang"][i], got["x"][i]))
    x = np.stack([np.frombuffer(got["x"][i], np.float16) for i in order]).astype(np.float32)
    return Model(x, [got["lang"][i] for i in order])


def predict(docs: DataFrame, model: Model | None, carry: list[str]) -> DataFrame:
    """The carried columns with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def run(batches):
        for b in batches:
            m, langs, scores = shared.value, [], []
            for t in b.column(len(carry)).to_pylist():
                lang, score = m.predict(features(t)) if m is not None and has_letter(t) else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carry, "lang_pred", "score"])

    return docs.select(*carry, "text").mapInArrow(run, f"{types}, lang_pred string, score double")


def known(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; those predicted `und` go. Columns unchanged."""
    small_batches(docs.sparkSession)
    model = fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # The decision is made where the text is: the whole row passes through, nothing is shuffled.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            ok = [has_letter(t) and shared.value.predict(features(t))[0] != "und" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = predict(docs, fit(docs), ["doc_id"])
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
