"""Content fingerprints: normalized text, words, digests, 64-bit similarity hashes, all but NFKC in built-in functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts on the web define it (with U+FEFF, without U+0085).
WEB_SPACE = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
_PY_SPACE = re.compile("[\t\n\x0b\f\r \xa0  -     　﻿]+")


def squash(text: str) -> str:
    return _PY_SPACE.sub(" ", text).strip(" ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WEB_SPACE}]+", " "))


@F.pandas_udf(StringType())
def _nfkc_lower(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x).lower() for x in s], dtype=object)


def normalized(text: Column) -> Column:
    """NFKC, lower case, single blanks. Pure ASCII text stays in the JVM's own functions: nothing of it goes to Python."""
    plain = F.octet_length(text) == F.char_length(text)
    return collapse(F.when(plain, F.lower(text)).otherwise(_nfkc_lower(F.when(~plain, text))))


#: Letters and numbers.
_WORD = re.compile(r"[^\W_]+")
_KEEP = 200_000


class Similarity:
    """64-bit similarity hashes; the bits of a token are computed once and kept, up to a bounded number of tokens."""

    def __init__(self, keep: int = _KEEP):
        self.keep, self.at, self.signs = keep, {}, np.zeros((0, 64), np.int8)

    def hash(self, tokens: list[str]) -> int:
        if not tokens:
            return 0
        counts = Counter(tokens)
        if len(self.at) > self.keep:
            self.at.clear()
            self.signs = self.signs[:0]
        if fresh := [t for t in counts if t not in self.at]:
            digests = b"".join(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:8] for t in fresh)
            have, need = len(self.at), len(self.at) + len(fresh)
            self.at.update(zip(fresh, range(have, need), strict=True))
            if need > len(self.signs):
                more = np.zeros((max(need, 2 * len(self.signs)), 64), np.int8)
                more[:have] = self.signs[:have]
                self.signs = more
            self.signs[have:need] = 2 * np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).astype(np.int8) - 1
        rows = np.fromiter((self.at[t] for t in counts), np.int64, len(counts))
        weights = np.fromiter(counts.values(), np.float64, len(counts))
        bits = weights @ self.signs[rows] >= 0
        return int(np.packbits(bits).view(">i8")[0])


_similarity = Similarity()


def _evidence_of(text: str | None) -> tuple[int, int, str, int]:
    text = squash(unicodedata.normalize("NFKC", text or "").lower())
    tokens = _WORD.findall(text)
    raw = text.encode("utf-8", "surrogatepass")
    return len(text) + sum(c > "\uffff" for c in text) if not text.isascii() else len(text), len(tokens), hashlib.sha256(raw).hexdigest(), _similarity.hash(tokens)


EVIDENCE = "characters int, words int, sha256 string, simhash long"


def _evidence(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_evidence_of(x) for x in s], columns=["characters", "words", "sha256", "simhash"])


def evidence(text: Column) -> Column:
    """characters (UTF-16 units), words, sha256 and simhash of the normalized text: one Arrow pass, each row by itself, nothing is shuffled."""
    return F.pandas_udf(_evidence, EVIDENCE)(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def simhash(tokens: Column) -> Column:
    """Signed 64-bit similarity hash of an array of tokens: per bit the sum of token counts, +1 or -1 by the first
    64 bits of the token's SHA-256; a tie sets the bit; no tokens give 0."""
    digests = F.transform(tokens, lambda t: F.struct(F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(F.sha2(t, 256), 9, 8), 16, 10).cast("long").alias("lo")))
    start = F.array_repeat(F.lit(0), 64)

    def add(sums: Column, d: Column) -> Column:
        return F.transform(sums, lambda s, i: s + F.when(i < 32, F.call_function("shiftright", d["hi"], 31 - i)).otherwise(F.call_function("shiftright", d["lo"], 63 - i)).bitwiseAND(F.lit(1).cast("long")).cast("int") * 2 - 1)

    sums = F.aggregate(digests, start, add)
    bits = F.transform(sums, lambda s, i: F.when(s >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), 63 - i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(tokens) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))).otherwise(F.lit(0).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Six blocks of the 64 bits: (shift, width).
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def bands(simhash: Column) -> Column:
    """Twenty (number, bits) keys, the choices of three of six blocks: hashes within distance 3 leave three blocks equal, so they share one.

    A key holds 31 to 33 bits, so unlike hashes meet about once in four thousand million pairs."""
    block = [F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for at, width in _BLOCKS]
    keys = [F.shiftleft(block[a], 22).bitwiseOR(F.shiftleft(block[b], 11)).bitwiseOR(block[c]) for a, b, c in combinations(range(6), 3)]
    return F.array(*[F.struct(F.lit(k).alias("band"), key.alias("bits")) for k, key in enumerate(keys)])


def simhash_hex(simhash: Column) -> Column:
    return F.lpad(F.lower(F.hex(simhash)), 16, "0")
