"""Benchmark decontamination: a prefix-filtered join of item-sized word windows with documents.

A window is 10 consecutive words of an item (a shorter item is one window). Its shingles (5 words, or the whole of a
shorter window) are ordered by rarity over all documents; as containment must be full, the necessary prefix is the one
rarest shingle. Documents probe the prefix shingles; a place passes the positional and length bounds if the whole window fits
inside the document around it, its word hashes agree, and in the end its words themselves. Rarities are counted over all rows.

The benchmark's index is broadcast in blocks of items whose windows stay within `block` each (a longer item is dealt over several
blocks), so a large benchmark is several passes over the documents and never an unbounded broadcast. The blocks' results of a row meet by
the hash of its text.

Cases: null texts have no words; items without words give no window; equal windows belong to all their items; repeated
rows each give a row; an empty benchmark leaves every document clean; empty documents give an empty result; texts of any length are read
whole, a few megabytes or one text at a time; other columns are ignored by `hits` and kept by `clean`. A null item_id takes no part.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches
from quarry.llm.textkernel import PUNCT, U, column, grams, pieces, plain, spans, words

WINDOW, SHINGLE, BLOCK = 10, 5, 400_000
_FILTER = 20  # bits of the table that is asked before the sorted keys


class Index:
    """Prefix shingles of a block of items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, shingle: int):
        data, offsets = column(pa.array(texts, pa.string()))
        h, rows, starts, ends = spans(data, offsets, PUNCT)
        found: dict[bytes, tuple[np.ndarray, list[str]]] = {}
        for i, name in enumerate(ids):
            lo, hi = int(rows[i]), int(rows[i + 1])
            for a in range(lo, max(lo + 1, hi - window + 1) if hi > lo else lo):
                b = min(a + window, hi)
                found.setdefault(plain(data, starts[a:b], ends[a:b]), (h[a:b], []))[1].append(name)
        self.items = [sorted(set(names)) for _, names in found.values()]
        self.window, self.said = [v for v, _ in found.values()], list(found)
        self.parts = []  # shingles of each window, with their places
        for v in self.window:
            k = min(shingle, len(v))
            self.parts.append(grams(v, np.array([0, len(v)]), k)[0])
        self.width = np.array([min(shingle, len(v)) for v in self.window], np.int64)
        self.vocabulary = {int(k): np.unique(np.concatenate([p for p, x in zip(self.parts, self.width, strict=True) if x == k])) for k in np.unique(self.width)}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle and build the probe tables."""
        self.probe = {}
        for k, vocabulary in self.vocabulary.items():
            key, place, which = [], [], []
            for w in np.flatnonzero(self.width == k).tolist():
                n = counts[k][np.searchsorted(vocabulary, self.parts[w])]
                best = int(np.lexsort((self.parts[w], n))[0])
                key.append(self.parts[w][best])
                place.append(best)
                which.append(w)
            key, place, which = np.array(key, U), np.array(place), np.array(which)
            o = np.argsort(key, kind="stable")
            key = key[o]
            table = np.zeros(1 << _FILTER, bool)
            table[(key >> U(64 - _FILTER)).astype(np.int64)] = True
            self.probe[k] = table, key, place[o], which[o]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Word offsets of the rows, hit flags of the words, and the windows of each row that occur in it."""
        h, rows, starts, ends = spans(data, offsets, PUNCT)
        hit = np.zeros(len(h), bool)
        per: dict[int, set[int]] = {}
        for k, (table, key, place, which) in self.probe.items():
            g, at = grams(h, rows, k)
            near = np.flatnonzero(table[(g >> U(64 - _FILTER)).astype(np.int64)])
            lo = np.searchsorted(key, g[near], "left")
            hi = np.searchsorted(key, g[near], "right")
            some = hi > lo
            near, lo, hi = near[some], lo[some], hi[some]
            row = np.searchsorted(at, near, "right") - 1
            start = near - at[row] + rows[row]
            for s, r, a, b in zip(start.tolist(), row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for x in range(a, b):
                    first, v = s - int(place[x]), self.window[which[x]]
                    last = first + len(v)
                    if first < rows[r] or last > rows[r + 1] or not np.array_equal(h[first:last], v):
                        continue
                    if plain(data, starts[first:last], ends[first:last]) == self.said[which[x]]:
                        hit[first:last] = True
                        per.setdefault(r, set()).add(int(which[x]))
        return rows, hit, per


def _count(docs: DataFrame, vocabulary: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences of the index's shingles over all documents; as many sums as the index has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        tables = {}
        for k, v in shared.value.items():
            tables[k] = np.zeros(1 << _FILTER, bool)
            tables[k][(v >> U(64 - _FILTER)).astype(np.int64)] = True
        for b in batches:
            data, offsets = column(b.column(0))
            for lo, hi in pieces(offsets):
                part = offsets[lo : hi + 1]
                h, rows = words(data[part[0] : part[-1]], part - part[0], PUNCT)
                for k, v in shared.value.items():
                    g = grams(h, rows, k)[0]
                    g = g[tables[k][(g >> U(64 - _FILTER)).astype(np.int64)]]
                    i = np.minimum(np.searchsorted(v, g), len(v) - 1)
                    np.add.at(total[k], i[v[i] == g], 1)
        k = [k for k, v in total.items() for _ in range(np.count_nonzero(v))]
        i = np.concatenate([np.flatnonzero(v) for v in total.values()])
        n = np.concatenate([v[v > 0] for v in total.values()])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64())], ["k", "i", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in vocabulary.items()}
    for r in docs.select("text").mapInArrow(run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        out[r.k][r.i] = r.n
    return out


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _parts(text: str, window: int, block: int):
    """An item's text in parts of at most `block` windows that together have just its windows."""
    if len(text) // 2 + 1 <= block:
        yield text
        return
    kept: list[str] = []
    for m in _WORD.finditer(text):
        kept.append(m[0])
        if len(kept) == block + window - 1:
            yield " ".join(kept)
            kept = kept[len(kept) - window + 1 :]
    # Fewer words than a window are a part only if the item has no others.
    if len(kept) >= window or (kept and not _more(text, len(kept))):
        yield " ".join(kept)


def _more(text: str, n: int) -> bool:
    """Whether the text has more than n words."""
    return sum(1 for _ in islice(_WORD.finditer(text), n + 1)) > n


def _blocks(benchmark: DataFrame, window: int, shingle: int, block: int):
    """Items in blocks of bounded windows, read through an iterator that holds one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        for part in _parts(r.text, window, block):
            ids.append(r.item_id)
            texts.append(part)
            size += len(part) // 2 + 1
            if size >= block:
                yield Index(ids, texts, window, shingle)
                ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts, window, shingle)


def _pass(docs: DataFrame, index: Index | None, carry: list[str]) -> DataFrame:
    """docs(carry..., text) with n_words, hits (array of start, end of hit runs) and items for one block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.select(*carry).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches):
        for b in batches:
            n_words, runs, items = [], [], []
            data, offsets = column(b.column(len(carry)))
            for lo, hi in pieces(offsets):
                part = offsets[lo : hi + 1]
                text = data[part[0] : part[-1]], part - part[0]
                rows, hit, per = shared.value.scan(*text) if shared.value is not None else (words(*text, PUNCT)[1], None, {})
                n_words += np.diff(rows).tolist()
                for r in range(hi - lo):
                    if r not in per:
                        runs.append([])
                        items.append([])
                        continue
                    f = np.concatenate([[False], hit[rows[r] : rows[r + 1]], [False]]).astype(np.int8)
                    runs.append(np.flatnonzero(np.diff(f)).tolist())
                    items.append(sorted({x for w in per[r] for x in shared.value.items[w]}))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(carry))), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                [*carry, "n_words", "runs", "items"],
            )

    return docs.select(*carry, "text").mapInArrow(run, f"{types}, n_words long, runs array<long>, items array<string>")


def _ordered(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK):
    """Blocks of the benchmark that have windows, with their probe tables."""
    for index in _blocks(benchmark, window, shingle, block):
        if index.window:
            index.order(_count(docs, index.vocabulary))
            yield index


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, runs (starts and ends of hit words, alternating), items (sorted ids) of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = _ordered(docs, benchmark, window, shingle, block)
    first, second = next(found, None), next(found, None)
    if second is None:
        return _pass(docs, first, ["doc_id"])
    keyed = docs.withColumn("__text", F.sha2("text", 256))
    more = None
    for index in chain([second], found):
        one = _pass(keyed, index, ["__text"]).where(F.size("items") > 0).select("__text", "runs", "items")
        more = one if more is None else more.union(one)
    return _both(_pass(keyed, first, ["doc_id", "__text"]), more)


def _both(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Every row of the first block's pass with the hits of the other blocks, found by the hash of its text.

    Rows of equal text have equal hits, so the sets below hold one entry a block, however often a text is repeated."""
    more = more.groupBy("__text").agg(F.collect_set("runs").alias("r"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("i"))
    merged = rows.join(more, "__text", "left").withColumn("r", F.concat(F.array("runs"), F.coalesce("r", F.array().cast("array<array<bigint>>"))))
    spans = F.array_sort(F.flatten(F.transform("r", lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.when(F.size(x) > 0, F.named_struct(F.lit("a"), F.get(x, 2 * i), F.lit("b"), F.get(x, 2 * i + 1)))))))
    spans = F.filter(spans, lambda x: x.isNotNull())
    joined = F.aggregate(
        spans,
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["b"])))).otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
    )
    items = F.array_sort(F.array_union("items", F.coalesce("i", F.array().cast("array<string>"))))
    return merged.select("doc_id", "n_words", joined.alias("runs"), items.alias("items"))


def _without(docs: DataFrame, index: Index) -> DataFrame:
    """The rows that hold no window of one block. The decision is made where the text is: the whole row passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            ok = []
            data, offsets = column(b.column(at))
            for lo, hi in pieces(offsets):
                part = offsets[lo : hi + 1]
                per = shared.value.scan(data[part[0] : part[-1]], part - part[0])[2]
                ok += [r not in per for r in range(hi - lo)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows whose own text holds no window of the benchmark, whatever their doc_id; columns unchanged.

    Rows found by the blocks after the first go by the hash of their text, so a task holds one block at a time."""
    from quarry.llm.common import cut, small_side

    small_batches(docs.sparkSession)
    found = _ordered(docs, benchmark, **options)
    first = next(found, None)
    if first is None:
        return docs
    out, more = _without(docs, first), None
    for index in found:
        one = _pass(docs.select(F.sha2("text", 256).alias("__text"), "text"), index, ["__text"]).where(F.size("items") > 0).select("__text")
        more = one if more is None else more.union(one)
    if more is None:
        return out
    dirty = cut(more.distinct())
    rows = out.select(F.struct(*out.columns).alias("d"), F.sha2("text", 256).alias("__text"))
    return rows.join(small_side(dirty), "__text", "left_anti").select("d.*")


def op8(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = hits(docs, items)
    # runs alternate starts and ends, so the hit words are the ends minus the starts
    n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(x) AS k, array_to_string(x, ' ') AS v FROM (
  SELECT item_id, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: w[i + 1:i + 10])) AS x FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
o AS (SELECT rid, k, unnest(range(greatest(len(w) - k + 1, 0))) AS s, w FROM d, ks WHERE len(w) >= k),
m AS (SELECT rid, s, bw.k, item_id FROM o JOIN bw ON bw.k = o.k AND bw.v = array_to_string(o.w[s + 1:s + o.k], ' ')),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM m) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
