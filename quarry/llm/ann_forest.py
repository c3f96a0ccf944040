"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest: Bawa, Condie and Ganesan, 2005).

A tree turns a vector into a string of `digits` symbols: the vector is rotated at random, and the symbols name its largest
coordinates with their signs, the largest first (cross-polytope hashing, which on nearly isotropic vectors keeps more neighbours per
candidate than random hyperplanes). Vectors that share a longer prefix in a tree lie closer.

Every row is indexed: an Arrow batch of rows becomes `trees` sorted arrays of hash strings. A query descends each tree to its
longest matching prefix and ascends all trees together. How far it ascends is fixed before the search: the ends (length of the
prefix, number of trees that share it) are counted over a bounded sample of rows, and a query takes the deepest end whose
candidates would be max(`least`, `share` of the rows). So its candidates depend on the rows alone, not on how they are dealt over files,
batches or tasks. Candidates are ranked by exact Euclidean distance in double precision; a task keeps the best k of a query over all its rows,
and those of the tasks are merged by partial top-k. Queries are read in blocks of bounded size, one block after the other, so neither
the driver nor a task holds an unbounded set of them.

Embeddings without cluster structure need a large share for high recall (see the README for the measured curve); clustered ones
allow a far smaller one.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; a query meets vectors of its own
length only; rows with the query's own vec_id are no candidates; a null vec_id takes no part; repeated rows are
candidates each, of which the nearest is kept and counts once; a repeated query id searches with its smallest vector; equal distances go
to the smaller vec_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import shared_folder, union

TREES, DIGITS, SHARE, LEAST, NEAREST, EVERY, BLOCK, SAMPLE, SEED = 128, 3, 0.1, 200, 10, 100, 2048, 20_000, 5
_ROWS, _CELLS, _WIDEST = 4096, 1 << 22, 64


class Hash:
    """Hash strings of vectors of one length."""

    def __init__(self, length: int, trees: int = TREES, digits: int = DIGITS, seed: int = SEED):
        self.trees, self.width = trees, min(length, _WIDEST)
        self.digits = min(digits, self.width)
        self.base = 2 * self.width
        rng = np.random.default_rng([seed, length])
        self.turn = [self._rotation(rng, length) for _ in range(trees)]

    def _rotation(self, rng, length: int) -> np.ndarray:
        g = rng.standard_normal((length, self.width))
        return (np.linalg.qr(g)[0] if length <= 1024 else g).astype(np.float32)

    def codes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The strings as numbers; one digit more to the left is one symbol earlier."""
        y = x @ self.turn[tree]
        size, at, out = np.abs(y), np.arange(len(y)), np.zeros(len(y), np.int64)
        for _ in range(self.digits):
            k = size.argmax(1)
            out = out * self.base + 2 * k + (y[at, k] > 0)
            size[at, k] = -1
        return out


def ends(codes: Hash, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(queries, rows): length of the longest prefix shared in any tree * (trees + 1) + number of trees that share one as long."""
    best = np.zeros((len(q), len(x)), np.uint16)
    votes = codes.trees + 1
    flat = best.reshape(-1)
    for tree in range(codes.trees):
        mine, asked = codes.codes(x, tree), codes.codes(q, tree)
        order = np.argsort(mine, kind="stable")
        mine = mine[order]
        for length in range(1, codes.digits + 1):
            step = codes.base ** (codes.digits - length)
            head = asked // step
            lo, hi = np.searchsorted(mine, head * step, "left"), np.searchsorted(mine, (head + 1) * step, "left")
            n = hi - lo
            some = np.flatnonzero(n)
            if not len(some):
                break
            n = n[some]
            at = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(some * len(x), n) + order[at]
            # a longer prefix starts its own count; one more tree with an equal one adds to it
            flat[cell] = np.maximum(flat[cell], length * votes - 1) + (flat[cell] < (length + 1) * votes)
    return best


def _merge(found: dict, i: int, ids: np.ndarray, d: np.ndarray, k: int) -> None:
    """Keep the k nearest distinct ids of query i, ties to the smaller id."""
    if i in found:
        ids, d = np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], d])
    o = np.lexsort((d, ids))
    ids, d = ids[o], d[o]
    one = np.concatenate([[True], ids[1:] != ids[:-1]])
    ids, d = ids[one], d[one]
    o = np.lexsort((ids, d))[:k]
    found[i] = ids[o], d[o]


def nearest_in(found: dict, codes: Hash, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, floor: np.ndarray, k: int) -> None:
    """Merge into found each query's k nearest of its candidates among the rows x."""
    step = max(1, _CELLS // max(1, len(q)))
    for a in range(0, len(x), step):
        part, names = x[a : a + step], ids[a : a + step]
        reached = ends(codes, part, q)
        norms = np.einsum("ij,ij->i", part, part)
        for i in range(len(q)):
            c = np.flatnonzero((reached[i] >= floor[i]) & (names != qids[i]))
            if not len(c):
                continue
            if i in found and len(found[i][0]) == k:  # rough distances first: rows beyond the k-th so far are out
                own = q[i] @ q[i]
                rough = norms[c] - 2 * (part[c] @ q[i]) + own
                far = found[i][1][-1] ** 2
                c = c[rough <= far + 1e-9 * (far + norms[c] + own)]
                if not len(c):
                    continue
            _merge(found, i, names[c], np.sqrt(((part[c] - q[i]) ** 2).sum(1)), k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    ok = (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda c: c != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)


def _by_length(part: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    ids, vectors = part.column(0).to_pylist(), part.column(1).to_pylist()
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        g = groups.setdefault(len(v), ([], []))
        g[0].append(i)
        g[1].append(v)
    return {n: (np.array(i, np.int64), np.array(v, np.float64)) for n, (i, v) in groups.items()}


def _groups(batches, lengths):
    """(length, ids, vectors) of the rows of some lengths, in parts of bounded size."""
    for b in batches:
        values = b.column(1)
        size, start = np.diff(values.offsets.to_numpy()), values.offsets.to_numpy()[:-1]
        flat, ids = values.values.to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
        for n in lengths:
            some = np.flatnonzero(size == n)
            for a in range(0, len(some), _ROWS):
                part = some[a : a + _ROWS]
                yield n, ids[part], flat[(start[part][:, None] + np.arange(n)).ravel()].reshape(-1, n)


def _floors(sample: DataFrame, shared, rows: dict[int, int], seen: dict[int, int], share: float, least: int, trees: int, digits: int) -> dict[int, np.ndarray]:
    """Per length, each query's end: the deepest whose candidates among all rows would be enough."""

    def run(batches):
        counts = {n: np.zeros((len(i), (digits + 1) * (trees + 1) + 1), np.int64) for n, (i, _) in shared.value.items()}
        hashes: dict[int, Hash] = {}
        for n, _, x in _groups(batches, list(counts)):
            q = shared.value[n][1]
            codes = hashes.setdefault(n, Hash(n, trees, digits))
            step = max(1, _CELLS // len(q))
            for a in range(0, len(x), step):
                reached = ends(codes, x[a : a + step], q)
                for i in range(len(q)):
                    counts[n][i] += np.bincount(reached[i], minlength=counts[n].shape[1])
        out = [(n, i, e, int(c[i, e])) for n, c in counts.items() for i, e in zip(*map(np.ndarray.tolist, np.nonzero(c)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["n", "i", "e", "c"])

    got = sample.mapInArrow(run, "n long, i long, e long, c long").groupBy("n", "i", "e").agg(F.sum("c").alias("c")).toArrow().to_pydict()
    total = {n: np.zeros((len(i), (digits + 1) * (trees + 1) + 1), np.int64) for n, (i, _) in shared.value.items()}
    for n, i, e, c in zip(got["n"], got["i"], got["e"], got["c"], strict=True):
        total[n][i, e] = c
    out = {}
    for n, c in total.items():
        want = max(least, share * rows[n]) * seen[n] / rows[n]
        deeper = c[:, ::-1].cumsum(1)[:, ::-1]
        # The largest end that at least `want` sampled rows reach; none: every row is a candidate.
        out[n] = np.where(deeper >= want, np.arange(c.shape[1]), 0).max(1)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, share: float = SHARE, least: int = LEAST, block: int = BLOCK, trees: int = TREES, digits: int = DIGITS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. queries(vec_id, embedding) is a subset kept apart."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = {r.n: r.rows for r in rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).collect()}
    blocks = max(1, -(-asked.count() // block))
    drawn = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(1, sum(sizes.values())))))
    few = rows.where(drawn) if sum(sizes.values()) > sample else rows
    seen = {r.n: r.rows for r in few.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).collect()}
    parts, folder = [], shared_folder(spark, "neighbours") if blocks > 1 else None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        shared = spark.sparkContext.broadcast(_by_length(part))
        floors = _floors(few, shared, sizes, {n: seen.get(n, 0) for n in sizes}, share, least, trees, digits)
        one = rows.mapInArrow(_searcher(shared, floors, k, trees, digits), "query_id long, vec_id long, score double")
        if folder:  # a block is done before the next one is read
            one.write.parquet(f"{folder}/{b}")
            shared.destroy()
            one = spark.read.parquet(f"{folder}/{b}")
        parts.append(one)
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = union(parts).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, floors: dict[int, np.ndarray], k: int, trees: int, digits: int):
    def run(batches):
        found: dict[int, dict] = {n: {} for n in shared.value}
        hashes: dict[int, Hash] = {}
        for n, ids, x in _groups(batches, list(found)):
            qids, q = shared.value[n]
            nearest_in(found[n], hashes.setdefault(n, Hash(n, trees, digits)), x, ids, q, qids, floors[n], k)
        out = [(shared.value[n][0][i], ids, d) for n, of in found.items() for i, (ids, d) in of.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([int(q) for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64), pa.int64()),
                pa.array(np.concatenate([i for _, i, _ in out]) if out else [], pa.int64()),
                pa.array(np.concatenate([d for _, _, d in out]) if out else [], pa.float64()),
            ],
            ["query_id", "vec_id", "score"],
        )

    return run


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
