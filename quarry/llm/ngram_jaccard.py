"""N-gram Jaccard join (rare-first prefix filter with length, positional and suffix filters) and its components.

Plan, over documents (doc_id, text), stored once with a key of their own for every row (ids may be null or repeated):

1. Count sketches of fixed size over all shingles (2**sketch_bits counters) and all words (2**word_bits) give the global
   rare-first order: counters of shingles as far as they stand out from a full sketch, then the counts of the five words.
   A sketch of shingles fills up as the table grows; words are few, so their counts stay apart.
2. Every text yields its set size, a 128-bit fingerprint of the set, and its prefix: the n - ceil(t n) + 1 rarest
   shingles. Equal sets collapse into one class, named by its smallest row key (partial aggregates, so a group holding a
   third of all rows collapses before the shuffle); the other rows of a class are told by their keys alone.
3. Prefixes of the named rows are exploded into posting lists. A list of at most `few` classes gives its pairs; those whose parity bitmaps
   differ in more bits than a link's sets may in shingles go, so texts that share one shingle by chance are not tied. In a
   longer list, ordered by set size, every class is tied to the first class of
   its run; a run ends where the next size breaks the length filter, so a run holds every pair the list can give.
   Ties make "families" (connected components): each pair that may link lies inside one family.
4. A family's texts meet in blocks of at most `block` classes. Inside, postings give candidates, length, positional and
   suffix filters thin them, and overlaps are counted once per pair; pairs already connected are skipped.
   A family larger than a block first runs block by block; then only classes outside its largest component
   meet the other blocks, so a huge group of near copies costs one pass and not all its pairs.
5. Components of links and classes give component_id, their smallest doc_id.

Cases: null or wordless text has n_shingles 0 and stands alone; rows with a null doc_id take part and get
component_id null unless their component has an id; repeated rows are copies of each other; rows that share a doc_id but no
words are different documents; ties in the order are broken by the hash; an empty table gives an empty result; other columns are ignored.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import BROADCAST_ROWS, cut, free_shuffles, remove, renamed, shared_folder, small_batches, small_side, stored, union
from quarry.llm.graph import components as connected
from quarry.llm.textkernel import U, column, gram_pieces, mix, sets_of, shingle_sets, weighed_sets

WIDTH, PERCENT, SKETCH_BITS, WORD_BITS, BLOCK, HOT_LIST, FEW = 5, 80, 23, 22, 1024, 4096, 64
_SLICES = 256


def _sketch(docs: DataFrame, width: int, bits: int, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of shingles (once per document) and of words (every place) over all rows: 2**bits and 2**word_bits hashed counters, in one byte each; the sizes are fixed."""

    def count(batches):
        total, words = np.zeros(1 << bits, np.uint32), np.zeros(1 << word_bits, np.uint32)
        for b in batches:
            for piece in gram_pieces(*column(b.column(0)), width):
                np.add.at(words, (piece[0] >> U(64 - word_bits)).astype(np.int64), 1)
                for s in sets_of(*piece, width):
                    np.add.at(total, (s >> U(64 - bits)).astype(np.int64), 1)
        parts = [zlib.compress(p.tobytes(), 1) for t in (total, words) for p in t.reshape(_SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * _SLICES), pa.int32()), pa.array(parts, pa.binary())], ["k", "c"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
                sums[k] = sums[k] + c if k in sums else c
        coded = [(scale if k < _SLICES else weight)(v).tobytes() for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coded, pa.binary())], ["k", "c"])

    parts = docs.select("text").mapInArrow(count, "k int, c binary").repartition("k").mapInArrow(add, "k int, c binary").collect()
    shingles, words = (np.zeros((_SLICES, (1 << n) // _SLICES), np.uint8) for n in (bits, word_bits))
    for r in parts:
        (shingles if r.k < _SLICES else words)[r.k % _SLICES] = np.frombuffer(r.c, np.uint8)
    return standing_out(shingles.reshape(-1)), words.reshape(-1)


def scale(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each, order kept: exact to 127, then 8 steps a doubling."""
    steps = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(steps, 255)).astype(np.uint8)


def weight(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each, 8 steps a doubling, so that sums of weights are in the order of products of counts."""
    return np.minimum(np.floor(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def standing_out(sketch: np.ndarray) -> np.ndarray:
    """The scaled counters, those within three deviations of the usual load of a counter made equal: a full counter says nothing of one shingle."""
    usual = float(np.median(sketch))
    usual = usual if usual < 128 else 128 * 2 ** ((usual - 128) / 8)
    return np.maximum(sketch, scale(np.array(usual + 3 * usual**0.5)))


def rare_first(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set (sorted by hash) in the global order: rarest counter first, then by hash."""
    bits = U(64 - (len(sketch).bit_length() - 1))
    return s[np.argsort(sketch[(s >> bits).astype(np.int64)], kind="stable")]


def rarest(s: np.ndarray, sums: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """As `rare_first`; shingles of equal counters go by the sums of their words' weights."""
    bits = U(64 - (len(sketch).bit_length() - 1))
    return s[np.argsort((sketch[(s >> bits).astype(np.int64)].astype(np.int64) << 32) + sums, kind="stable")]


def prefix_length(n, percent: int):
    return n - (-(-percent * n // 100)) + 1


def parity(m: np.ndarray) -> bytes:
    """Whether an even or odd number of a set's hashes falls on each bit, with a bit a shingle or more (2**15 at most).

    Two sets differ in at least as many shingles as their bitmaps do in bits; the larger bitmap folds to the smaller one."""
    size = min(1 << 15, max(64, 1 << (len(m) - 1).bit_length()))
    return np.packbits(np.bincount((m & U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def may_link(n: int, x: bytes, k: int, y: bytes, percent: int) -> bool:
    """False where the parity bitmaps x, y of sets of n, k shingles show that these do not link; else True."""
    if len(x) < len(y):
        x, y = y, x
    v, size = int.from_bytes(x, "little"), 4 * len(x)
    while size >= 8 * len(y):
        v, size = (v >> size) ^ (v & ((1 << size) - 1)), size // 2
    return (v ^ int.from_bytes(y, "little")).bit_count() <= n + k - 2 * (-(-percent * (n + k) // (100 + percent)))


def _signatures(docs: DataFrame, sketch, weights, width: int, percent: int) -> DataFrame:
    def run(batches):
        for b in batches:
            n, f1, f2, prefixes, parities = [], [], [], [], []
            with np.errstate(over="ignore"):
                for s, sums in weighed_sets(*column(b.column(1)), width, weights.value):
                    m = mix(s + U(0x632BE59BD9B4E019))
                    n.append(len(s))
                    f1.append(int(m.sum(dtype=U).view(np.int64)))
                    f2.append(int(mix(m).sum(dtype=U).view(np.int64)))
                    parities.append(parity(m) if len(m) else b"")
                    prefixes.append(rarest(s, sums, sketch.value)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat), pa.array(parities, pa.binary())],
                ["row", "doc_id", "n", "f1", "f2", "prefix", "parity"],
            )

    return docs.select("row", "text", "doc_id").mapInArrow(run, "row long, doc_id long, n int, f1 long, f2 long, prefix array<long>, parity binary")


def _named(sig: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of sig that name their class (the smallest of its keys). Only keys and fingerprints are shuffled."""
    full = sig.where("n > 0")
    names = full.groupBy("f1", "f2").agg(F.min("row").alias("row")).select("row")
    return _without(full, stored(full.select("row").join(names, "row", "left_anti")), limit)


def _without(rows: DataFrame, gone: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows(row, ...) without the keys of gone(row), a stored table. Keys too many for one broadcast go by ranges of row, so that rows are not shuffled."""
    parts = []
    for low, high in _ranges(gone, "row", limit):
        within = (F.col("row") >= low) & (F.col("row") < high)
        parts.append(rows.where(within).join(small_side(gone.where(within), limit), "row", "left_anti"))
    return union(parts)


def _ranges(keys: DataFrame, column: str, limit: int) -> list[tuple[int, int]]:
    """Ranges that cover all row keys, each with at most `limit` of keys unless those of one partition are more."""
    starts, held = [0], 0
    for p, k in sorted(tuple(r) for r in keys.groupBy(F.shiftright(column, 33).alias("p")).count().collect()):
        if held and held + k > limit:
            starts.append(p << 33)
            held = 0
        held += k
    return list(zip(starts, [*starts[1:], (1 << 63) - 1], strict=True))


def _lists(sig: DataFrame, classes: DataFrame, percent: int, hot: int, bits: int = 18, few: int = FEW, folder: str | None = None) -> DataFrame:
    """Ties (a, b) between classes (the rows of sig that name one) that share a prefix shingle and may pass the length filter, and the parity filter where at most `few` share it."""
    bucket = F.shiftrightunsigned("h", 64 - bits).cast("int")
    load = stored(sig.select(F.explode("prefix").alias("h")).groupBy(bucket.alias("bucket")).count())
    free_shuffles(sig.sparkSession)
    most = max(hot, 4 * (load.agg(F.avg("count")).first()[0] or 0))  # so at most a quarter of the counters are hot
    heavy = F.broadcast(load.where(F.col("count") > most).select("bucket", F.ceil(F.col("count") / hot).cast("int").alias("ways")))
    p = classes.select(F.col("row").alias("rep"), "n", F.explode("prefix").alias("h")).withColumn("bucket", bucket).join(heavy, "bucket", "left")
    p = p.select("h", "n", "rep", F.coalesce(F.pmod(F.xxhash64("rep"), "ways"), F.lit(-1)).cast("int").alias("salt"))
    p = p.withColumn("c", F.count("*").over(Window.partitionBy("h", "salt"))).where("c > 1 or salt >= 0")
    p = stored(p, folder)  # most shingles have one class; the rest is read three times
    free_shuffles(p.sparkSession)
    short = (F.col("salt") < 0) & (F.col("c") <= few)
    pairs = _likely(_pairs(p.where(short), percent), sig, percent)
    p = p.where(~short)
    w = Window.partitionBy("h", "salt").orderBy("n", "rep")
    gap = F.lag("n").over(w).isNull() | ((F.col("salt") < 0) & (100 * F.lag("n").over(w).cast("long") < percent * F.col("n")))
    p = p.withColumn("gap", gap)
    p = p.withColumn("lead", F.last(F.when(F.col("gap"), F.col("rep")), ignorenulls=True).over(w))
    ties = p.where("rep != lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    # A hot list was dealt out by salt, without length runs; the firsts of its parts are tied too.
    firsts = p.where("salt >= 0 and gap")
    ahead = Window.partitionBy("h").orderBy("n", "rep")
    across = firsts.select(F.col("rep").alias("a"), F.lag("rep").over(ahead).alias("b")).where("b is not null and a != b")
    return pairs.union(ties).union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs(p: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of the same list that pass the length filter; lists of the same classes count once."""
    lists = p.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "rep"))).alias("m")).select("m").distinct()
    firsts = lists.select("m", F.posexplode("m").alias("i", "x"))
    pairs = firsts.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    pairs = pairs.where(100 * F.col("x.n").cast("long") >= percent * F.col("y.n").cast("long"))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _likely(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) without those whose parity bitmaps exclude a link."""
    for k in ("a", "b"):
        pairs = pairs.join(sig.select(F.col("row").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}")), k)

    def run(batches):
        for b in batches:
            ok = [may_link(*r, percent) for r in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "n_a", "parity_a", "n_b", "parity_b").mapInArrow(run, "a long, b long")


def links_of(sets: list[np.ndarray], sketch: np.ndarray, percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j), j < i, among the sets that connect all whose Jaccard reaches the threshold; with `side`, only
    pairs of different sides are compared. known: labels of sets already connected."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    keep = prefix_length(n, percent)
    prefix = [rare_first(s, sketch)[:k] for s, k in zip(sets, keep, strict=True)]
    owner, place = np.repeat(np.arange(m), keep), np.concatenate([np.arange(k) for k in keep])
    token = np.concatenate(prefix)
    order = np.lexsort((owner, token))
    token, owner, place = token[order], owner[order], place[order]
    parent = list(range(m))
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known):
            parent[i] = first.setdefault(int(k), i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Sizes of the sets' parts in 16 ranges of hashes, for the suffix filter.
    edges = np.array([k << 60 for k in range(1, 16)], U)
    split = np.stack([np.diff(np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])) for s in sets])
    full: tuple[np.ndarray, np.ndarray] | None = None
    out = []
    lo, hi = np.searchsorted(token, token, "left"), np.searchsorted(token, token, "right")
    mine = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[mine], np.arange(m + 1))
    for i in range(1, m):
        own = mine[bounds[i] : bounds[i + 1]]
        own = own[hi[own] - lo[own] > 1]
        if not len(own):
            continue
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[own], hi[own], strict=True)])
        mypos = np.repeat(place[own], hi[own] - lo[own])
        js = owner[at]
        least = -(-percent * (n[i] + n[js]) // (100 + percent))
        ok = (js < i) & (100 * np.minimum(n[i], n[js]) >= percent * np.maximum(n[i], n[js]))
        ok &= 1 + np.minimum(n[i] - mypos - 1, n[js] - place[at] - 1) >= least
        js = np.unique(js[ok])
        if side is not None:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        least = -(-percent * (n[i] + n[js]) // (100 + percent))
        js = js[np.abs(split[js] - split[i]).sum(1) <= n[i] + n[js] - 2 * least]
        root = find(i)
        js = js[[find(j) != root for j in js.tolist()]] if len(js) else js
        if not len(js):
            continue
        if len(js) > 16:  # overlaps with all at once
            if full is None:
                tokens, owners = np.concatenate(sets), np.repeat(np.arange(m), n)
                o = np.argsort(tokens, kind="stable")
                full = tokens[o], owners[o]
            a, b = np.searchsorted(full[0], sets[i], "left"), np.searchsorted(full[0], sets[i], "right")
            both = np.bincount(np.concatenate([full[1][x:y] for x, y in zip(a, b, strict=True)]), minlength=m)[js]
        else:
            both = None
        for k, j in enumerate(js.tolist()):
            r = find(j)
            if r == root:
                continue
            shared = int(both[k]) if both is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (int(n[i]) + int(n[j]) - shared):
                out.append((i, j))
                parent[max(r, root)] = root = min(r, root)
    return out


def _evaluate(members: DataFrame, keys: list[str], sketch, width: int, percent: int, sides: bool = False) -> DataFrame:
    """Links (a, b) inside every group of members (keys..., rep, text[, side, comp]); groups hold a few thousand texts at most."""
    cols = [*keys, "rep", "text", *(["side", "comp"] if sides else [])]

    def run(batches):
        kept: tuple | None = None
        reps, sets, extra = [], [], []

        def finish():
            if len(reps) < 2:
                return []
            if sides:
                e = np.array(extra)
                got = links_of(sets, sketch.value, percent, e[:, 0], e[:, 1])
            else:
                got = links_of(sets, sketch.value, percent)
            return [(reps[i], reps[j]) for i, j in got]

        for b in batches:
            found: list[tuple[int, int]] = []
            names = list(zip(*(b.column(k).to_pylist() for k in range(len(keys))), strict=True))
            more = list(zip(b.column(len(cols) - 2).to_pylist(), b.column(len(cols) - 1).to_pylist(), strict=True)) if sides else None
            for i, s in enumerate(shingle_sets(*column(b.column(len(keys) + 1)), width)):
                if names[i] != kept:
                    found += finish()
                    kept, reps, sets, extra = names[i], [], [], []
                reps.append(b.column(len(keys))[i].as_py())
                sets.append(s)
                if more:
                    extra.append(more[i])
            yield pairs(found)
        yield pairs(finish())

    def pairs(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return members.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a long, b long")


def _large(members: DataFrame, sketch, width: int, percent: int, block: int) -> DataFrame:
    """Links of the families larger than a block: members (fam, size, rep, text)."""
    rows = members.withColumn("blk", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / block).cast("long")).cast("int"))
    rows = cut(rows)
    inside = cut(_evaluate(rows, ["fam", "blk"], sketch, width, percent))
    label = connected(inside)
    rows = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    # The largest component of each block; those of neighbouring blocks are compared.
    sizes = rows.groupBy("fam", "blk", "comp").count()
    tops = sizes.groupBy("fam", "blk").agg(F.max_by("comp", F.struct("count", "comp")).alias("rep"))
    tops = tops.join(rows.select("rep", "text"), "rep").withColumn("pair", F.explode(F.array("blk", F.col("blk") + 1)))
    bridge = cut(_evaluate(tops, ["fam", "pair"], sketch, width, percent))
    merged = connected(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(bridge))
    rows = rows.drop("comp").join(merged.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    counts = rows.groupBy("fam", "comp").agg(F.count("*").alias("k"), F.max("size").alias("size"))
    major = counts.groupBy("fam").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.sum(F.lit(1)).alias("comps"))
    rows = cut(rows.join(major.where("comps > 1"), "fam"))
    # Those outside it meet the members of every other block; two of them meet in the blocks of each.
    outside = rows.where("comp != major").withColumn("yblk", F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("size") / block).cast("long")).cast("int"))
    used = outside.select("fam", "yblk", "size").distinct()
    used = used.withColumn("blk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block) - 1).cast("int")))).drop("size")
    left = outside.drop("blk").join(used, ["fam", "yblk"]).select("fam", "yblk", "blk", "rep", "text", F.lit(0).alias("side"), "comp")
    right = rows.join(used, ["fam", "blk"]).select("fam", "yblk", "blk", "rep", "text", F.lit(1).alias("side"), "comp")
    crossed = _evaluate(left.union(right), ["fam", "yblk", "blk"], sketch, width, percent, sides=True).where("a != b")
    return inside.union(bridge).union(crossed)


def _keyed(docs: DataFrame) -> DataFrame:
    """d (the whole row, so that no column name matters) and row (a key of its own), stored: keys of rows that are computed again could differ."""
    return stored(docs.select(F.struct(*docs.columns).alias("d"), F.monotonically_increasing_id().alias("row")), compression="zstd")


def _beside(docs: DataFrame, family: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """family(rep, ...) with the text of docs(row, text), row = rep. A family table too large for one broadcast goes by
    ranges of row, which lie in files of their own, so no text without a family is shuffled."""
    ranges = _ranges(family, "rep", limit)
    texts = docs.select(F.col("row").alias("rep"), "text")
    if len(ranges) < 2:
        return texts.join(small_side(family, limit), "rep")
    family = stored(family)
    within = [(F.col("rep") >= low) & (F.col("rep") < high) for low, high in ranges]
    return union([texts.where(w).join(small_side(family.where(w), limit), "rep") for w in within])


def _components(docs: DataFrame, width: int, percent: int, block: int, hot: int, few: int = FEW) -> DataFrame:
    """docs(row, doc_id, text) -> row, doc_id, n, label (the component's smallest row; null without words), component (its smallest doc_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    sketch, weights = map(spark.sparkContext.broadcast, _sketch(docs, width, SKETCH_BITS, WORD_BITS))
    free_shuffles(spark)
    sig = cut(_signatures(docs, sketch, weights, width, percent))
    full = sig.where("n > 0")
    folder = shared_folder(spark, "lists")
    family = connected(_lists(sig, _named(sig), percent, hot, few=few, folder=folder))
    remove(spark, folder)
    free_shuffles(spark)
    sizes = cut(family.groupBy("label").agg(F.count("*").alias("size")))
    family = renamed(family, "label", sizes, "size").select(F.col("label").alias("fam"), "size", F.col("node").alias("rep"))
    # Texts of the classes that have a partner, one row each.
    members = cut(_beside(docs, family))
    free_shuffles(spark)
    links = _evaluate(members.where(F.col("size") <= block), ["fam"], sketch, width, percent)
    if not (big := members.where(F.col("size") > block)).isEmpty():
        links = links.union(_large(big, sketch, width, percent, block))
    linked = connected(links)
    free_shuffles(spark)
    ids = full.groupBy("f1", "f2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"))
    ids = cut(ids.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "least", F.coalesce("label", "rep").alias("label"), F.col("label").isNotNull().alias("tied")))
    names = cut(ids.where("tied").groupBy("label").agg(F.min("least").alias("component")))
    ids = renamed(ids, "label", names, "component")
    # The classes by fingerprint: copies by the thousand share one, so their rows are split like those of a component.
    of = F.struct("label", F.when(F.col("tied"), F.col("component")).otherwise(F.col("least")).alias("component"))
    ids = cut(ids.select(F.struct("f1", "f2").alias("f"), of.alias("of")))
    out = renamed(sig.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.struct("f1", "f2")).alias("f")), "f", ids, "of", limit=100_000)
    return out.select("row", "doc_id", "n", "of.label", "of.component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, hot: int = HOT_LIST, few: int = FEW) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = _keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    out = _components(docs.select("row", "d.*"), width, percent, block, hot, few)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one row (of the smallest doc_id; one without id only where none has an id) of each component.

    Of rows without words, those that repeat a doc_id go. Columns unchanged."""
    keyed = _keyed(docs)
    found = _components(keyed.select("row", F.col("d.doc_id").cast("long").alias("doc_id"), "d.text"), WIDTH, PERCENT, BLOCK, HOT_LIST)
    # A group is a component, or the wordless rows of one doc_id; a wordless row without id is in none.
    found = cut(found.select("row", "doc_id", F.col("label").isNull().alias("blank"), F.coalesce("label", "doc_id").alias("of")).where("of is not null"))
    first = found.groupBy("blank", "of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row"))["row"].alias("row"))
    gone = found.join(first.select("row"), "row", "left_anti").select("row")
    return _without(keyed, cut(gone)).select("d.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
