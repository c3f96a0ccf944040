"""N-gram Jaccard join, components, decontamination: against brute force, with hot groups and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import decontaminate, ngram_jaccard
from quarry.llm.common import renamed
from quarry.llm.graph import components
from quarry.llm.textkernel import PUNCT, SPACES, column, shingle_sets, weighed_sets, words

LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, families=25, most=12):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 120))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.randint(1, most)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(w)) if len(w) > 1 else 0
                w[k : k + 1] = r.choice([[], ["NEW"], [w[k], "more"]] if len(w) > 1 else [["NEW"]])
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w)))
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two three four"), (906, "one two three four"), (907, "one two three four five"), (908, "z " * 40000), (909, "z z z z z")]


@pytest.mark.parametrize(("block", "hot"), [(1024, 4096), (8, 3)])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, documents, block, hot, seed):
    rows = corpus(seed) + EDGES
    got = ngram_jaccard.near_duplicates(documents(rows), block=block, hot=hot)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_components_over_whole_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_jaccard.op9(spark, tiny).collect())) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    text = " ".join(f"t{k}" for k in range(30))
    got = ngram_jaccard.near_duplicates(documents([(5, text), (5, text), (None, text), (None, "alone"), (3, text + " x")]))
    assert Counter(map(tuple, got.collect())) == Counter([(5, 26, 3), (5, 26, 3), (None, 26, 3), (None, 1, None), (3, 27, 3)])
    assert ngram_jaccard.near_duplicates(documents([])).count() == 0


def test_keep_one_leaves_one_of_each_group(spark, documents):
    text = " ".join(f"t{k}" for k in range(30))
    docs = documents([(5, text), (5, text), (3, text + " x"), (8, "other words"), (9, None), (None, "no id")])
    out = ngram_jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 3, 8, 9]


def test_filters_lose_nothing():
    r = random.Random(3)
    base = np.unique(np.array([r.getrandbits(64) for _ in range(200)], np.uint64))
    sets = [np.unique(np.concatenate([r.sample(list(base), 180), np.array([r.getrandbits(64) for _ in range(r.randint(0, 40))], np.uint64)]).astype(np.uint64)) for _ in range(40)]
    sketch = np.zeros(1 << 10, np.uint8)
    links = ngram_jaccard.links_of(sets, sketch, 80)
    parent = list(range(40))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        assert 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        parent[find(i)] = find(j)
    for i in range(40):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                assert find(i) == find(j)


def test_texts_that_share_one_shingle_are_not_tied(spark, documents, monkeypatch):
    # A ring of texts, each with five words of the next: chance alone must not make one family of all.
    r = random.Random(8)
    own = [" ".join(f"w{r.randrange(10**9)}" for _ in range(30)) for _ in range(120)]
    ring = [" ".join([*own[i - 1].split()[-5:], own[i]]) for i in range(120)]
    rows = [*enumerate(ring), *((1000 + i, f"{ring[i]} x") for i in range(0, 120, 10))]
    texts = []
    monkeypatch.setattr(ngram_jaccard, "SKETCH_BITS", 8)  # full counters, as of a large table
    beside = ngram_jaccard._beside
    monkeypatch.setattr(ngram_jaccard, "_beside", lambda docs, family, **k: texts.append(family.count()) or beside(docs, family, **k))
    assert sorted(map(tuple, ngram_jaccard.near_duplicates(documents(rows)).collect())) == brute(rows)
    assert texts == [24]


def test_the_pipeline_compares_no_texts_that_share_one_shingle(spark, documents, monkeypatch):
    r = random.Random(9)
    own = [" ".join(f"w{r.randrange(10**9)}" for _ in range(30)) for _ in range(60)]
    rows = [(i, " ".join([*own[i - 1].split()[-5:], own[i]])) for i in range(60)]
    sizes = []
    monkeypatch.setattr(ngram_jaccard, "SKETCH_BITS", 8)  # full counters, as of a large table: rare shingles do not stand out
    renamed = ngram_jaccard.renamed
    monkeypatch.setattr(ngram_jaccard, "renamed", lambda rows, column, *a, **k: (column == "label" and "node" in rows.columns and sizes.append(rows.count())) or renamed(rows, column, *a, **k))
    out = corpus_pipeline.deduplicate(spark, documents([*rows, (100, rows[0][1] + " x")]), "")
    assert sorted(x.doc_id for x in out.collect()) == list(range(60))
    assert sizes == [2]


def test_full_counters_leave_rare_words_first(spark, documents, monkeypatch):
    # Runs of common words meet by chance; a sketch of shingles as full as that of a large table does not tell these from the rare ones.
    r = random.Random(12)
    texts = [" ".join([*(r.choice(["the", "of", "and", "in", "to", "a", "is", "that"]) for _ in range(60)), *(f"w{i}a{k}" for k in range(30))]) for i in range(80)]
    rows = [*enumerate(texts), (100, texts[0] + " x"), (101, texts[1])]
    postings = []
    monkeypatch.setattr(ngram_jaccard, "SKETCH_BITS", 8)
    pairs = ngram_jaccard._pairs
    monkeypatch.setattr(ngram_jaccard, "_pairs", lambda p, percent: postings.extend(map(tuple, p.select("h", "c").distinct().collect())) or pairs(p, percent))
    assert sorted(map(tuple, ngram_jaccard.near_duplicates(documents(rows)).collect())) == brute(rows)
    assert postings and {c for _, c in postings} == {2}  # those of the one near copy
    out = corpus_pipeline.deduplicate(spark, documents(rows), "")
    assert sorted(x.doc_id for x in out.collect()) == list(range(80))


def test_neither_prefixes_nor_whole_rows_are_shuffled(spark, documents, monkeypatch):
    plans = []
    lists = ngram_jaccard._lists
    monkeypatch.setattr(ngram_jaccard, "_lists", lambda sig, classes, *a, **k: plans.append(classes) or lists(sig, classes, *a, **k))
    without = getattr(ngram_jaccard, "_without", None)
    if without:
        monkeypatch.setattr(ngram_jaccard, "_without", lambda rows, gone, limit=30: without(rows, gone, limit))  # as where the copies are too many for one broadcast
    rows = corpus(6) + EDGES
    docs = documents(rows).repartition(8)
    out = corpus_pipeline.deduplicate(spark, docs, "")
    assert sorted(x.doc_id for x in out.collect()) == sorted({c for _, _, c in brute(rows)})
    for df in (plans[0], out):
        assert not re.search(r"(?<!Broadcast)Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_rows_without_keys_by_ranges(spark, limit):
    rows = spark.createDataFrame([((p << 33) + i, f"{p} {i}") for p in range(5) for i in range(4)], "row long, text string")
    gone = rows.where("row % 3 = 1 and row >= 8589934592").select("row")
    assert sorted(map(tuple, ngram_jaccard._without(rows, gone, limit).collect())) == sorted(map(tuple, rows.where("not (row % 3 = 1 and row >= 8589934592)").collect()))


def test_weights_follow_the_words_of_a_shingle():
    texts = [t for _, t in corpus(7, families=4)] + ["", None, "one", "a b c d", "a b c d e", "the the the the the the"]
    data, offsets = column(pa.array(texts))
    weights = np.arange(256, dtype=np.uint8)
    one = lambda w: int(words(*column(pa.array([w])), SPACES)[0][0] >> np.uint64(56))
    for text, (s, sums), plain in zip(texts, weighed_sets(data, offsets, 5, weights), shingle_sets(data, offsets, 5), strict=True):
        assert s.tolist() == plain.tolist() and len(s) == len(sums)
        assert sorted(sums.tolist()) == sorted(sum(map(one, g)) for g in shingles(text))


@pytest.mark.parametrize("few", [0, 2, 64])
def test_components_however_long_a_list_gives_pairs(documents, few):
    rows = corpus(5) + EDGES
    assert sorted(map(tuple, ngram_jaccard.near_duplicates(documents(rows), few=few).collect())) == brute(rows)


def test_parity_keeps_every_link():
    r = random.Random(4)
    kept = 0
    for _ in range(400):
        n = r.choice([1, 2, 9, 63, 64, 65, 300, 1030])
        a = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
        b = np.concatenate([a[r.randrange(n // 4 + 1) :], np.array([r.getrandbits(64) for _ in range(r.randrange(n // 4 + 1))], np.uint64)])
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            kept += 1
            assert ngram_jaccard.may_link(len(a), ngram_jaccard.parity(a), len(b), ngram_jaccard.parity(b), 80)
    assert kept > 100
    x, y = (np.array([r.getrandbits(64) for _ in range(300)], np.uint64) for _ in range(2))
    assert not ngram_jaccard.may_link(300, ngram_jaccard.parity(x), 300, ngram_jaccard.parity(y), 80)


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_texts_by_ranges_of_rows(spark, limit):
    docs = spark.createDataFrame([((p << 33) + i, f"text {p} {i}") for p in range(5) for i in range(4)], "row long, text string")
    family = docs.where("row % 3 <> 1").selectExpr("1L AS fam", "2L AS size", "row AS rep")
    got = ngram_jaccard._beside(docs, family, limit).select("rep", "text", "fam", "size")
    assert sorted(map(tuple, got.collect())) == sorted((r.row, r.text, 1, 2) for r in docs.where("row % 3 <> 1").collect())


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and 5000 not in got


@pytest.mark.parametrize(("limit", "hot"), [(10**6, 10**6), (0, 3), (0, 10**6)])
def test_components_however_the_renaming_joins(spark, limit, hot):
    r = random.Random(limit + hot)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), limit, hot).collect())
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


@pytest.mark.parametrize(("limit", "hot"), [(10, 10**6), (0, 2), (0, 10**6)])
def test_renaming_keeps_every_row(spark, limit, hot):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 9 + ["b", "c", "c", None, None] + ["z"] * 5 + [None] * 4)], "i int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("q", 4)], "k string, v int")
    got = sorted(map(tuple, renamed(rows, "k", table, "v", limit, hot).collect()))
    assert got == [(i, k, {"a": 1, "b": 2, "c": 3}.get(k)) for i, k in map(tuple, rows.collect())]


@pytest.mark.parametrize("separators", [SPACES, PUNCT])
def test_word_hashes_follow_words(separators):
    texts = ["a b", "A  B", "ab", "", "é x", "x é", "a" * 3_000_000, "a" * 2_999_999]
    h, rows = words(*column(pa.array(texts)), separators)
    lists = [h[rows[i] : rows[i + 1]].tolist() for i in range(len(texts))]
    assert lists[0] == lists[1] and len(lists[2]) == 1 and lists[3] == [] and lists[4] == lists[5][::-1]
    assert len(set(sum(lists, []))) == 7


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    windows = {}
    for name, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for v, who in windows.items():
            for i in range(len(w) - len(v) + 1):
                if tuple(w[i : i + len(v)]) == v:
                    hit |= set(range(i, i + len(v)))
                    names |= who
        ids = sorted(map(str, names))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(docs, items):
    return {
        "documents": pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "items": pa.array([0] * len(docs))}),
        "benchmark": pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}),
    }


def benchmark_case(seed):
    r = random.Random(seed)
    v = [f"v{k}" for k in range(30)] + ["Émile", "same", "same"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([1, 3, 6, 10, 14, 40])))) for i in range(12)] + [(20, None), (21, "..."), (22, "same same same same same same same same same same same same")]
    items += [(23, items[0][1])]
    docs = []
    for d in range(40):
        parts = [" ".join(r.choice(v) for _ in range(r.randint(0, 50)))]
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            k = r.randint(0, max(0, len(w) - 8))
            parts.append(r.choice([" ", ", ", "\n"]).join(w[k : k + r.randint(5, 30)]).upper())
        r.shuffle(parts)
        docs.append((d, " | ".join(parts)))
    return docs + [(50, None), (51, ""), (52, "!!"), (53, "same " * 20000), (0, docs[0][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination_equals_brute_force(spark, folder, seed):
    docs, items = benchmark_case(seed)
    d = folder(**tables(docs, items))
    assert sorted(map(tuple, decontaminate.op8(spark, d).collect()), key=str) == brute_hits(docs, items)


def test_benchmark_in_blocks_gives_the_same(spark, folder):
    docs, items = benchmark_case(4)
    docs = docs[:-1]
    d = folder(**tables(docs, items))
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark")}
    one = {r.doc_id: (r.runs, r.items) for r in decontaminate.hits(t["documents"], t["benchmark"]).collect()}
    many = {r.doc_id: (r.runs, r.items) for r in decontaminate.hits(t["documents"], t["benchmark"], block=30).collect()}
    assert one == many and len(one) == len(docs)


def test_clean_and_empty_benchmark(spark, folder):
    docs, items = benchmark_case(5)
    d = folder(**tables(docs, items))
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark")}
    dirty = {x[0] for x in brute_hits(docs, items) if x[5]}
    out = decontaminate.clean(t["documents"], t["benchmark"])
    assert out.columns == t["documents"].columns and {r.doc_id for r in out.collect()} == {i for i, _ in docs} - dirty
    d = folder(**tables(docs, []))
    assert not any(r.contaminated for r in decontaminate.op8(spark, d).collect())
    d = folder(**tables([], items))
    assert decontaminate.op8(spark, d).count() == 0


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 30])
def test_clean_judges_every_row_by_its_own_text(spark, folder, block):
    docs, items = benchmark_case(6)
    docs = [(None if i % 3 else i % 5, t) for i, t in docs]
    d = folder(**tables(docs, items))
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark")}
    want = Counter(row for row in docs if not brute_hits([row], items)[0][5])
    assert any(i is None for i, _ in want) and sum(want.values()) < len(docs)
    out = decontaminate.clean(t["documents"], t["benchmark"], block=block)
    assert out.columns == t["documents"].columns and Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_blocks_keep_rows_of_repeated_and_null_ids_apart(spark, folder):
    docs, items = benchmark_case(7)
    same = max(docs[:40], key=lambda x: len(WORD.findall(x[1])) if brute_hits([x], items)[0][5] else 0)[1]
    n = len(WORD.findall(same))
    docs = [(None if i % 3 else i % 5, t) for i, t in docs]
    docs += [(i, t) for i in (None, 3) for t in (same, same, " ".join(["clean"] * n), " ".join(["other"] * n))]
    d = folder(**tables(docs, items))
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark")}
    one, many = (Counter((r.doc_id, r.n_words, *map(tuple, (r.runs, r.items))) for r in decontaminate.hits(t["documents"], t["benchmark"], **o).collect()) for o in ({}, {"block": 30}))
    assert one == many and sum(many.values()) == len(docs)
    assert one[(None, n, (), ())] >= 2 and one[(3, n, (), ())] >= 2


def test_rows_of_null_and_repeated_ids_take_part_in_deduplication(spark, documents):
    a, b, c, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abce")
    rows = [(None, a), (None, a), (None, a + " x"), (None, b), (4, b + " x"), (7, c), (7, "another text"), (7, " "), (7, ""), (9, " "), (9, e), (8, e + " x"), (None, None), (None, None)]
    got = ngram_jaccard.near_duplicates(documents(rows))
    want = [(None, 26, None)] * 2 + [(None, 27, None), (None, 26, 4), (4, 27, 4), (7, 26, 7), (7, 1, 7), (7, 0, 7), (7, 0, 7), (9, 0, 9), (9, 26, 8), (8, 27, 8), (None, 0, None), (None, 0, None)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    kept = Counter((r.doc_id, r.text) for r in ngram_jaccard.keep_one(documents(rows)).collect())
    alone = [t for i, t in kept.elements() if i is None and t and t.startswith("a0")]
    blank = [t for i, t in kept.elements() if i == 7 and not t.strip()]
    assert len(alone) == 1 and len(blank) == 1
    assert kept == Counter([(None, alone[0]), (4, b + " x"), (7, c), (7, "another text"), (7, blank[0]), (9, " "), (8, e + " x"), (None, None), (None, None)])


def test_equal_word_hashes_are_no_hit(monkeypatch):
    from quarry.llm import textkernel

    spans = textkernel.spans
    monkeypatch.setattr(decontaminate, "spans", lambda *a: (np.zeros_like(spans(*a)[0]), *spans(*a)[1:]))
    index = decontaminate.Index(["1"], ["a b c d e f g h i j"], 10, 5)
    index.order({k: np.zeros(len(v), np.int64) for k, v in index.vocabulary.items()})
    for text, hit in (("a b c d e f g h i j", True), ("A-b c d e f g h i J", True), ("k b c d e f g h i j", False)):
        data, offsets = column(pa.array([text]))
        assert bool(index.scan(data, offsets)[2]) == hit


def test_a_long_item_is_dealt_over_blocks():
    words_ = [f"w{i}" for i in range(57)]
    parts = list(decontaminate._parts(", ".join(words_), 10, 8))
    windows = [tuple(p.split()[i : i + 10]) for p in parts for i in range(len(p.split()) - 9)]
    assert len(parts) > 5 and sorted(windows) == sorted(tuple(words_[i : i + 10]) for i in range(48))
    assert list(decontaminate._parts("one, two  " + " " * 100, 10, 8)) == ["one two"]
    assert list(decontaminate._parts("one two", 10, 8)) == ["one two"]
