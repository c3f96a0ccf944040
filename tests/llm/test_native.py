"""License scan, sharding and mixing: brute force, laws, and edge cases."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import jump_shard, license_scan, source_mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def doc_table(rows):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] if len(r) > 2 else None for r in rows], pa.string()), "labels": pa.array(["clash"] * len(rows))})


EDGES = [(1, None), (2, ""), (3, "..."), (4, "MIT License"), (4, "MIT License"), (5, "mit-license MIT\nLicense"), (6, "mit mit mit license license"), (7, "apache license " * 400), (None, "general public license"), (8, "émit license É"), (9, "x " * 30000 + "released under the MIT license")]


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    own, score = set(), 0.0
    for notice, label in license_scan.NOTICES:
        tokens, k = set(notice.split()), len(notice.split())
        top = max(len(set(w[i : i + k]) & tokens) for i in range(max(1, len(w) - k + 1)))
        if top >= -(-len(tokens) * 8 // 10):
            own.add(label)
            score = max(score, top / len(tokens))
    base = {label for _, label in places}
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else score)


def test_license_scan_equals_brute_force(spark, folder):
    d = folder(documents=doc_table(EDGES))
    got = Counter(tuple(r) for r in license_scan.op1(spark, d).collect())
    assert got == Counter((i, *brute(t)) for i, t in EDGES)


def test_license_scan_takes_a_table_of_templates(spark, documents):
    table = spark.createDataFrame([("Alpha beta GAMMA delta epsilon", "greek"), ("...", "none"), (None, "null"), ("one", "single")], "text string, label string")
    docs = documents([(1, "x alpha y beta gamma delta z"), (2, "alpha beta gamma delta"), (3, "One two"), (4, None), (5, "alpha " * 3000)])
    got = {r.doc_id: [(f.label, f.score) for f in r.found] for r in license_scan.scan(docs, notices=table).collect()}
    assert got == {1: [("greek", 0.8)], 2: [("greek", 0.8)], 3: [("single", 1.0)], 4: [], 5: []}
    with pytest.raises(ValueError, match="templates"):
        license_scan.templates(spark.range(300).selectExpr("concat('w', id) AS text", "'l' AS label"))


def test_license_bodies_within_other_text(spark, folder):
    body = dict((label, text) for text, label in license_scan.NOTICES)["mit-body"]
    words = body.split()
    rows = [(1, "some code " * 40 + body.upper() + " more code" * 40), (2, " ".join(w for i, w in enumerate(words) if i % 8)), (3, " ".join(w for i, w in enumerate(words) if i % 2)), (4, " ".join(words[:40]))]
    d = folder(documents=doc_table(rows))
    got = {tuple(r) for r in license_scan.op1(spark, d).collect()}
    assert got == {(i, *brute(t)) for i, t in rows} and any("mit-body" in r[6] for r in got)


def test_license_words_are_the_matches_of_any_text(spark, folder):
    draw = random.Random(3)
    characters = [chr(c) for c in range(128)] + list("aaazzzAZ09   \n\n") * 8 + list("éK\u0130\u0307ß中𝔸😀\u00a0\u2028\ufeff") * 6
    rows = [(i, "".join(draw.choices(characters, k=draw.randrange(60)))) for i in range(3000)] + [(-1, None), (-2, " "), (-3, "a"), (-4, " a"), (-5, "a\x00")]
    docs = spark.read.parquet(folder(documents=doc_table(rows)) + "/documents.parquet")
    got = {r.doc_id: r.w for r in docs.select("doc_id", license_scan.words_of(F.col("text")).alias("w")).collect()}
    assert got == {i: WORD.findall((t or "").translate(LOW)) for i, t in rows}


def test_license_words_cost_less_than_by_a_negated_class(spark, folder):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(1, 12))) for _ in range(500)]
    rows = [(i, " ".join(draw.choices(words, k=1500))) for i in range(2000)]
    docs = spark.read.parquet(folder(documents=doc_table(rows)) + "/documents.parquet")

    def seconds(found):
        start = time.perf_counter()
        docs.agg(F.sum(F.size(found))).collect()
        return time.perf_counter() - start

    matched = F.regexp_extract_all(F.lower("text"), F.lit(license_scan.WORD), F.lit(0))
    pairs = [(seconds(license_scan.words_of(F.col("text"))), seconds(matched)) for _ in range(4)]
    assert min(a for a, _ in pairs) < 0.8 * min(b for _, b in pairs), pairs


def test_license_scan_orders_by_corpus_frequency():
    t = license_scan._template("mit license", "mit", 1.0, {"mit": 900, "license": 3})
    assert t["prefix"] == ["license"]


def test_empty_tables(spark, folder):
    d = folder(documents=doc_table([]))
    assert license_scan.op1(spark, d).count() == jump_shard.op3(spark, d).count() == source_mix.op6(spark, d).count() == 0


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_law(spark, folder):
    rows = [(i * 7919 - 300, f"text {i % 50}") for i in range(3000)] + [(1, None), (2, ""), (2, ""), (None, "é")]
    d = folder(documents=doc_table(rows))
    got = jump_shard.op3(spark, d).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 24) and r.grown_shard == jump(r.doc_id or 0, 25) and r.grown_shard in (r.shard, 24)
        assert r.size - 8 in {len(t.encode()) for t in texts[r.doc_id]} and r.text_crc32 in {zlib.crc32(t.encode()) for t in texts[r.doc_id]}
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_of_repeated_rows_and_of_one_key(spark, folder):
    rows = [(5, "same")] * 500 + [(None, f"text {i}") for i in range(300)] + [(5, f"other {i}") for i in range(50)] + [(None, None)] * 20
    docs = spark.read.parquet(folder(documents=doc_table(rows)) + "/documents.parquet")
    for chunk in (65_536, 7):
        got = jump_shard.place(docs, chunk=chunk).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_text_keys_and_a_column_of_that_name(spark):
    docs = spark.createDataFrame([("a", 7, "x"), ("b", 8, "y"), (None, 9, "z")], "doc_id string, shard int, text string")
    out = {r.doc_id: r for r in jump_shard.assign(docs).collect()}
    assert out["a"].shard_input == 7 and out[None].shard_input == 9 and all(0 <= r.shard < 24 for r in out.values())
    assert {r.doc_id: r.shard for r in jump_shard.place(docs).collect()} == {k: r.shard for k, r in out.items()}


@pytest.mark.parametrize("shards", [1, 2, 7, 100])
def test_jump_against_the_published_loop(spark, shards):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), 10**12 + 7]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard.jump(F.col("k"), shards).alias("s")).collect()
    assert [(r.s.shard, r.s.grown) for r in got] == [(jump(r.k, shards), jump(r.k, shards + 1)) for r in got]


def test_mix_targets_and_draws(spark, folder):
    rows = [(i, "w " * (i % 9 + 1), s) for i, s in enumerate(["big"] * 600 + ["mid"] * 300 + ["small"] * 40 + [None] * 200 + ["zero"] * 2)]
    rows[-1] = (rows[-1][0], None, "zero")
    rows[-2] = (rows[-2][0], "  \n", "zero")
    d = folder(documents=doc_table(rows))
    got = source_mix.op6(spark, d).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.op6(spark, d).collect()), key=str)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight = dict(zip([*sorted(x for x in size if x is not None), None], (5, 2, 1, 5, 2)))
    target, pool, level_of = {}, 1.5 * sum(size.values()), dict(weight)
    while True:
        level = (pool - sum(target.values())) / (sum(level_of.values()) or 1)
        over = [s for s, w in level_of.items() if w * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            del level_of[s]
    target |= {s: w * level for s, w in level_of.items()}
    by_id = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in size:
        assert taken[s] == pytest.approx(target[s], rel=0.2)


def test_mixed_keeps_columns_and_repeats_rows(spark, documents):
    docs = documents([(i, "a b c", "en", "s") for i in range(50)])
    out = source_mix.mixed(docs)
    assert out.columns == docs.columns and 60 <= out.count() <= 90
    assert set(Counter(r.doc_id for r in out.collect()).values()) <= {1, 2}


def test_sources_rank_by_code_point_null_last(spark):
    df = spark.createDataFrame([("b", 1), (None, 1), ("B", 1), ("é", 1), ("a", 1)], "source string, source_size int")
    assert [r.source for r in source_mix.ranked(df).orderBy("nth").collect()] == ["B", "a", "b", "é", None]
