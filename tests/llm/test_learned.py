"""Language ID, quality, neighbours, HTML, token counts, pipeline."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ann_forest, html_mincut, language_id, quality_mil, registry, token_counts

EDGES = [(9001, None), (9002, ""), (9003, "12345 !!!"), (9004, "a"), (9005, "wort " * 30000)]
SAMPLE = {"en": "the and of to in is that thing with", "de": "der die und nicht ein werden straße über", "fr": "le la et les des être où français", "es": "el los y que una niño español está"}


def language_docs(n=160):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(SAMPLE[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SAMPLE), n))]
    return rows + [(i, t, None) for i, t in EDGES]


def docs_table(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] if len(r) > 2 else None for r in rows], pa.string()), "source": pa.array([None] * len(rows), pa.string()), "score": pa.array(["clash"] * len(rows))})


def test_language_on_held_out_rows(spark, folder):
    import zlib

    rows = language_docs()
    got = {r.doc_id: r for r in language_id.op4(spark, folder(documents=docs_table(rows))).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == lang for i, lang in truth.items() if lang)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003))
    assert got[9004].lang_pred in SAMPLE and got[9005].lang_pred in SAMPLE


@pytest.mark.parametrize("rows", [[], [(1, "no label", None), (2, None, "en")], [(i, "only one language", "xx") for i in range(10)]])
def test_language_without_much_to_learn(spark, folder, rows):
    got = language_id.op4(spark, folder(documents=docs_table(rows))).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"und", "xx"}


def test_language_stage_keeps_columns_and_drops_what_cannot_be_told(spark, documents):
    docs = documents([(i, t, lang, "s") for i, t, lang in language_docs(80)])
    out = language_id.known(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == {9001, 9002, 9003}


def test_svm_separates():
    r = np.random.default_rng(0)
    x = r.standard_normal((200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    assert (np.sign(x @ language_id.train_svm(x, y, epochs=200)) == y).mean() > 0.97


def test_quality_on_held_out_rows(spark, tiny, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    rows = quality_mil.op10(spark, tiny).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark, folder):
    rows = [(i, "good words stand here " * (i % 7 + 1) if i % 2 else "BAD!! WORDS!! " * (i % 5 + 1)) for i in range(60)]
    labels = pa.table({"doc_id": pa.array([i for i, _ in rows] + [9001, 1, None]), "quality": pa.array([i % 2 for i, _ in rows] + [None, 1, 1], pa.int32()), "toxic": pa.array([0] * 63, pa.int32())})
    got = {r.doc_id: r for r in quality_mil.op10(spark, folder(documents=docs_table(rows + EDGES), labels=labels)).collect()}
    assert len(got) == 65 and all(got[i].score is not None for i in (9001, 9002, 9003, 9004, 9005))
    assert all((got[i].score > 0.5) == (i % 2 == 1) for i, _ in rows)
    none = folder(documents=docs_table(rows), labels=labels.slice(0, 0))
    assert {r.score for r in quality_mil.op10(spark, none).collect()} == {0.5}
    assert quality_mil.op10(spark, folder(documents=docs_table([]), labels=labels)).count() == 0


def test_passages_cover_whole_texts():
    texts = ["", "one two", "w " * 1000, "z " * 40000]
    data = "".join(texts).encode()
    x, at = quality_mil.passages(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.diff(at).tolist() == [1, 1, 16, 625] and np.isfinite(x).all()


def vectors_table(rows):
    return pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32()), "rank": pa.array([0] * len(rows))})


def nearest(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in ok:
        if q % 100 == 0:
            found = sorted((min(float(np.sqrt(((w - ok[q][0]) ** 2).sum())) for w in vs if len(w) == len(ok[q][0])), i) for i, vs in ok.items() if i != q and any(len(w) == len(ok[q][0]) for w in vs))
            out[q] = found[:k]
    return out


def test_forest_edges_are_exact_when_all_rows_are_candidates(spark, folder):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(150)]
    rows += [(1000, None), (1100, [0.0] * 6), (1200, [float("nan")] * 6), (1300, [float("inf")] + [1.0] * 5), (1400, [None] + [1.0] * 5), (1500, []), (1600, [1.0, 2.0]), (1700, [2.0, 2.0]), (None, [1.0] * 6), (7, rows[7][1])]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    got = {}
    for x in ann_forest.op2(spark, folder(embeddings=vectors_table(rows))).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = nearest(rows)
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [i for _, i in v] == [i for _, i in want[q]] and [d for d, _ in v] == pytest.approx([d for d, _ in want[q]])
    assert ann_forest.op2(spark, folder(embeddings=vectors_table([]))).count() == 0


def test_forest_recall_and_query_blocks(spark, folder):
    r = np.random.default_rng(3)
    x = r.standard_normal((6000, 32))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    d = folder(embeddings=vectors_table(rows))
    want = nearest(rows)
    got = ann_forest.op2(spark, d).collect()
    hits = sum(v.vec_id in {i for _, i in want[v.query_id]} for v in got)
    assert len(got) == 600 and hits / 600 >= 0.9
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    blocks = ann_forest.search(v, v.where("vec_id % 100 = 0"), block=13).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


def test_forest_ends_equal_a_plain_recount():
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 6))
    q = np.concatenate([x[:5], r.standard_normal((7, 6))])
    h = ann_forest.Hash(6, trees=9, digits=3)
    symbols = lambda v: [[np.base_repr(c + h.base**h.digits, h.base)[1:] for c in h.codes(v, t)] for t in range(9)]
    sx, sq = symbols(x), symbols(q)
    got = ann_forest.ends(h, x, q)
    for i in range(len(q)):
        for j in range(len(x)):
            shared = [next((k for k in range(3) if sq[t][i][k] != sx[t][j][k]), 3) for t in range(9)]
            top = max(shared)
            assert got[i, j] == (top * 10 + shared.count(top) - 1 if top else 0)
    assert all(got[i, i] == 3 * 10 + 8 for i in range(5))


def test_neighbours_do_not_depend_on_files_and_batches(spark, folder):
    r = np.random.default_rng(8)
    d = folder(embeddings=vectors_table([(i, r.standard_normal(16).tolist()) for i in range(2000)]))
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    few = {"least": 50, "share": 0.05, "sample": 500}
    one = ann_forest.search(v, v.where("vec_id % 100 = 0"), **few)
    many = ann_forest.search(v.repartition(7), v.where("vec_id % 100 = 0"), block=6, **few)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 200


PAGES = {
    "<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One   two.</p><p>Three<br>four.</article><footer>&copy; x</footer>": "T & U\nOne two.\nThree four.",
    '<body><header>Site</header><div class="sidebar"><p>Side text that is quite long and has a full stop.</p></div><main><p>Body text is here, long enough to matter, and ends.</p><div class="comments"><article><p>A reader says so and so at length.</p></article></div></main><form><label>Mail</label></form></body>': "Body text is here, long enough to matter, and ends.",
    "<script>if (a < b) { '</p>' }</script><style>p{}</style><article><p>Text</p><script>var x = '<p>no</p>'</script><div class=ad>Buy now</div></article><!-- gone --> ": "Text",
    "": "",
    None: "",
    "<article><p>cut off &am": "cut off &am",
    "<article><table><tr><td>a<td>b</table><ul><li>c<li>d</ul></article>": "a\nb\nc\nd",
}


@pytest.mark.parametrize(("page", "text"), PAGES.items())
def test_main_text(page, text):
    assert html_mincut.extract(page) == text


def test_minimum_cut_equals_enumeration():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 9)
        t = [r.uniform(-3, 3) for _ in range(n)]
        e = {(i, j): r.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4}
        cost = lambda x: sum(-v for v, k in zip(t, x) if v < 0 and k) + sum(v for v, k in zip(t, x) if v > 0 and not k) + sum(w for (i, j), w in e.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_mincut.minimum_cut(t, e)) == pytest.approx(best, abs=1e-4)


def test_pages_query(spark, folder):
    pages = pa.table({"page_id": pa.array([1, 2, 2, None], pa.int64()), "url": ["a", None, None, "d"], "html": pa.array([next(iter(PAGES)), None, None, "<p>x" * 20000]), "text": ["clash"] * 4})
    got = html_mincut.op5(spark, folder(pages=pages)).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_mincut.op5(spark, folder(pages=pages.slice(0, 0))).count() == 0


def fewest(word, pieces, byte):
    """Best (score, -tokens) over all segmentations, by recursion without a trie."""
    if not word:
        return 0.0, 0
    best = None
    for k in range(1, len(word) + 1):
        head = word[:k]
        if head in pieces:
            own = pieces[head], -1
        elif k == 1:
            own = len(head.encode()) * byte, -len(head.encode())
        else:
            continue
        rest = fewest(word[k:], pieces, byte)
        c = own[0] + rest[0], own[1] + rest[1]
        best = c if best is None or c[0] > best[0] + 1e-12 or (abs(c[0] - best[0]) <= 1e-12 and c[1] > best[1]) else best
    return best


def test_token_counts_equal_all_segmentations():
    r = random.Random(6)
    pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))): -r.uniform(1, 9) for _ in range(30)}
    c = token_counts.Counter(pieces, keep=50)
    for _ in range(20):
        text = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(30))
        words = text.split()
        assert c.counts([text.encode(), b"", b" \n"]) == [(30, -sum(fewest("▁" + w, pieces, c.byte)[1] for w in words)), (0, 0), (0, 0)]


def test_token_query_edges(spark, folder):
    pytest.importorskip("sentencepiece")
    got = {r.doc_id: r for r in token_counts.op7(spark, folder(documents=docs_table(EDGES + [(None, "word")]))).collect()}
    assert got[9001].n_tokens == got[9002].n_words == 0 and got[9005].n_words == 30000 and got[9005].n_tokens % 30000 == 0 and None in got


def test_registry_names_every_operator_once():
    import __spark_entry__

    assert [int(n[2:].split("_")[0]) for n in registry.TABLE] == list(range(1, 11))
    assert {*registry.TABLE, "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_stages(spark, tiny, tmp_path):
    import corpus_pipeline as p
    from quarry.llm import decontaminate, ngram_jaccard

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, rows = docs.columns, docs
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, rows, tiny)
        assert out.columns == columns if k < 4 else out.columns == [*columns, "shard"]
        out.write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
    ids = [{r.doc_id for r in spark.read.parquet(str(tmp_path / str(k))).collect()} for k in range(5)]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    kept = spark.read.parquet(str(tmp_path / "1"))
    assert all(r.component_id == r.doc_id for r in ngram_jaccard.near_duplicates(kept).collect())
    clean = spark.read.parquet(str(tmp_path / "2"))
    assert not decontaminate.hits(clean, spark.read.parquet(f"{tiny}/benchmark.parquet")).where("size(items) > 0").count()
    assert p.run(spark, tiny).count() == rows.count()


@pytest.mark.parametrize("copies", [40, 3000])
def test_a_repeated_near_id_leaves_room_for_the_others(copies):
    r = np.random.default_rng(4)
    q = r.standard_normal((1, 8))
    near = q + 0.001 * r.standard_normal((copies, 8))
    x = np.concatenate([near, r.standard_normal((60, 8))])
    ids = np.array([7] * copies + list(range(100, 160)))
    found = {}
    for a in range(0, len(x), 500):
        ann_forest.nearest_in(found, ann_forest.Hash(8), x[a : a + 500], ids[a : a + 500], q, np.array([-1]), np.zeros(1), 10)
    far = np.sqrt(((x - q[0]) ** 2).sum(1))
    want = sorted({int(i): far[ids == i].min() for i in ids}.items(), key=lambda p: p[1])[:10]
    assert found[0][0].tolist() == [i for i, _ in want] and np.allclose(found[0][1], [d for _, d in want])


def test_language_learns_only_from_rows_with_a_label_of_their_own(spark, folder, documents):
    from quarry.llm.folds import sampled

    rows = [(1, "the house and the garden", "en")] * 30 + [(1, "bonjour mon ami", None), (2, "das haus und der garten", "de"), (2, "das haus", "de")]
    docs = documents([(*r, None) for r in rows])
    got = sampled(docs.where("lang is not null"), ["lang"], 400)
    assert sorted((r.doc_id, r.text, r.lang) for r in got.collect()) == [(1, "the house and the garden", "en"), (2, "das haus", "de"), (2, "das haus und der garten", "de")]
    many = documents([(i % 7, f"text {i}", "en", None) for i in range(500)])
    assert sampled(many, ["lang"], 20).count() == 20 and sampled(many, [], 1000).count() == 500
    out = {(r.doc_id, r.lang_pred) for r in language_id.op4(spark, folder(documents=docs_table(rows))).collect()}
    assert {lang for _, lang in out} <= {"en", "de"}


def test_language_prediction_equals_a_plain_recount():
    r = random.Random(3)
    texts = [(t, lang) for _, t, lang in language_docs(60) if lang]
    m = language_id.Model(np.stack([language_id.features(t) for t, _ in texts]), [lang for _, lang in texts])
    assert m.families == ["germanic", "romance"]
    for text in [t for t, _ in texts[:12]] + ["".join(r.choice("abcdeéß  ") for _ in range(50)) for _ in range(20)]:
        letters = " ".join("".join(chr(c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else " " for c in (" " + text.lower() + " ").encode()).split())
        raw = f" {letters} ".encode("latin-1")
        count = {}
        for k in range(len(raw) - 2):
            h = (raw[k] * 0x9E3779B1) % 2**32 ^ (raw[k + 1] * 0x85EBCA77) % 2**32 ^ (raw[k + 2] * 0xC2B2AE3D) % 2**32
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32
            count[h >> 19] = count.get(h >> 19, 0) + 1
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values())) or 1.0
        margin = [sum(float(w[k]) * math.log1p(n) / norm for k, n in count.items()) for w in m.w]
        family = m.families[max(range(2), key=lambda k: margin[k])]
        langs = m.members[family]
        votes = {a: sum((margin[m.pairs[family, x, y]] >= 0) == (a == x) for x, y in itertools.combinations(langs, 2) if a in (x, y)) for a in langs}
        best = max(votes.values())
        got, score = m.predict(language_id.features(text))
        assert votes[got] == best and 0 <= score <= 1


def test_attention_scores_equal_a_plain_recount():
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["good", "words", "BAD!!", "x1", "ünd"], r.integers(1, 400))) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x, bags = quality_mil.passages(data, at)
    y = np.array([t.count("good") > t.count("BAD") for t in texts], np.float32)
    m = quality_mil.Model(x, bags, y)
    got = m.scores(x, bags)
    p = m.p
    for i in range(len(texts)):
        hs, logs = [], []
        for row in (x[bags[i] : bags[i + 1]] - m.mean) / m.std:
            h = [math.tanh(sum(float(a) * float(b) for a, b in zip(row, col)) + float(c)) for col, c in zip(p["w"].T, p["b"])]
            gate = [math.tanh(sum(a * float(b) for a, b in zip(h, v))) / (1 + math.exp(-sum(a * float(b) for a, b in zip(h, u)))) for v, u in zip(p["v"].T, p["u"].T)]
            hs.append(h)
            logs.append(sum(a * float(b) for a, b in zip(gate, p["a"])))
        e = [math.exp(v - max(logs)) for v in logs]
        z = [sum(w * h[k] for w, h in zip(e, hs)) / sum(e) for k in range(len(p["c"]))]
        want = 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(z, p["c"])) - float(p["d"][0])))
        assert got[i] == pytest.approx(want, abs=1e-4)
        one = data[at[i] : at[i + 1]]
        assert m.long_score(one, size=700) == pytest.approx(got[i], abs=1e-4)


def test_segments_are_whole_passages():
    text = np.frombuffer((" ".join(f"w{i}" for i in range(3000)) + " " + "y" * 5000 + " end").encode(), np.uint8)
    whole = quality_mil.passages(text, np.array([0, len(text)]))[0]
    parts = list(quality_mil.segments(text, 2000))
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in itertools.pairwise(parts))
    first = [quality_mil.passages(text[a:b], np.array([0, b - a]))[0] for a, b in parts if b <= 10_000]
    first = np.concatenate(first)
    assert len(parts) > 3 and np.allclose(first, whole[: len(first)])


def test_the_cut_changes_labels_of_weak_blocks():
    lines = "A paragraph that is long enough to be taken for content by its own length and by its full stop, as most of a text is."
    page = f"<div><p>{lines}</p><p>{lines}</p><p>Hm, well</p><p>{lines}</p><p>{lines}</p></div>"
    found = html_mincut.blocks(page)
    terminal, edges = html_mincut.graph(found)
    assert terminal[2] < 0 and html_mincut.minimum_cut(terminal, edges) == [True] * 5
    assert html_mincut.extract(page).split("\n") == [lines, lines, "Hm, well", lines, lines]
    listed = "<ul>" + "".join(f"<li><a href=x>Entry {i}</a></li>" for i in range(4)) + "<li>And this entry ends in a stop, a little longer than others.</li>" + "".join(f"<li><a href=x>Entry {i}</a></li>" for i in range(4)) + "</ul>"
    found = html_mincut.blocks(listed)
    terminal, edges = html_mincut.graph(found)
    assert terminal[4] > 0 and not any(html_mincut.minimum_cut(terminal, edges))


def test_block_weights_are_learned_from_the_pages(spark):
    made = "<nav>" + "".join(f"<p>{k} {'menu words go here ' * 9}</p>" for k in range(6)) + "</nav><article>" + "".join(f"<p>{k} short text.</p>" for k in range(6)) + "</article>"
    pages = spark.createDataFrame([(i, "u", made.replace("short", f"s{i}")) for i in range(30)] + [(None, None, None), (5, "u", "")], "page_id long, url string, html string")
    w = dict(zip(html_mincut.NAMES, html_mincut.learned(pages)))
    assert w["long"] < html_mincut.PRIOR["long"] - 1 and w["sentence"] > html_mincut.PRIOR["sentence"]
    assert np.allclose(html_mincut.learned(pages.where("html is null")), list(html_mincut.PRIOR.values()))


@pytest.mark.parametrize("page", ['<a "' * 30_000, '<a b="x' * 30_000, "<div><i>x" * 20_000, "<b>" * 20_000 + "</i>" * 50_000, "<i>" * 20_000 + "<li>x" * 20_000, "<" * 100_000, "<p>a b.<!-- " * 9000])
def test_pages_take_linear_time(page):
    import time

    begun = time.perf_counter()
    html_mincut.extract(page)
    assert time.perf_counter() - begun < 5


def test_long_pre_tokens_and_long_texts():
    r = random.Random(6)
    pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))): -r.uniform(1, 9) for _ in range(30)}
    short, long = token_counts.Counter(pieces), token_counts.Counter(pieces, long=3)
    words = ["".join(r.choice("abcdé𝄞") for _ in range(r.randint(1, 40))).encode() for _ in range(300)]
    assert short.counts(words) == long.counts(words)
    assert long.counts([b"ab" * 50_000])[0][0] == 1 and len(token_counts.Counter({}).counts([b"xyz"])) == 1
    text = b" ".join(words) + b"\n" + b"q" * 500
    parts = list(token_counts.chunks(text, 64))
    assert b"".join(parts) == text and len(parts) > 20 and sum(len(p.split()) for p in parts) == len(text.split())
    assert sum(n for _, n in short.counts(parts)) == short.counts([text])[0][1]


def test_pipeline_cases(spark, folder):
    import corpus_pipeline as p

    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(SAMPLE["en"].split()) + str(r.randrange(50)) for _ in range(n))
    leak = " ".join(f"leak{k}" for k in range(12))
    rows = [(i if i % 4 else None, prose(40), "en") for i in range(60)]
    rows += [(7, prose(40), "en"), (None, prose(20) + " " + leak, "en"), (3, rows[1][1], "en"), (None, None, None), (5, "", None), (6, "12 34", None), (900, prose(20_000), "en")]
    docs = docs_table(rows).append_column("shard", pa.array(["s"] * len(rows))).append_column("row", pa.array([0] * len(rows))).append_column("d", pa.array([1] * len(rows))).append_column("__text", pa.array([1] * len(rows)))
    bench = {"item_id": pa.array([1]), "text": pa.array([leak.upper()])}
    out = p.run(spark, folder(documents=docs, benchmark=bench)).collect()
    texts = {t for _, t, _ in rows if t and any(map(str.isalpha, t)) and "leak" not in t}
    assert {x.text for x in out} <= texts and len({x.text for x in out}) > len(texts) * 0.5 and all(x.shard_input == "s" and 0 <= x.shard < 24 for x in out)
    deduplicated = p.deduplicate(spark, spark.read.parquet(folder(documents=docs) + "/documents.parquet"), "").collect()
    assert sorted(x.text for x in deduplicated if x.text and x.text.strip() and x.text != "12 34") == sorted({t for _, t, _ in rows if t and t.strip() and t != "12 34"})
    none = folder(documents=docs, benchmark={"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    assert any("leak" in x.text for x in p.decontaminated(spark, spark.read.parquet(f"{none}/documents.parquet"), none).where("text is not null").collect())
    assert p.run(spark, folder(documents=docs.slice(0, 0), benchmark=bench)).count() == 0
