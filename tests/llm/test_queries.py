"""Each opN_ query over written tables with nulls, repeats, long texts, ties and clashing columns, and over empty ones."""

import hashlib
import random
import re
import zlib

import pytest

from tidebar.llm import queries

from .test_llm import brute_components, brute_quality, check_packing, jump, prose

COLUMNS = {
    "op1": {"doc_id", "held_out", "lang_pred", "score"},
    "op2": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op3": {"doc_id", "held_out", "score", "predicted"},
    "op4": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op5": {"page_id", "url", "text", "n_chars"},
    "op6": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7": {"doc_id", "text", "n_removed"},
    "op8": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10": {"doc_id", "n_shingles", "component_id"},
    "op11": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op12": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
}
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, vector string"
BENCH = "item_id long, text string, bucket string, n string"
EXTRA = "score string, accepted string, label string, key long, length int, `__words` string, toxicity string, host string, part int, removed_spans string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
PAGES = "page_id long, url string, html string, " + EXTRA
OPS = sorted(queries.queries(), key=lambda name: int(name[2:].split("_")[0]))


def texts_of(rng):
    base = prose(rng, 60)
    return [None, "", " \t\n", "one", base, base, base + " more", prose(rng, 20_000), "y" * 50_000, "é ß 中文 字 привет", "a\n\na\nb\na", "spam spam " * 60, *[prose(rng, 70) for _ in range(20)]]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("filled"))
    rng = random.Random(3)
    texts = texts_of(rng)
    base = texts[4]
    clash = ("x", "x", "x", 1, 2, "x", "x", "x", 3, "x")
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", "s", 1, *clash) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", None, None, None, *clash)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, None if i == 3 else 1, i % 2 if i % 4 else None) for i in range(28)] + [(5, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>{}</p></article></body></html>"
    pages = [(0, None, None, *clash), (1, "", "", *clash), (2, "http://a.b/c", page.format("same"), *clash), (2, "http://a.b/c", page.format("same"), *clash), (None, "http://a.b/d", page.format("other"), *clash), (4, "x", "<p>" * 2000, *clash)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{path}/pages.parquet")
    axis = [[float(j == i) for j in range(64)] for i in range(50)]
    vectors = [(i, v, 1, "x", "x", "x") for i, v in enumerate(axis)]
    vectors += [(50, axis[7], 0, "x", "x", "x"), (7, axis[7], 0, "x", "x", "x"), (None, axis[3], 0, "x", "x", "x")]
    vectors += [(60, None, 0, "x", "x", "x"), (61, [1.0], 0, "x", "x", "x"), (62, [None] * 64, 0, "x", "x", "x"), (63, [float("nan")] * 64, 0, "x", "x", "x"), (64, [float("-inf")] * 64, 0, "x", "x", "x")]
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, base, "x", "x"), (1, base, "x", "x"), (None, None, "x", "x"), (2, "", "x", "x")], BENCH).write.parquet(f"{path}/benchmark.parquet")
    return path, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("pages", PAGES), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", VECTORS), ("benchmark", BENCH)):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty, name):
    found = queries.queries()[name](spark, empty)
    assert COLUMNS[name.split("_")[0]] <= set(found.columns) and found.count() == 0


@pytest.fixture(scope="module")
def found(spark, filled):
    path, _ = filled
    return lambda op: next(f for name, f in queries.queries().items() if name.startswith(op + "_"))(spark, path).collect()


def fold(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


@pytest.mark.parametrize("op", [op for op in COLUMNS if op not in ("op5", "op9", "op13")])
def test_one_row_for_each_document(filled, found, op):
    rows = found(op)
    assert COLUMNS[op] <= set(rows[0].__fields__)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in filled[1])
    texts = {r[0]: r[1] for r in filled[1]}
    for r in rows:
        text = texts[r.doc_id]
        if op == "op1":
            assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in ("und", "en", "de")
        elif op == "op2":
            raw = (text or "").encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 8)
            if r.doc_id is not None:
                assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9))
        elif op == "op3":
            assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        elif op == "op4":
            assert r.n_chars == len(text or "") and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        elif op == "op6":
            features = brute_quality(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == features
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
        elif op == "op7":
            assert r.n_removed == 0 if text is None else len(r.text) + r.n_removed == len(text)
        elif op == "op11":
            assert r.n_tokens >= 1 and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        elif op == "op12":
            assert r.n_features == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text or "", re.ASCII)) if text is None or text.islower() else r.n_features >= 0
    if op == "op12":
        able = [r for r in rows if r.n_features >= 20]
        assert sorted(r.rank for r in rows if r.rank) == list(range(1, 10 * len(able) // 100 + 1))
        assert [r.score for r in sorted((r for r in able if r.rank), key=lambda r: r.rank)] == sorted((r.score for r in able), reverse=True)[: 10 * len(able) // 100]
    if op == "op4":
        assert len({r.fingerprint for r in rows if texts[r.doc_id] == texts[4]}) == 1
    if op == "op10":
        keyed = [r for r in filled[1] if r[0] is not None][:-1]
        want = {i: (n, c) for i, (n, c, _) in enumerate(brute_components([r[1] for r in keyed], 4, 85))}
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want


def test_pieces_of_all_documents(filled, found):
    rows = found("op9")
    check_packing(rows, {}, 2048)
    totals = {}
    for r in rows:
        totals.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(totals) == {r[0] for r in filled[1]}
    for key, own in totals.items():
        copies = 2 if key == 4 else 1
        assert sum(n for _, n, _ in own) == copies * own[0][2]


def test_one_row_for_each_page(found):
    rows = found("op5")
    assert sorted((r.page_id is None, r.page_id or 0, r.text, r.n_chars) for r in rows) == [
        (False, 0, "", 0), (False, 1, "", 0), (False, 2, "T\n\nsame", 7), (False, 2, "T\n\nsame", 7), (False, 4, "", 0), (True, 0, "T\n\nother", 8)]


def test_one_row_for_each_whole_vector(found):
    rows = found("op13")
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows) == sorted([(False, i) for i in range(51)] + [(False, 7), (True, 0)])
    assert len({r.inertia for r in rows}) == 1 and rows[0].inertia == sum(r.distance for r in rows)
    for i in {r.cluster for r in rows}:
        own = [r for r in rows if r.cluster == i]
        assert {r.cluster_inertia for r in own} == {sum(r.distance for r in own)} and len({r.centroid_sha256 for r in own}) == 1
