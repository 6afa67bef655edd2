"""The pipeline on small tables, each stage against a plain version of what it must keep."""

import random
import zlib

import corpus_pipeline

from tidebar.llm import bpe, langid

from .test_llm import DOCS, brute_components, brute_quality, check_packing, prose

MORE = ", score string, accepted string, removed_spans string, __words string, length int"


def fails(text):
    """The quality rules over counted features."""
    n, chars, symbols, dups, repeats = brute_quality(text)
    capitals = sum(c.isupper() for c in text or "")
    return n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or (dups >= 3 and 15 * dups > n) or 2 * capitals > chars or chars > 25 * n


def written(spark, path, rows):
    spark.createDataFrame([(*r, "more", "more", "more", "more", 1) for r in rows], DOCS + MORE).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 90)
    texts = [prose(rng, 120) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", "short", None, "", "spam spam spam " * 60, "12 34 5678 " * 5 + "! " * 60, prose(rng, 60) + " #$%&" * 30]
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(3)]
    rows = [(i, t, "en" if i % 3 else "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(rng, 70), None, None, None), (None, None, None, None, None)]
    docs = written(spark, tmp_path, rows)
    stages, path = dict(corpus_pipeline.STAGES), str(tmp_path)

    kept = stages["quality_rules"](spark, docs, path)
    good = [r for r in rows if not fails(r[1])]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r[:2]) for r in good) and kept.columns == docs.columns

    named = stages["language_id"](spark, kept, path)
    model = langid.fit(kept, corpus_pipeline.F.lit(True), langid.fold(4) == 3)
    want = [r for r in good if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= model.least]
    assert sorted(str((r.doc_id, r.text)) for r in named.collect()) == sorted(str(r[:2]) for r in want) and named.columns == docs.columns

    one = stages["ngram_jaccard"](spark, kept, path)
    keyed = [r for r in dict.fromkeys(good) if r[0] is not None]
    least = {keyed[c][0] for _, c, _ in brute_components([r[1] for r in keyed], 5, 80)}
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted([*map(str, least), "None"]) and one.columns == docs.columns

    cut = stages["substring_dedup"](spark, one, path).collect()
    now = {r.doc_id: r.text for r in cut}
    shared = [38, 39, 40]
    for i in least:
        if i in shared[1:]:
            assert passage not in now[i] and now[i].split() == [w for part in texts[i].split(passage) for w in part.split()]
        else:
            assert now[i] == texts[i]
    assert all(r.n_chars == len(r.text) for r in cut)

    pieces = stages["packing"](spark, stages["substring_dedup"](spark, one, path), path).collect()
    encoder = bpe.encoder_for(bpe.tokenizer_path(), bpe.lexicon_for(bpe.tokenizer_path()), bpe.AsIds())
    ids = {r.doc_id: [*(i for p in next(iter(encoder.batches([r.text]))) for i in p), 1] for r in cut}
    check_packing(pieces, {k: len(v) for k, v in ids.items()}, 2048)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p.doc_id][p.start : p.start + p.length]))
    assert corpus_pipeline.run(spark, path).count() > 0


def test_no_languages_and_no_rows(spark, tmp_path):
    rng = random.Random(12)
    docs = written(spark, tmp_path / "a", [(i, prose(rng, 60), None, None, None) for i in range(4)])
    assert corpus_pipeline.language_id(spark, docs, "").count() == 4
    written(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
