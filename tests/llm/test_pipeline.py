"""The pipeline's stages against plain Python, stage by stage and as a whole."""

import random

import pytest

import corpus_pipeline
from tarn.llm import bpe, mixing, neardup, pii, quality

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioubcdlmnr") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 200)), "en", f"s{i % 4}", 1) for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s1", 1) for i in range(20)]  # copies
    rows += [(300 + i, rows[i][1] + " extra", "en", "s2", 1) for i in range(30, 40)]  # near copies
    rows += [(400, prose(50) + " mail ann@example.com or call (415) 555-1234 " + prose(30), "en", "s0", 1), (401, "### ".join(prose(60).split()), "en", "s0", 1), (402, "short", "en", "s0", 1), (403, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing", "BPE"]

    kept = corpus_pipeline.clean(spark, docs, folder).cache()
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdicts.items() if k}
    assert not {401, 402, 403} & {r.doc_id for r in kept.collect()}

    unique = corpus_pipeline.deduplicate(spark, kept, folder).cache()
    ids = sorted(r.doc_id for r in unique.collect())
    sets = {r.doc_id: set(neardup.shingles(r.text).tolist()) for r in kept.collect()}
    assert not any(i in ids for i in (*range(200, 220), *range(300 + 30, 300 + 40)))
    for i in sets:
        near = [j for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert (i in ids) == (not near)

    masked = corpus_pipeline.mask(spark, unique, folder).cache()
    found = {r.doc_id: r for r in masked.collect()}
    for r in unique.collect():
        assert found[r.doc_id].text == pii.redact(r.text, pii.find(r.text)[1])
    assert "<EMAIL>" in found[400].text and "<PHONE>" in found[400].text and found[400].n_chars == len(found[400].text)

    mixed = corpus_pipeline.balance(spark, masked, folder).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(masked).collect() if r.copies}
    counted = {}
    for r in mixed.collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
    assert counted == copies
    for stage in (kept, unique, masked, mixed):
        assert stage.columns == docs.columns

    encoded = corpus_pipeline.encode(spark, mixed, folder).collect()
    tokenizer = bpe.Tokenizer(bpe.read_spec(corpus_pipeline.vocabulary()))
    for r in encoded:
        assert r.ids == tokenizer.encode(found[r.doc_id].text) and tokenizer.decode(r.ids) == found[r.doc_id].text

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in encoded)
    assert len(whole) < docs.count() * 3


def test_stages_keep_null_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id between 50 and 57").orderBy("doc_id").collect()
    texts = [r.text for r in docs]
    junk = "### ".join(["word"] * 60)
    # two clean texts without an id, one of them a copy of an id's, junk without an id; an id with two texts, and with junk
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, junk), (2, texts[3]), (2, texts[4]), (2, junk), (3, texts[5]), (3, texts[5])]
    df = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = lambda d: sorted((r.doc_id or 0, r.text) for r in d.collect())
    kept = corpus_pipeline.clean(spark, df, folder)
    assert found(kept) == sorted((i or 0, t) for i, t in rows if t != junk)
    unique = corpus_pipeline.deduplicate(spark, kept, folder)
    want = sorted([(1, texts[0]), (0, texts[1]), (0, texts[2]), (2, texts[3]), (2, texts[4]), (3, texts[5])])
    assert found(unique) == want
    assert set(found(corpus_pipeline.balance(spark, unique, folder))) == set(want)


def test_stages_on_an_empty_table_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.selectExpr("*", "doc_id AS kept", "text AS fp", "lang AS hash", "source AS size", "n_chars AS row_key", "doc_id AS copies", "text AS redacted")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
        found, want = (stage(spark, d.where("doc_id < 60 or doc_id > 300"), folder) for d in (wide, docs))
        assert found.columns == want.columns and found.count() == want.count(), name


def test_run_leaves_one_folder(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "stage_folder", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [p.name for p in tmp_path.iterdir()] == [f"stage-{len(corpus_pipeline.STAGES) - 1}"]
