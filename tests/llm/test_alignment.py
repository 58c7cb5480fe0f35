"""Alignment against a plain version over tokens one by one, with the libraries' own ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def files():
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def plain(files, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by following both tokenizations along the bytes."""
    a_model, b_model = tokenizers.Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a_model.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    rows, links = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(([], [], [], ""))
            continue
        spans = []
        for names in (bytes_a, bytes_b):
            at, found = 0, []
            for name in names:
                found.append((at, at + len(name)))
                at += len(name)
            spans.append(found)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        owner = [next(j for j, (x, y) in enumerate(spans[1]) if x <= p < y) for p in range(len(whole))] if len(whole) < 3000 else np.repeat(np.arange(len(b)), [y - x for x, y in spans[1]])
        pairs = [(a[i], b[j]) for i, (x, y) in enumerate(spans[0]) for j in sorted({int(owner[p]) for p in range(x, y)})]
        groups, i, j = [], 0, 0
        for cut in cuts:
            part_a, part_b = [], []
            while i < len(a) and spans[0][i][1] <= cut:
                part_a.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                part_b.append(b[j])
                j += 1
            groups.append(",".join(map(str, part_a)) + "|" + ",".join(map(str, part_b)))
        links.update(pairs)
        rows.append((a, b, pairs, ";".join(groups)))
    top = Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    return [(len(a), len(b), g.count("|"), len(p), sum(links[x] == top[x[1]] for x in p), sum(links[x] for x in p), g) for a, b, p, g in rows], links


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioubcdlmnrstéß") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["the", "<|endoftext|>", "</s>", "don't", "12345", "🎉", "日本語", "a\tb", "x\n\ny"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    made += ["".join(rng.choice(" \n\t'srtlabcé①½　\x1c!?.<|>🎉0123▁\xa0") for _ in range(rng.randrange(60))) for _ in range(200)]
    return made + ["", " ", "  ", "\n", "a", "▁", "<s>", "<0x41>", "\x00", "z" * 3000, "ab" * 900 + " " + "é" * 1500, "x" * 999, " " * 1200 + "a", made[0], made[0], "one  two"]


@pytest.mark.parametrize("links,bytes_", [(alignment.BLOCK_LINKS, alignment.SLICE_BYTES), (500, 300), (1, 1)])
def test_against_plain(spark, files, texts, monkeypatch, links, bytes_):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    monkeypatch.setattr(alignment, "SLICE_BYTES", bytes_)
    rows = [*texts, None]
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(rows)], "doc_id long, text string, block string, codes string, pair string").repartition(3)
    want, counted = plain(files, rows)
    documents, pairs = alignment.align(df, *files)
    found = {r.doc_id: r for r in documents.collect()}
    assert len(found) == len(rows)
    for i, (a, b, g, n, best, total, groups) in enumerate(want):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == (a, b, g, n, best, total, groups), rows[i]
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert {(r.a_id, r.b_id): r.n_links for r in pairs.collect()} == dict(counted)


def test_edges(spark, files):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    assert alignment.align(make([]), *files)[0].collect() == []
    found = alignment.align(make([(None, "same text"), (None, "same text"), (1, None)]), *files)[0].collect()
    assert sorted((r.n_links, r.count_sum) for r in found) == [(0, 0), (found[0].n_links or found[1].n_links, 2 * max(r.n_links for r in found)), (max(r.n_links for r in found), 2 * max(r.n_links for r in found))]
    with pytest.raises(ValueError, match="names of the result"):
        alignment.align(make([]), *files, keep=("n_a",))


def test_fast_encoder_is_the_library(files):
    """The same ids from either encoder, with every character that has a class of its own."""
    with open(files[0], encoding="utf-8") as spec, open(files[1], "rb") as model:
        encoders = alignment.Encoders(spec.read(), model.read())
    assert encoders.fast is not None
    library = tokenizers.Tokenizer.from_file(files[0])
    library.encode_special_tokens = True
    every = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F700)]
    for i in range(0, len(every), 64):
        text = " " + "a".join(every[i : i + 64]) + " " + " ".join(every[i : i + 64]) + "".join(every[i : i + 64])
        assert encoders.encode_a(text, text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_runs_and_packing():
    assert [alignment.longest_run(x) for x in (b"a", b" aaa  b", b"    ", b"a b")] == [1, 3, 4, 1]
    codes = np.array([0, 1, 70_000, 2**32 - 1, 5])
    assert alignment.unpacked(alignment.packed(codes), 5).tolist() == codes.tolist()
