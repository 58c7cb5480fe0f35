"""The operators against plain Python, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import bpe, language, mixing, pii, quality, shards, simhash, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdlmnr") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 120))) for _ in range(120)]


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Documents with everything that may go wrong, and columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, " \n\t ", "en", "b", 4), (503, "x" * 200_000, "de", "a", 200_000), (504, "one", "en", None, 3)]
    rows += [rows[0], rows[0], (505, texts[0], "en", "c", 1), (506, "é " * 3000, "fr", "a", 6000), (None, texts[1], "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("size", "hash", "fp", "rep", "kept", "shard", "slot", "score", "n_words", "measure", "s", "q", "offset", "g", "cuts", "host", "copies", "target"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(5)


# ---- byte-pair encoding ----


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_bpe_agrees_with_library(vocabulary, texts):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(vocabulary), bpe.Tokenizer(bpe.read_spec(vocabulary))
    rng = random.Random(1)
    cases = ["", "a", " ", "  a", "a  \n\n b", "<|endoftext|>x <|endoftext|>  y", "\x1c a\x1f\x85b", "\u3000x\u2003 y\xa0", "'s I'll don't 'S", "🎉 é́ ①Ⅷ½", "a" * 5000, "ab" * 3000 + " " * 700, "\r\n\r\n  x\t\ty", *texts[:20]]
    cases += ["".join(rng.choice(" \n\t'srtlabcé①½\u3000\x1c!?.<|>🎉0123") for _ in range(rng.randrange(80))) for _ in range(500)]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_trees_agree(vocabulary):
    mine = bpe.Tokenizer(bpe.read_spec(vocabulary))
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(1, 64))).encode() for _ in range(300)]
    assert mine.merge(words) == [mine.merge_one(mine.byte_id[list(w)].tolist()) for w in words]


def test_bpe_cache_is_bounded(vocabulary, monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 12_000)
    small, large = bpe.Tokenizer(bpe.read_spec(vocabulary)), bpe.Tokenizer(bpe.read_spec(vocabulary))
    found = [small.encode(t) for t in texts]
    assert small.old and len(small.cache) < 60
    monkeypatch.setattr(bpe, "CACHE_BYTES", 10**9)
    assert found == [large.encode(t) for t in texts]


def test_bpe_cache_is_bounded_in_bytes(vocabulary, monkeypatch):
    """Long pre-tokens are never kept, and what Python holds for the rest stays within both generations."""
    import sys

    monkeypatch.setattr(bpe, "CACHE_BYTES", 500_000)
    tokenizer = bpe.Tokenizer(bpe.read_spec(vocabulary))
    rng = random.Random(9)
    for _ in range(12):
        tokenizer.encode_texts(["".join(rng.choice("abcdefé日") for _ in range(20_000)) for _ in range(3)])
        tokenizer.encode_texts([" ".join("".join(rng.choice("abcdefé日") for _ in range(rng.randint(1, 64))) for _ in range(500))])
        held = [sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (tokenizer.cache, tokenizer.old)]
        assert max(held) < 600_000 and max(map(len, [*tokenizer.cache, *tokenizer.old, ""])) <= bpe.STEP_BYTES
    assert tokenizer.old


def test_bpe_documents(odd, vocabulary):
    rows = bpe.encode_documents(odd, vocabulary).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[500].n_tokens == 0 and by_id[500].decoded == "" and by_id[500].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[503].decoded == "x" * 200_000 and by_id[503].n_tokens == len(by_id[503].ids)
    assert bpe.encode_documents(odd.limit(0), vocabulary).collect() == []


# ---- quality ----


def brute_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_brute_force(texts):
    rng = random.Random(4)
    cases = [None, "", " \x1c ", "a\x85b c\xa0d", *texts[:30]]
    for _ in range(100):
        cases.append("".join(rng.choice(["a b c d e f g h ", "a b ", "\n", "#|", "x ", "é\u2003 "]) for _ in range(rng.randint(1, 40))))
    for t in cases:
        assert quality.count_text(t)[:5] == brute_counts(t), t


def test_quality_keeps_clean_and_drops_junk(spark, texts):
    junk = ["### ".join(t.split()[:60]) for t in texts[:6]] + [" ".join(["spam offer now"] * 60)] + ["too short"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(900 + i, t, "en", "a", len(t)) for i, t in enumerate(junk)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept[i] for i in range(len(texts)))
    assert not any(kept[900 + i] for i in range(len(junk)))


def test_quality_edges(odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(odd.limit(0)).collect() == []


def test_quality_sketch_merges(spark):
    values = [float(v) for v in np.random.default_rng(1).lognormal(0, 1, 2000)]
    df = spark.createDataFrame([("x", v) for v in values], "measure string, x double")
    bucket = F.ceil(F.log("x") / F.log(F.lit(quality.GAMMA))).cast("int")
    sketch = df.groupBy("measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    row = quality.quantiles(sketch, [], {"low": 0.25, "high": 0.75}).first()
    for name, q in (("low", 0.25), ("high", 0.75)):
        assert abs(row[name] / np.quantile(values, q) - 1) < quality.GAMMA - 1 + 0.01


# ---- personal data ----


def test_pii_base_against_plain_patterns(texts):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(5)
    alphabet = ["a", "b.", "@", "@x.y", ".", "1", "23", "255", ".7", "+", "-", " ", "4111111111111111", "(", ")", "+1 415 555 2671", "é", "%", "_"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
        digits = pii.only_digits
        want = {
            "email": [m.span() for m in email.finditer(t)],
            "ip": [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
            "card": [m.span() for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
            "phone": [m.span() for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15],
        }
        assert pii.base_spans(t) == want, t


def test_pii_model_on_held_out_sentences():
    model, rng = pii.shared_model(), random.Random(99)
    right = found = gold = 0
    for _ in range(200):
        text, spans = pii.example(rng)
        tokens = pii.tokens_of(text)
        got = {(tokens[i][1], tokens[j - 1][2], k) for i, j, k in model.decode([w for w, _, _ in tokens])}
        right, found, gold = right + len(got & set(spans)), found + len(got), gold + len(spans)
    assert right / found > 0.97 and right / gold > 0.97


def segmentations(n, spans):
    """Every way to cover n tokens by labelled segments and single tokens: lists of (segment or None, label)."""
    none = len(pii.KINDS)

    def build(t):
        if t == n:
            yield []
            return
        for rest in build(t + 1):
            yield [(None, none), *rest]
        for i, (a, b) in enumerate(spans):
            if a == t:
                for rest in build(b):
                    for k in range(none):
                        yield [(i, k), *rest]

    return build(0)


def test_pii_search_and_sums_against_all_segmentations():
    """The best segmentation, and the chances of segments and label pairs, against listing all of them."""
    model, rng = pii.shared_model(), np.random.default_rng(4)
    none = len(pii.KINDS)
    tried = 0
    for text in ("(415) 555-1234", "a at b dot com", "10.0.0.1 4111", "1-2345678 90", "555 1234 at x"):
        words = [w for w, _, _ in pii.tokens_of(text)]
        spans = pii.candidates(words)[:6]
        if not spans:
            continue
        tried += 1
        scores = model.score(words, spans)[0] + rng.normal(0, 2, (len(spans), none))
        pairs = rng.normal(0, 1.5, (none + 1, none + 1))
        pairs[-1, -1] = 0.0
        other = pii.Model()
        other.pairs = pairs
        totals, chance, counts = [], np.zeros_like(scores), np.zeros_like(pairs)
        every = list(segmentations(len(words), spans))
        for path in every:
            labels = [none, *(k for _, k in path)]
            totals.append(sum(scores[i, k] for i, k in path if i is not None) + sum(pairs[x, y] for x, y in zip(labels, labels[1:])))
        weights = np.exp(np.array(totals) - np.logaddexp.reduce(totals))
        for path, w in zip(every, weights):
            labels = [none, *(k for _, k in path)]
            for i, k in path:
                if i is not None:
                    chance[i, k] += w
            for x, y in zip(labels, labels[1:]):
                counts[x, y] += w
        got_chance, got_counts = other.expected(scores, spans, len(words))
        assert np.allclose(got_chance, chance) and np.allclose(got_counts, counts)
        other.score = lambda *_, s=scores: (s, [])
        whole = pii.candidates
        pii.candidates = lambda _, c=spans: c
        try:
            chosen = other.decode(words)
        finally:
            pii.candidates = whole
        best = every[int(np.argmax(totals))]
        assert chosen == [(*spans[i], pii.KINDS[k]) for i, k in best if i is not None]
    assert tried >= 4


def test_pii_stretches_change_no_result(texts):
    """The search in stretches finds what a search over all tokens finds, however long the tokens are."""
    rng = random.Random(21)
    model = pii.shared_model()
    cases = [pii.example(rng)[0] + " " + rng.choice(texts)[:200] + " " + pii.example(rng)[0] for _ in range(150)]
    cases += ["x" * 100 + " [at] foo [dot] com", "y" * 5000 + " at " + "z" * 400 + ".com", "call 4-1-5-5-5-5-1-2-3-4 now", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 " * 5, "12 " + "word " * 30 + "3456"]
    for text in cases:
        base = pii.base_spans(text)
        hidden = list(text)
        for spans in base.values():
            for a, b in spans:
                hidden[a:b] = "\n" * (b - a)
        tokens = pii.tokens_of("".join(hidden))
        want = [(k, tokens[i][1], tokens[j - 1][2]) for i, j, k in model.decode([w for w, _, _ in tokens])]
        taken = [s for spans in base.values() for s in spans]
        assert sorted(pii.model_spans(text, taken, model)) == sorted(want), text
    assert pii.find("x" * 100 + " [at] foo [dot] com")[1] == [("email", 0, 119)]


def test_pii_adds_and_keeps(odd):
    text = "mail john at example dot com or ann@example.com, call (415) 555-1234 or +1 (415) 555-2671"
    base, spans = pii.find(text)
    assert base["email"] == [(32, 47)] and base["phone"] == [(72, 89)]
    assert pii.redact(text, spans) == "mail <EMAIL> or <EMAIL>, call <PHONE> or <PHONE>"
    rows = pii.find_spans(odd).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.spans for r in rows}[500] == ""
    for clean in ("We met at ten. Nobody came at 10.", "a hash 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "in 2024-01-15 or 1999-2001", "x" * 50_000 + "1" * 50_000):
        assert pii.find(clean)[1] == [], clean[:40]


# ---- language ----


def test_language_learns_and_rejects(spark, texts):
    rng = random.Random(6)
    other = [" ".join("".join(rng.choice("xyzwkqjv") for _ in range(5)) for _ in range(40)) for _ in range(120)]
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(texts)] + [(1000 + i, t, "bb", "s", 1) for i, t in enumerate(other)]
    rows += [(2000, None, "aa", "s", 1), (2001, "123 !?", "aa", "s", 1), (2002, "", "bb", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i < 2000]
    assert np.mean([got[i].lang_pred == ("aa" if i < 1000 else "bb") for i in held]) > 0.97
    for i in (2000, 2001, 2002):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_against_plain_python(monkeypatch):
    """Subwords, training, temperature and threshold once more with plain loops."""
    monkeypatch.setattr(language, "BITS", 7)
    monkeypatch.setattr(language, "WIDTH", 3)
    rng = random.Random(12)
    samples = [("".join(rng.choice("abcd " if k % 2 else "cdef ") for _ in range(rng.randint(1, 30))), "xy"[k % 2]) for k in range(60)]
    samples = [s for s in samples if s[0].strip()]
    model = language.train(samples, epochs=2)

    def pieces(text):
        raw = text.encode().lower()
        raw += b" " * (3 - len(raw))
        three = [raw[i] + (raw[i + 1] << 8) + (raw[i + 2] << 16) for i in range(len(raw) - 2)]
        four = [three[i] + (raw[i + 3] << 24) for i in range(len(raw) - 3)]
        return [(x * 0x9E3779B1) % 2**32 >> 25 for x in three] + [(x * 0x85EBCA77 + 0x165667B1) % 2**32 >> 25 for x in four]

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    draws = np.random.default_rng(3)
    held = [bool(x < 0.2) for x in draws.random(len(samples))]
    embed = draws.normal(0, 0.1, (128, 3)).tolist()
    layer = draws.normal(0, 0.3, (3, 2)).tolist()
    trained = [i for i, h in enumerate(held) if not h]

    def logits(text):
        rows = pieces(text)
        mean = [sum(embed[r][d] for r in rows) / len(rows) for d in range(3)]
        return mean, [sum(mean[d] * layer[d][c] for d in range(3)) for c in range(2)]

    for epoch in range(2):
        step = 2.0 * (1 - epoch / 2)
        for i in draws.permutation(trained):
            text, lang = samples[i]
            mean, x = logits(text)
            slope = [p - (c == "xy".index(lang)) for c, p in enumerate(soft(x))]
            back = [sum(layer[d][c] * slope[c] for c in range(2)) for d in range(3)]
            layer = [[layer[d][c] - step * 0.1 * mean[d] * slope[c] for c in range(2)] for d in range(3)]
            count = Counter(pieces(text))
            for r, n in count.items():
                embed[r] = [embed[r][d] - step * len(count) ** 0.5 * n / sum(count.values()) * back[d] for d in range(3)]
    check = [(logits(t)[1], "xy".index(lang)) for (t, lang), h in zip(samples, held) if h]
    heats = [50 ** (k / 60) for k in range(61)]
    heat = min(heats, key=lambda h: sum(-math.log(soft([v / h for v in x])[g] + 1e-12) for x, g in check))
    for text, _ in samples:
        p = soft([v / heat for v in logits(text)[1]])
        lang, score, rejected = model.predict(text)
        assert abs(score - max(p)) < 1e-5 and lang == "xy"[p.index(max(p))] and rejected == (score < model.threshold)
    ranked = sorted(((max(soft([v / heat for v in x])), x.index(max(x)) == g) for x, g in check), reverse=True)
    sure = [p for k, (p, _) in enumerate(ranked) if sum(r for _, r in ranked[: k + 1]) >= 0.99 * (k + 1)]
    assert abs(model.threshold - (min(sure) if sure else 1.0)) < 1e-6


def test_language_letters_and_rare_languages(spark, texts):
    model = language.train([(t, "aa") for t in texts])
    assert [model.predict(t)[0] for t in ("\u00b2 \u00bd \u2460", "\u2160", "\u0301", "\u00aa", "x", "\u4e2d")] == ["und", "und", "und", "aa", "aa", "aa"]
    rng = random.Random(16)
    rare = ["".join(rng.choice("\u0430\u0431\u0432\u0433 ") for _ in range(200)) for _ in range(6)]
    rows = [(i, texts[i % len(texts)] + str(i), "aa", "s", 1) for i in range(3000)] + [(9000 + i, t, "bb", "s", 1) for i, t in enumerate(rare)]
    model = language.learn(spark.createDataFrame(rows, DOCS), sample=100)
    assert model.languages == ("aa", "bb") and model.predict(rare[0][::-1])[0] == "bb"


def test_language_of_many_languages_stays_small(spark):
    """500 languages: the driver gets BAG_BYTES at most, and the table that is sent has WIDTH columns."""
    rng = random.Random(5)
    alphabets = ["".join(chr(0x4E00 + 40 * i + j) for j in range(12)) for i in range(500)]
    rows = [(i, "".join(rng.choice(alphabets[i % 500]) for _ in range(30)), f"l{i % 500:03}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    model = language.learn(df)
    assert len(model.languages) == 500 and model.table.shape == (1 << language.BITS, language.WIDTH) and model.layer.shape == (language.WIDTH, 500)
    found = language.identify(df, model).collect()
    assert {r.lang_pred for r in found} <= set(model.languages) and all(0 <= r.score <= 1 for r in found)


def test_language_bags_are_thinned(spark, texts, monkeypatch):
    rows, counts = language.bag("abcdefgh" * 50 + "xyz")
    kept, n = language.thinned(rows, counts, 5)
    assert len(kept) == 5 and dict(zip(rows.tolist(), counts.tolist())).items() >= dict(zip(kept.tolist(), n.tolist())).items()
    monkeypatch.setattr(language, "BAG_BYTES", 8 * 10 * language.SAMPLE)  # ten subwords a row
    seen = []
    monkeypatch.setattr(language, "fit", lambda samples: seen.extend(len(r) for r, *_ in samples))
    language.learn(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    assert seen and max(seen) <= 10


def test_language_fold_and_edges(spark, odd):
    ids = spark.range(50).select(F.col("id").alias("doc_id"), language.fold().alias("f") if False else (F.crc32(F.col("id").cast("string")) % 5).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in ids.collect())
    assert language.identify(odd).count() == odd.count()
    assert language.identify(odd.limit(0)).collect() == []


# ---- shards ----


@pytest.mark.parametrize("slice_rows", [50_000, 3])
def test_shards_are_exact(spark, odd, slice_rows):
    rows = shards.shard_documents(odd, 7, slice_rows=slice_rows).collect()
    assert len(rows) == odd.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by_shard.values()]
    assert set(by_shard) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    text = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    again = shards.shard_documents(odd, 7, slice_rows=slice_rows).collect()
    assert sorted((r.shard, r.slot, r.size) for r in rows) == sorted((r.shard, r.slot, r.size) for r in again)


def test_shards_matrix_law():
    total = np.zeros((2, 3))
    for seed in range(400):
        m = shards.communication_matrix([5, 7], 3, seed)
        assert m.sum(1).tolist() == [5, 7] and m.sum(0).tolist() == [4, 4, 4]
        total += m
    assert np.allclose(total / 400, [[5 / 3] * 3, [7 / 3] * 3], atol=0.15)


def test_shards_draws_beyond_the_library(monkeypatch):
    rng = np.random.default_rng(2)
    m = shards.multivariate(rng, np.full(24, 10**9), 10**9)
    assert m.sum() == 10**9 and (m >= 0).all() and abs(m - 10**9 / 24).max() < 10**6
    many = [shards.hypergeometric(rng, 10**10, 23 * 10**10, 24 * 10**6) for _ in range(300)]
    spread = (24e6 * (1 / 24) * (23 / 24)) ** 0.5
    assert abs(np.mean(many) - 10**6) < 4 * spread / 300**0.5 and 0.8 < np.std(many) / spread < 1.2
    # the same code on small numbers, against the exact probabilities
    monkeypatch.setattr(shards, "LIBRARY_LIMIT", 0)
    for good, bad, drawn in ((5, 7, 6), (30, 4, 20), (3, 200, 40)):
        got = Counter(shards.hypergeometric(rng, good, bad, drawn) for _ in range(4000))
        for k in range(drawn + 1):
            exact = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
            assert abs(got[k] / 4000 - exact) < 0.035
    assert [shards.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10))] == [0, 3, 0, 5]


def test_shards_of_more_partitions_than_the_matrix_has(spark, monkeypatch):
    monkeypatch.setattr(shards, "MOST_GROUPS", 3)
    rows = shards.shuffle(spark.range(100, numPartitions=8), 4).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [25] * 4 and sorted(r.id for r in rows) == list(range(100))


def test_shards_refuse_their_own_names(spark):
    with pytest.raises(ValueError, match="operator's own"):
        shards.shuffle(spark.range(3).withColumn("__at", F.lit(1)), 2)


def test_shards_keep_other_columns(spark):
    df = spark.range(40).select("id", *(F.col("id").alias(c) for c in ("s", "q", "g", "cuts", "offset", "slot")))
    for slice_rows in (50_000, 2):
        rows = shards.shuffle(df, 4, slice_rows=slice_rows).collect()
        assert sorted((r.s, r.q, r.g, r.cuts, r.offset) for r in rows) == [(i,) * 5 for i in range(40)]
    assert shards.shuffle(df.limit(0), 4).collect() == []


# ---- SimHash ----


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", words)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_fingerprints(texts):
    for t in [None, "", " \n", "One", "One TWO", "a b c", "a b c d", "É A b \x1c x", *texts[:20]]:
        assert simhash.fingerprint(t) % 2**64 == brute_fingerprint(t), t


def test_simhash_groups(spark, odd, texts):
    rng = random.Random(7)
    rows = []
    for i in range(250):
        words = texts[rng.randrange(40)].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(texts[50].split())
        rows.append((i * 7 % 251, " ".join(words)))
    rows += [(600, None), (601, ""), (602, " ")]
    got = {r.doc_id: r for r in simhash.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].fingerprint == f"{f:016x}" for (i, _), f in zip(rows, fps))
    assert simhash.group(odd).count() == odd.count()
    assert simhash.group(odd.limit(0)).collect() == []


def test_simhash_rows_without_an_id_link_others(spark, texts):
    rng = random.Random(12)
    words = " ".join(texts[:12]).split()
    fps = {}
    for _ in range(400):
        changed = list(words)
        for _ in range(rng.randint(1, 4)):
            changed[rng.randrange(len(words))] = rng.choice(words)
        fps.setdefault(brute_fingerprint(" ".join(changed)), " ".join(changed))
    near = lambda a, b: (a ^ b).bit_count() <= 3
    a, b, c = next((a, b, c) for b in fps for a in fps for c in fps if a != b != c and near(a, b) and near(b, c) and not near(a, c))
    rows = [(7, fps[a]), (None, fps[b]), (9, fps[c]), (8, "some other text"), (None, "and yet another one of them")]
    got = simhash.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.fingerprint, r.component_id or 0) for r in got) == sorted((f"{brute_fingerprint(t):016x}", i) for (_, t), i in zip(rows, (7, 7, 7, 8, 0)))


def test_simhash_dense_groups(spark, monkeypatch):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = brute_components(list(range(len(fps))), fps)
    for above in (150_000, 2):
        monkeypatch.setattr(simhash, "LOOK_UP_ABOVE", above)
        df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
        labels = {r.node: r.component for r in simhash.components(simhash.close_edges(df)).collect()}
        assert {i: labels.get(i, i) for i in want} == want


def test_components_of_chains(spark):
    rng = random.Random(9)
    chain = list(range(200))
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(chain, chain[1:])] + [(300, 300), (400, 401), (401, 400)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in chain} | {400: 400, 401: 400}


# ---- mixing ----


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, closed, rest = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in closed]
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            closed.add(s)


def test_mixing_targets_and_budgets(spark, texts, odd):
    rng = random.Random(10)
    rows = [(i, " ".join(texts[rng.randrange(120)].split()[: rng.randint(0, 40)]), "en", rng.choice(["a"] * 12 + ["b", "b", "c", "d", None]), 1) for i in range(900)]
    rows += [(2000, None, "en", "a", 1), (2001, "", "en", "empty", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    by_source = Counter()
    for i, _, _, s, _ in rows:
        by_source[s] += size[i]
    want = brute_targets(dict(by_source))
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by_source[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 20, (s, taken[s], t)  # half of the longest document
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(3)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(odd.limit(0)).collect() == []


def test_mixing_budgets_are_nested(spark, texts):
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    before = {}
    for weight in (0.2, 0.6, 0.9, 1.5):  # of a against 1 of b
        got = {r.doc_id: r.copies for r in mixing.mix(df, weights=(weight, 1.0)).collect() if r.source == "a"}
        assert all(got[i] >= n for i, n in before.items())
        before = got


def test_mixing_splits_equal_rows_by_position(spark):
    rows = [(1, "a b c", "en", "x", i) for i in range(200)] + [(i, "q " * 50, "en", "y", i) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    for twice in (False, True):
        got = mixing.mix(df, weights=(1.0, 20.0), keep=("doc_id", "n_chars"), twice=twice).collect()
        assert len(got) == 400
        for s, size in (("x", 3), ("y", 50)):
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2 + 1e-6
    one = mixing.mix(df.where("source = 'x'")).collect()
    assert sum(r.taken for r in one) == 600


def test_mixing_reads_twice_alike(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)], DOCS)
    once, twice = (sorted((r.doc_id, r.taken) for r in mixing.mix(df, twice=t).collect()) for t in (False, True))
    assert once == twice


# ---- urls ----


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://A.Example.NET/en/x?y#z", "blog.example.net"), (2, "http://x.net", ""), (3, "http://x.net/", ""), (4, None, None), (5, "no scheme", ""), (6, "https://example.com/de/", ""),
        (7, "https://myexample.com/de/", ""), (8, "https://b.org/fr/1", ""), (9, "x://y?://z/q", ""), (10, "http://net/a", ""), (11, "https://Éa.org/fr", ""),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, f'<a href="http://{h}/">' if h else h) for i, u, h in rows], "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[3].rule, got[3].verdict) == (None, "net/", "block")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("", "", None, "allow")
    assert (got[5].host, got[5].path) == ("", "")
    assert got[6].rule == "example.com/de/" and got[7].rule is None
    assert got[8].verdict == "allow" and got[9].host == "y" and got[9].path == ""
    assert got[10].rule == "net/" and got[11].host == "Éa.org"


def test_url_propagation_against_power_iteration(spark):
    rng = np.random.default_rng(3)
    n = 30
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (90, 2)) if a != b})
    seeds = {0: 0.5, 7: 0.5}
    out = Counter(a for a, _ in edges)
    score = {i: seeds.get(i, 0.0) for i in range(n)}
    for _ in range(urls.ROUNDS):
        got = Counter()
        for a, b in edges:
            got[b] += score[a] / out[a]
        back = 1 - urls.DAMPING * sum(got.values())
        score = {i: urls.DAMPING * got[i] + back * seeds.get(i, 0.0) for i in range(n)}
    e = spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in edges], "src string, dst string")
    s = spark.createDataFrame([(f"h{i}", w) for i, w in seeds.items()], "host string, weight double")
    found = {r.host: r.score for r in urls.rank(e, s).collect()}
    assert all(abs(found.get(f"h{i}", 0.0) - score[i]) < 1e-5 for i in range(n))
    assert abs(sum(found.values()) - 1) < 1e-9


def test_url_rounds_leave_two_tables_and_split_hot_sources(spark, monkeypatch, tmp_path):
    """A source with a third of all links has many salts, its links are shuffled once, and old rounds go."""
    monkeypatch.setattr(urls, "SALT_LINKS", 10)
    edges = [("hub", f"h{i}") for i in range(100)] + [(f"h{i}", f"h{(i * 7 + 1) % 100}") for i in range(100)] + [(f"h{i}", "hub") for i in range(0, 100, 3)]
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([("h1", 1.0)], "host string, weight double")
    found = {r.host: r.score for r in urls.rank(e, s, folder=f"file://{tmp_path}/ranks").collect()}
    assert len([p for p in (tmp_path / "ranks").iterdir() if p.name.startswith("round-")]) <= 2
    assert not (tmp_path / "ranks" / "links").exists() and not [t for t in spark.catalog.listTables() if t.name.startswith("tarn_links")]
    monkeypatch.setattr(urls, "SALT_LINKS", 10**6)
    plain = {r.host: r.score for r in urls.rank(e, s).collect()}
    assert found.keys() == plain.keys() and all(abs(found[h] - plain[h]) < 1e-9 for h in plain) and abs(sum(plain.values()) - 1) < 1e-9
    with pytest.raises(ValueError, match="operator's own"):
        urls.judge(spark.createDataFrame([(1, "u", "h", "x")], "page_id long, url string, html string, host string"), keep=("page_id", "host"))


def test_url_links_spread_distrust(spark):
    page = lambda i, host, *to: (i, f"https://{host}/p", "".join(f"<a href='https://{t}/'>" for t in to))
    rows = [page(1, "bad.net", "bad.net"), page(2, "farm.info", "bad.net"), page(3, "good.info", "news.info"), page(4, "news.info"), (5, "https://x.org/fr/1", '<a href="https://news.info/a">')]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_distrust_reaches_far_hosts(spark):
    n = 30  # host i links to host i - 1, host 0 is blocked
    score = np.eye(n)[0]
    for _ in range(500):
        moved = np.append(0, score[:-1])
        score = urls.DAMPING * moved + (1 - urls.DAMPING * moved.sum()) * np.eye(n)[0]
    want = {i: "block" if score[i] > urls.FLOOR / n else "allow" for i in range(n)}
    assert want[27] == "block" and want[29] == "allow"
    host = lambda i: f"h{i}.info" if i else "bad.net"
    rows = [(i, f"https://{host(i)}/p", f"<a href='https://{host(i - 1)}/'>" if i else "") for i in range(n)]
    assert {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want
    with pytest.raises(RuntimeError):
        urls.rank(spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("a", 1.0)], "host string, weight double"), rounds=2)


# ---- vectors ----


def brute_nearest(rows, k):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-vectors.scores(q[None], v[None])[0], j) for j, v in usable if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def check_vectors(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(j, s) for _, j, s in sorted(v)] for q, v in got.items()}


def test_vectors_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(size=12) * rng.choice([0.1, 1])]) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # a third of equal vectors
    rows += [(3000, None), (3020, []), (3040, [0.0] * 12), (3060, [float("nan")] * 12), (3080, [None] + [1.0] * 11), (3100, [1.0, 2.0]), (3101, [2.0, 1.0]), (3120, [float("inf")] * 12)]
    monkeypatch.setattr(vectors, "LEAF", 16)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    monkeypatch.setattr(vectors, "bounded_batches", lambda _: None)
    assert check_vectors(spark, rows, k=20) == brute_nearest(rows, 20)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_ties_and_unlike_norms():
    rng = np.random.default_rng(14)
    binary = (rng.random((3000, 12)) < 0.5).astype(float)
    unit = rng.normal(size=(2000, 12))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    unlike = np.concatenate([unit, [unit[0] * 1e9], unit[:5] * 1e-9])
    for points in (np.unique(binary, axis=0)[1:], np.eye(300), unlike):
        points = rng.permutation(points)
        ids = rng.permutation(len(points))
        asked = ids % 20 == 0
        q, v, s = vectors.search_shard(ids, points, ids[asked], points[asked], 20, 1.0)
        for i, x in zip(ids[asked], points[asked]):
            all_s = vectors.scores(np.broadcast_to(x, points.shape), points)
            want = [(j, a) for a, j in sorted((-a, j) for a, j in zip(all_s, ids) if j != i)[:20]]
            assert [(b, -a) for b, a in zip(v[q == i], s[q == i])] == want


def test_vectors_relaxed_search_keeps_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(2000)]
    want, got = brute_nearest(rows, 10), check_vectors(spark, rows, k=10, factor=1.15)
    recall = np.mean([len({j for j, _ in want[q]} & {j for j, _ in got[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_vectors_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert check_vectors(spark, rows, k=20) == brute_nearest(rows, 20)
    assert check_vectors(spark, [], k=3) == {}


def test_tree_skips_what_it_may(monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(4000, 2))
    tree = vectors.Tree(points, leaf=16)
    queries = rng.normal(size=(50, 2))
    best, found = tree.search(queries, 5)
    for q in range(50):
        d = ((points - queries[q]) ** 2).sum(1)
        assert set(found[q]) == set(np.argsort(d)[:5])


# ---- names of the operators' own ----


def test_columns_to_keep_must_not_have_the_operators_names(spark, vocabulary):
    df = spark.createDataFrame([(1, "a", "en", "s", "x", "x", "x", "x", "x")], "doc_id long, text string, lang string, source string, n_words string, size string, spans string, score string, ids string")
    for work in (
        lambda: quality.judge(df, keep=("doc_id", "lang", "source", "n_words")), lambda: mixing.mix(df, keep=("doc_id", "size")), lambda: pii.find_spans(df, keep=("spans",)),
        lambda: language.identify(df, keep=("doc_id", "Score")), lambda: bpe.encode_documents(df, vocabulary, keep=("ids",)),
    ):
        with pytest.raises(ValueError, match="operator's own"):
            work()
