"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Subwords are byte trigrams and tetragrams of the whole text, with A-Z lower-cased, hashed into 2^``BITS`` rows of an embedding table. A text is
the mean of its subwords' embeddings; a linear layer and softmax give the languages' probabilities. Embeddings and layer are trained by
stochastic gradient descent in NumPy on a bounded sample of labelled rows: an equal part of ``SAMPLE`` for each language, ``LEAST_EACH`` at least, chosen by a
hash of the text, so copies count once and a rare language is learnt too. What comes to the driver is no text but the sample's subword counts, ``BAG_BYTES`` at most for all rows together
whatever the number of languages: a row has an equal part of them, and of a text with more subwords those of least hash are counted. A part of the sample is kept out of training for calibration: a temperature that minimises its log loss, and the confidence below which a prediction is
rejected so that accepted ones reach ``PRECISION``.

Since the model is linear after averaging, embedding table times layer is one table of logits by subword, so a prediction is one table
look-up for each subword. With more than ``WIDTH`` languages the embeddings are looked up and the layer is applied to their mean, so the table never has more than ``WIDTH`` columns (4 MB). It
is broadcast once.

Defined results: a null id counts as held out; ``und`` with score 0 if the text is null or has no letter, whatever the model says, and if no labelled row exists; letters are the Unicode category L. Long texts
are scored whole. More than ``MOST_LANGUAGES`` labels are an error. Repeated rows get equal results. The label, source and id are never read for a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import map_rows, refuse_names

BITS = 16
WIDTH = 16
#: Labelled rows that training reads (about; the sample is a hash range for each language, so it is the same on every run), and least for each language.
SAMPLE, LEAST_EACH, MOST_LANGUAGES = 2500, 50, 2000
#: Bytes of the sample's subword counts on the driver, eight for each subword of a row.
BAG_BYTES = 128 << 20
EPOCHS, RATE, CALIBRATION = 5, 2.0, 0.2
PRECISION = 0.99
FOLDS = 5
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def subwords(text: str) -> np.ndarray:
    """Table rows of the text's subwords."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        raw = np.concatenate([raw, np.full(3 - len(raw), 32, np.uint32)])
    three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    four = three[:-1] | raw[3:] << np.uint32(24)
    spread = np.concatenate([three * np.uint32(0x9E3779B1), four * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)])
    return spread >> np.uint32(32 - BITS)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # logits (or embeddings) by subword, float32, already divided by the temperature
    threshold: float
    layer: np.ndarray | None = None  # what makes logits of embeddings

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability and whether it is rejected as too uncertain."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        rows = subwords(text)
        total = np.zeros(self.table.shape[1])
        for a in range(0, len(rows), 65_536):
            total += self.table[rows[a : a + 65_536]].sum(0, dtype=np.float64)
        mean = total / len(rows)
        p = softmax(mean if self.layer is None else mean @ self.layer)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct subwords and how often it has each."""
    return np.unique(subwords(text), return_counts=True)


def thinned(rows: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` subwords, those of least hash."""
    if len(rows) <= most:
        return rows, counts
    kept = np.sort(np.argsort(rows * np.uint32(0x9E3779B1), kind="stable")[:most])
    return rows[kept], counts[kept]


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """Train on (text, language) pairs."""
    return fit([(*bag(text), lang) for text, lang in samples if text and LETTER.search(text)], epochs, rate, seed)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """Train on (subwords, their counts, language)."""
    languages = tuple(sorted({lang for *_, lang in samples}))
    if not languages:
        return Model((), np.zeros((1 << BITS, 1), np.float32), 1.0)
    rng = np.random.default_rng(seed)
    held = rng.random(len(samples)) < CALIBRATION if len(samples) >= 50 else np.zeros(len(samples), bool)
    bags = [(rows, n / n.sum()) for rows, n, _ in samples]
    gold = np.array([languages.index(lang) for *_, lang in samples])
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    layer = rng.normal(0, 0.3, (WIDTH, len(languages)))
    trained = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(trained):
            rows, share = bags[i]
            mean = share @ embed[rows]
            slope = softmax(mean @ layer)
            slope[gold[i]] -= 1
            back = layer @ slope
            layer -= step * 0.1 * np.outer(mean, slope)
            embed[rows] -= step * len(rows) ** 0.5 * share[:, None] * back
    wide = len(languages) > WIDTH  # then the product of both would be larger than the embeddings
    check = np.flatnonzero(held) if held.any() else trained
    logits = np.array([bags[i][1] @ embed[bags[i][0]] @ layer for i in check])
    heats = np.geomspace(1, 50, 61)  # never sharper than trained: a few calibration rows can all be right
    loss = [-np.log(softmax(logits / t)[np.arange(len(check)), gold[check]] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(logits / heat)
    sure, right = p.max(1), p.argmax(1) == gold[check]
    order = np.argsort(-sure)
    precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    threshold = float(sure[order[precise[-1]]]) if len(precise) else 1.0
    if wide:
        return Model(languages, embed.astype(np.float32), threshold, layer / heat)
    return Model(languages, (embed @ layer / heat).astype(np.float32), threshold)


def fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS


def learn(df: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled rows whose id is not in the held-out fold."""
    labelled = df.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return fit([])
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(LEAST_EACH, sample / len(sizes))
    parts = F.create_map(*(F.lit(x) for r in sizes for x in (r[0], int(min(1.0, each / r[1]) * 2**62))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(17), "text"), 2)
    chosen = labelled.where(place <= parts[F.col("lang")]).groupBy("lang", place.alias("place")).agg(F.first("text").alias("text"))

    most = max(1, int(BAG_BYTES / 8 / max(sample, LEAST_EACH * len(sizes))))

    def work(lang: pa.Array, place: pa.Array, texts: list) -> dict:
        bags = [np.array(thinned(*bag(t), most), np.uint32).tobytes() if LETTER.search(t) else b"" for t in texts]
        return {"lang": lang, "place": place, "bag": bags}

    rows = map_rows(chosen, ["lang", "place", "text"], work, "lang string, place bigint, bag binary").collect()
    ordered = sorted((r.lang, r.place, r.bag) for r in rows if r.bag)
    return fit([(*np.frombuffer(b, np.uint32).reshape(2, -1), lang) for lang, _, b in ordered])


def identify(df: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected; trains on ``df`` unless a model is given."""
    refuse_names(keep, {"lang_pred", "score", "rejected"})
    shared = df.sparkSession.sparkContext.broadcast(model or learn(df))

    def work(*columns: list) -> dict:
        found = [shared.value.predict(t) for t in columns[-1]]
        return dict(zip(keep, columns)) | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(df, [*keep, text], work, f"{kept}, lang_pred string, score double, rejected boolean")
