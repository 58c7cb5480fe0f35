"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token starts as its bytes. A segment tree holds, for every position, the rank of the pair (this symbol, next
symbol); an inner node keeps the leftmost child of lower rank, so the root names the leftmost pair of lowest rank.
A merge rewrites one symbol, unlinks the next one and updates at most three leaves, each in logarithmic time; encoding ends when
the root holds no mergeable pair.

Two forms share that design: :meth:`Tokenizer.merge_one` walks one tree in plain Python (long pre-tokens), and
:meth:`Tokenizer.merge_many` runs the trees of many short pre-tokens in step as NumPy arrays (one tree per row).
Results are cached by pre-token, so a frequent word is merged once however often it occurs. Only pre-tokens of up to ``STEP_BYTES`` are cached, in two generations of at most
``CACHE_BYTES`` each, counted with what Python needs for an entry; results don't depend on it.

Defined results: a null text encodes like the empty text (no ids); texts of any length are encoded whole; rows that repeat are each returned, null ids too; an empty table gives
none; other columns are ignored, and a column to keep that is named like one of the result is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tarn.llm.batches import arrow_schema, bounded_batches, record_batch, refuse_names

#: Fixed values of byte-level BPE: the pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without characters above U+00FF, whose classes can be spelled out for Python's faster re module.
LATIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
NO_PAIR = np.iinfo(np.int32).max
#: Pre-tokens up to this many bytes are merged in step; longer ones each walk their own tree.
STEP_BYTES = 64
#: Bytes of a generation of the cache, and of an entry besides its two texts.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 220


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the published rule: printable
    Latin-1 bytes stand for themselves, the others get the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary, read from the JSON text of a tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or data.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        if pre["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix spaces, ignored merges and dropout are not supported")
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        pairs = [(p.split(" ") if isinstance(p, str) else p) for p in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.made = made
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in data.get("added_tokens") or []):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        #: pre-token -> its ids as decimal text, comma-joined
        self.cache: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.cached_bytes = 0
        self.text_bytes = {str(i): b for i, b in self.bytes_of.items()}
        self.names = {i: str(i) for i in self.bytes_of}

    def merge_one(self, ids: list[int]) -> list[int]:
        """One segment tree in plain Python; O(log n) for each merge."""
        n = len(ids)
        if n < 2:
            return ids
        size, rank_of, made = self.size, self.rank_of, self.made
        ids = list(ids)
        width = 1 << (n - 1).bit_length()
        none = NO_PAIR
        tree = [none] * (2 * width)  # ranks; the leftmost minimum is found on the way down
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        for i in range(n - 1):
            tree[width + i] = rank_of.get(ids[i] * size + ids[i + 1], none)
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

        def put(i: int, rank: int) -> None:
            i += width
            tree[i] = rank
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] != none:
            rank, i = tree[1], 1
            while i < width:
                i = 2 * i if tree[2 * i] == rank else 2 * i + 1
            i -= width
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = int(made[rank]), -1, k
            put(j, none)
            if k >= 0:
                before[k] = i
                put(i, rank_of.get(ids[i] * size + ids[k], none))
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                put(h, rank_of.get(ids[h] * size + ids[i], none))
        return [x for x in ids if x >= 0]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Many segment trees in step: row r is the tree of words[r], all padded to one power of two."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        width = 1 << int(max(1, (lens.max() - 1))).bit_length() if lens.max() > 1 else 1
        ids = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < lens[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(np.arange(1, width + 2) < lens[:, None], np.arange(1, width + 2), width).astype(np.int64)
        before = np.tile(np.arange(-1, width), (n, 1)).astype(np.int64)
        tree = np.full((n, 2 * width), NO_PAIR, np.int32)
        pair = inside[:, 1:]
        tree[:, width:][pair] = self.look_up(ids[:, :-1][pair], ids[:, 1:][pair])
        step = width
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            i = at + width
            tree[rows, i] = rank
            while width > 1 and i[0] > 1:
                i >>= 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        live = np.flatnonzero(tree[:, 1] != NO_PAIR) if width > 1 else np.zeros(0, np.int64)
        while len(live):
            rank = tree[live, 1]
            i = np.ones(len(live), np.int64)
            while i[0] < width:
                i = 2 * i + (tree[live, 2 * i] != rank)
            i -= width
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = self.made[rank], -1
            after[live, i] = k
            put(live, j, np.full(len(live), NO_PAIR, np.int32))
            new = np.full(len(live), NO_PAIR, np.int32)
            more = k < width
            new[more] = self.look_up(ids[live[more], i[more]], ids[live[more], k[more]])
            before[live[more], k[more]] = i[more]
            put(live, i, new)
            h = before[live, i]
            some = h >= 0
            if some.any():
                rows, at = live[some], h[some]
                put(rows, at, self.look_up(ids[rows, at], ids[rows, i[some]]))
            live = live[tree[live, 1] != NO_PAIR]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, given as bytes."""
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > STEP_BYTES:
                out[i] = self.merge_one(self.byte_id[np.frombuffer(piece, np.uint8)].tolist())
            else:
                by_width.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for rows in by_width.values():
            for i, ids in zip(rows, self.merge_many([pieces[r] for r in rows])):
                out[i] = ids
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, str]:
        """The ids of pre-tokens that the cache lacks. Short ones go into it; a full generation becomes the old one."""
        new, names, found = list(pieces), self.names, {}
        for piece, ids in zip(new, self.merge([p.encode() for p in new])):
            found[piece] = names[ids[0]] if len(ids) == 1 else ",".join([names[i] for i in ids])
        for piece, ids in found.items():
            if len(piece) <= STEP_BYTES:
                self.keep(piece, ids)
        return found

    def keep(self, piece: str, ids: str) -> None:
        size = ENTRY_BYTES + 4 * len(piece) + len(ids)  # a character takes four bytes at most
        if self.cached_bytes + size > CACHE_BYTES:
            self.old, self.cache, self.cached_bytes = self.cache, {}, 0
        self.cache[piece] = ids
        self.cached_bytes += size

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pieces.findall(text)
        return LATIN.findall(text)

    def encode_texts(self, texts: list[str | None]) -> list[str]:
        """The ids of each text as comma-joined decimals."""
        parts: list[list[str]] = []
        known = {t: str(i) for t, i in self.special.items()}
        for text in texts:
            found: list[str] = []
            for k, part in enumerate(self.split_special.split(text or "") if self.split_special else [text or ""]):
                if k % 2:
                    found.append(part)
                elif part:
                    found += self.split(part)
            parts.append(found)
        wanted = set().union(*parts).difference(known)
        cache, old = self.cache, self.old
        hits = wanted & cache.keys()
        known.update(zip(hits, map(cache.__getitem__, hits)))
        wanted -= hits
        again = wanted & old.keys()  # what is still in use moves over
        moved = dict(zip(again, map(old.__getitem__, again)))
        known.update(moved)
        for piece, ids in moved.items():
            self.keep(piece, ids)
        known.update(self.learn(wanted - again))
        return [",".join(map(known.__getitem__, found)) for found in parts]

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_texts([text])[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode_joined(self, ids: str) -> str:
        """Text of comma-joined ids; bytes that are not UTF-8 become U+FFFD, and unknown ids give nothing."""
        get = self.text_bytes
        return b"".join([get.get(x, b"") for x in ids.split(",")]).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


_made: dict[int, Tokenizer] = {}


def shared_tokenizer(spec) -> Tokenizer:
    """The tokenizer of a broadcast vocabulary; a Python worker that runs many tasks keeps it, and its cache."""
    if (key := hash(spec.value)) in _made:
        return _made[key]
    _made.clear()
    return _made.setdefault(hash(spec.value), Tokenizer(spec.value))


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Encode ``text`` with the vocabulary file at ``vocabulary`` and decode the ids again.

    Returns the ``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids (array of int) and decoded. The
    vocabulary (about 1.5 MB, its size set by the file, not by the data) is read on the driver and broadcast once.
    """
    spark = df.sparkSession
    refuse_names(keep, {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"})
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    kinds = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(spec)
        for batch in batches:
            joined = tokenizer.encode_texts(batch.column(len(keep)).to_pylist())
            decoded = [tokenizer.decode_joined(x) for x in joined]
            out = {c: batch.column(i) for i, c in enumerate(keep)}
            out["n_tokens"] = [x.count(",") + 1 if x else 0 for x in joined]
            out["ids_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
            out["decoded_sha256"] = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded]
            if with_ids:
                out["ids"] = [[int(i) for i in x.split(",")] if x else [] for x in joined]
                out["decoded"] = decoded
            yield pa.record_batch([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)

    return df.select(*keep, text).mapInArrow(run, schema)
