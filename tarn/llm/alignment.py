"""Cross-tokenizer alignment: which tokens of a byte-level BPE vocabulary (A) and of a sentencepiece vocabulary (B) stand for the same bytes.

Both encode the same bytes (a space and the text), so the running sums of token lengths are cuts of one byte line, and whole blocks of documents
are aligned at once, end to end: cumulated lengths give each token's end, ``intersect1d`` of both gives the cuts they share, ``searchsorted`` labels
tokens with the group between two cuts, and repeats of each A token by the number of B tokens over its bytes give all links.

Corpus-wide counts take two steps so that no document is tokenized twice and no link is shuffled by itself:

1. one pass writes, for each block of documents, the distinct id pairs with their number in the block, and the links as codes into that list;
2. pairs are added up by (pair, salt), then by pair; each block gets the counts of its own pairs back, and adds them up along its documents' links.

Blocks have at most ``BLOCK_LINKS`` links or one document, which bounds the memory of a task; a pair that every block holds has one row for each block.

Defined results: texts that are null, empty or not reproduced byte for byte by a vocabulary (sentencepiece may rewrite some) have no tokens, zeros everywhere and
'' as their digest; strings of special tokens inside texts are plain text; rows that repeat are each aligned and counted, null ids too; other columns are ignored, and an
empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import arrow_schema, bounded_batches, record_batch, shared_folder
from tarn.llm.bpe import PIECES, byte_alphabet

#: Links of a block, unless one document has more.
BLOCK_LINKS = 3_000_000
#: Bytes of text that are encoded before they are aligned.
SLICE_BYTES = 2_000_000
#: Parts in which a pair's rows are added up first.
SALTS = 16
B_BITS = 32
#: Bytes without a border of ASCII white space that the fast encoder, whose time grows with the square of a run, doesn't get.
LONG_RUN = 1000


class Encoders:
    """Both vocabularies, from the content of their files, with the bytes, lengths and decimal names of every id."""

    def __init__(self, spec: str, model: bytes):
        import json

        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        data = json.loads(spec)
        vocab, pre = data["model"]["vocab"], data["pre_tokenizer"]
        if data["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or data.get("normalizer"):
            raise ValueError("the first vocabulary must be byte-level BPE without a normalizer")
        self.spec = spec
        self.slow = None
        self.bytes_a = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items() if all(c in alphabet for c in token)}
        special = {t["id"] for t in data.get("added_tokens") or []}
        ranks = {b: i for i, b in self.bytes_a.items() if i not in special}
        made = [ranks["".join(p.split(" ") if isinstance(p, str) else p).translate({ord(c): b for c, b in alphabet.items()}).encode("latin-1")] for p in data["model"]["merges"]]
        self.fast = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_b = {i: piece_bytes(self.pieces.id_to_piece(i), self.pieces.is_byte(i)) for i in range(self.pieces.get_piece_size())}
        self.length_a, self.length_b = lengths(self.bytes_a), lengths(self.bytes_b)
        self.digits_a, self.digits_b = digits(len(self.length_a)), digits(len(self.length_b))

    def encode_a(self, text: str, whole: bytes) -> np.ndarray:
        if self.fast is not None and longest_run(whole) < LONG_RUN:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.spec)
            self.slow.encode_special_tokens = True
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, text: str) -> np.ndarray:
        return np.array(self.pieces.encode(text), np.int64)


def longest_run(data: bytes) -> int:
    """Most bytes in a row that are all ASCII white space (or control characters) or all something else."""
    space = np.frombuffer(data, np.uint8) <= 32
    turns = np.flatnonzero(space[1:] != space[:-1])
    return int(np.diff(turns, prepend=-1, append=len(data) - 1).max())


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


def lengths(of: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(of) + 1, np.int64)
    out[list(of)] = [len(b) for b in of.values()]
    return out


def digits(n: int) -> np.ndarray:
    """ASCII digits of 0 to n - 1, left-aligned, zero bytes behind them, with room for a mark."""
    out = np.zeros((n, len(str(n)) + 1), np.uint8)
    for i, name in enumerate(map(str, range(n))):
        out[i, : len(name)] = np.frombuffer(name.encode(), np.uint8)
    return out


class Slice:
    """Documents aligned end to end. ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` are by document, ``pairs`` has every link's ids, a << 32 | b."""

    def __init__(self, encoders: Encoders, texts: list[str | None], with_groups: bool):
        ids_a, ids_b, sizes, self.n_a, self.n_b = [], [], [], [], []
        for text in texts:
            a = b = np.zeros(0, np.int64)
            size = 0
            if text:
                whole = (" " + text).encode("utf-8")
                a, b = encoders.encode_a(" " + text, whole), encoders.encode_b(text)
                if self.joined(encoders.bytes_a, a) == whole == self.joined(encoders.bytes_b, b):
                    size = len(whole)
                else:
                    a = b = np.zeros(0, np.int64)
            ids_a.append(a), ids_b.append(b), sizes.append(size), self.n_a.append(len(a)), self.n_b.append(len(b))
        a, b, stops = np.concatenate(ids_a), np.concatenate(ids_b), np.cumsum(sizes)
        length_a = encoders.length_a[a]
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(encoders.length_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.n_groups = np.diff(np.searchsorted(cuts, stops, "right"), prepend=0)
        first, last = np.searchsorted(ends_b, ends_a - length_a, "right"), np.searchsorted(ends_b, ends_a)
        width = last - first + 1
        upto = np.cumsum(width)
        which_a = np.repeat(np.arange(len(a)), width)
        which_b = np.arange(len(which_a)) - np.repeat(upto - width - first, width)
        self.pairs = a[which_a] << B_BITS | b[which_b]
        self.n_links = np.diff(np.r_[0, upto][np.cumsum(self.n_a)], prepend=0)
        groups = self.written(encoders, a, b, group_a, group_b)
        self.digests = [hashlib.sha256(t).hexdigest() if t else "" for t in groups]
        self.groups = [t.decode() for t in groups] if with_groups else []

    @staticmethod
    def joined(names: dict[int, bytes], ids: np.ndarray) -> bytes:
        return b"".join(map(names.__getitem__, ids.tolist()))

    def written(self, encoders: Encoders, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document: tokens in the order of their groups, each with the mark that follows it."""
        places_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        places_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        width = max(encoders.digits_a.shape[1], encoders.digits_b.shape[1])
        cells = np.zeros((len(a) + len(b), width), np.uint8)
        for ids, groups, places, names, mark in ((a, group_a, places_a, encoders.digits_a, "|"), (b, group_b, places_b, encoders.digits_b, ";")):
            rows = names[ids]
            sizes = (rows != 0).sum(1)
            rows[np.arange(len(ids)), sizes] = np.where(np.diff(groups, append=-1) != 0, ord(mark), ord(","))
            cells[places, : rows.shape[1]] = rows
        filled = cells != 0
        flat = cells[filled].tobytes()
        stops = np.r_[0, np.cumsum(filled.sum(1))][np.cumsum(np.array(self.n_a) + np.array(self.n_b))].tolist()
        return [flat[x : y - 1] if y > x else b"" for x, y in zip([0, *stops], stops)]


def packed(codes: np.ndarray) -> bytes:
    """Codes below 2^32 as zstd over their four byte planes."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


_made: dict[int, Encoders] = {}


def shared_encoders(spec, model) -> Encoders:
    """The encoders of broadcast vocabularies, kept by a Python worker that runs many tasks."""
    key = hash((spec.value, model.value))
    if key not in _made:
        _made.clear()
        _made[key] = Encoders(spec.value, model.value)
    return _made[key]


def align(df: DataFrame, vocabulary: str, pieces: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Alignment of every document, and corpus-wide counts of the id pairs linked in them.

    Documents: ``keep`` columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with ``with_groups``, groups (the text that is digested).
    Pairs: a_id, b_id, n_links and best (whether no other pair of this b_id has more links). ``vocabulary`` and ``pieces`` are files of the driver; their
    content, whose size is the file's, is broadcast. Blocks and pairs are written to the folder of
    ``spark.checkpoint.dir``, so a lost executor repeats its own blocks only.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    own = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups", "block", "place", "codes"}
    if clash := own & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    with open(pieces, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    folder = shared_folder(spark, "alignment")
    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    counted = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string" + (", groups string" if with_groups else "")
    schema = f"of string, block bigint, place int, {kept}{counted}, codes binary, pair bigint, n bigint"
    kinds = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = shared_encoders(spec, model)
        number = TaskContext.get().partitionId() << 32
        open_rows, open_slices, links = [], [], 0
        for batch in batches:
            for rows in slices(batch, len(keep)):
                made = Slice(encoders, rows.column(len(keep)).to_pylist(), with_groups)
                if links and links + len(made.pairs) > BLOCK_LINKS:
                    yield from block(open_rows, open_slices, number)
                    number, open_rows, open_slices, links = number + 1, [], [], 0
                open_rows.append(rows), open_slices.append(made)
                links += len(made.pairs)
        if open_rows:
            yield from block(open_rows, open_slices, number)

    def block(rows: list[pa.RecordBatch], parts: list[Slice], number: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([p.pairs for p in parts])
        codes, pairs = pd.factorize(every)
        size = sum(r.num_rows for r in rows)
        out = {name: pa.concat_arrays([r.column(i) for r in rows]) for i, name in enumerate(keep)}
        out |= {c: np.concatenate([np.asarray(getattr(p, c), np.int64) for p in parts]) for c in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"of": ["docs"] * size, "block": np.full(size, number), "place": np.arange(size), "codes": [packed(codes), *[None] * (size - 1)]}
        out |= {"groups_sha256": [d for p in parts for d in p.digests], "groups": [t for p in parts for t in p.groups]}
        out |= {c: pa.nulls(size, pa.int64()) for c in ("pair", "n")}
        yield record_batch(out, kinds)
        some = {"of": ["pairs"] * len(pairs), "block": np.full(len(pairs), number), "place": np.arange(len(pairs)), "pair": pairs, "n": np.bincount(codes, minlength=len(pairs))}
        yield record_batch({f.name: some.get(f.name, pa.nulls(len(pairs), f.type)) for f in kinds}, kinds)

    df.select(*keep, text).mapInArrow(run, schema).write.parquet(f"{folder}/blocks")
    docs, pairs = (spark.read.schema(schema).parquet(f"{folder}/blocks").where(F.col("of") == kind) for kind in ("docs", "pairs"))
    docs = docs.select("block", "place", *keep, *[f.name for f in kinds if f.name in own - {"block", "place"}])
    pairs = pairs.select("block", "place", "pair", "n")
    total_pairs(pairs).write.parquet(f"{folder}/pairs")
    total = spark.read.schema("pair bigint, n bigint, best boolean").parquet(f"{folder}/pairs")
    back = pairs.select("block", "place", "pair").join(total, "pair").select("block", "place", "n", "best")
    result = f"{kept}n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + (", groups string" if with_groups else "")
    result_type = arrow_schema(spark, result)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        links = left["n_links"].to_numpy()
        codes = unpacked(left["codes"][0].as_py(), int(links.sum()))
        at = right["place"].to_numpy()
        number, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        number[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        stops = np.cumsum(links)
        more = {"n_best": best, "count_sum": number}
        found = {f.name: left[f.name] for f in result_type if f.name not in more}
        for name, values in more.items():
            running = np.r_[0, np.cumsum(values[codes])]
            found[name] = pa.chunked_array([running[stops] - running[stops - links]])
        return pa.table([found[f.name].cast(f.type) for f in result_type], schema=result_type)

    documents = docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, result)
    named = total.select(F.shiftright("pair", B_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND(2**B_BITS - 1).cast("int").alias("b_id"), F.col("n").alias("n_links"), "best")
    return documents, named


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``SLICE_BYTES`` of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def total_pairs(pairs: DataFrame) -> DataFrame:
    """(pair, n, best) from one row for each pair and block: rows of a pair are added up in ``SALTS`` parts first, and best compares the pairs of one b id."""
    salted = pairs.groupBy("pair", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    total = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(2**B_BITS - 1)
    top = total.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return total.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
