"""Exact removal of repeated byte strings with suffix arrays.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document of smaller id, or earlier in the same one.
Strings never cross documents and are judged on the input.

A suffix array over a corpus can't be built in one task, so strings meet by content first:

1. Every window has an anchor, the leftmost ``ANCHOR``-byte string in it of least hash; equal windows have equal anchors at
   equal places. The windows of one anchor are consecutive and lie in one short context of fewer than 2 x ``WINDOW`` bytes. A task emits a row (anchor hash,
   context hash, document, range) for each context, and only for the first of equal contexts it sees: later ones are repeats whatever
   other tasks hold. That is the map-side combine which keeps a passage of a million copies to one row for each batch.
2. Rows meet by anchor, sorted, so that they are judged as they stream by. Equal contexts leave their first occurrence, all later ones are repeats. Anchors
   with one context left are done. Contexts are told apart by 128 bits here: the hash of the anchor and that of the whole context.
3. The bytes of the other contexts are fetched (a join by document) and meet by anchor. The contexts of an anchor form one text, whose suffix array
   (:mod:`tarn.llm.gsaca`) brings equal windows together: in each run of suffixes that share ``WINDOW`` bytes, all but the
   earliest are repeats. An anchor with many contexts (a phrase in very many surroundings) goes through the suffix arrays in pieces of ``TEXT_BYTES``: a window
   has many bytes on one side of the anchor at least, so contexts are dealt by the bytes next to the anchor, half of the windows by those on its left and
   half by those on its right, until a piece is small or holds a single string.
4. Ranges meet their documents, and covered bytes are cut out.

Every row is a few numbers except the texts, which are shuffled for the two joins as compressed bytes.

Defined results: a null text is empty. Texts shorter than ``WINDOW`` lose nothing. Rows that repeat an id and its text are the same document: they
don't precede each other and lose the same. Other texts of an id are documents of their own, in an order by their hashes. Each row with a null id is a document, after
all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import bounded_batches, checkpointed
from tarn.llm.gsaca import ranges, suffix_arrays

WINDOW, ANCHOR = 100, 40
#: Bytes hashed at a time: small enough for the processor's cache, below 2^20 for packed positions.
CHUNK = 1 << 16
#: Bytes of contexts that are sorted as one text, and bytes of many texts that are sorted in step.
TEXT_BYTES, STEP_BYTES = 32_768, 1 << 20
#: Rows that are judged, and bytes of contexts that are compared, at a time where they stream by.
STREAM_ROWS, STREAM_BYTES = 1 << 16, 1 << 24
_rng = np.random.default_rng(20)
#: A random number for each byte value; hashes are polynomials of these in an odd base modulo 2^64.
VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def doubled(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n bytes from hashes of n bytes."""
    return x[:-n] * power(n) + x[n:] if len(x) > n else x[:0]


def blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Rolling hashes of one buffer: arrays by power of two, and hashes of any length at chosen places."""

    def __init__(self, buffer: np.ndarray, values: np.ndarray = VALUES):
        self.levels = [values[buffer]]
        n = 1
        while 2 * n <= WINDOW:
            self.levels.append(doubled(self.levels[-1], n))
            n *= 2

    def at(self, places: np.ndarray | slice, length: int) -> np.ndarray:
        total, done = None, 0
        for level in reversed(range(len(self.levels))):
            n = 1 << level
            while length - done >= n:
                part = self.levels[level][places + done] if isinstance(places, np.ndarray) else self.levels[level][done : done + places.stop]
                total = part if total is None else total * power(n) + part
                done += n
        return blend(total)


def contexts(buffer: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of the documents that are concatenated in ``buffer``: anchor hash, context hash, start and end in the buffer."""
    n = len(buffer)
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - WINDOW + 1, 0)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    hashes = Hashes(buffer)
    anchor = hashes.at(slice(0, n - ANCHOR + 1), ANCHOR)
    low = (anchor & ~np.uint64(0xFFFFF)) | np.arange(len(anchor), dtype=np.uint64)  # ties go to the leftmost
    span, wide = 1, WINDOW - ANCHOR + 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    starts = ranges(ends - lengths, counts)
    place = (low[starts] & np.uint64(0xFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b = starts[first], starts[last] + WINDOW
    # two overlapping windows and the length cover a context
    content = blend(hashes.at(a, WINDOW) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes.at(b - WINDOW, WINDOW) + (b - a).astype(np.uint64))
    return anchor[place[first]], content, a, b


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges by document, as sorted disjoint ranges."""
    if not len(doc):
        return doc, a, b
    by = np.lexsort((a, doc))
    doc, a, b = doc[by], a[by], b[by]
    first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1) != 0)
    # the furthest end so far inside each document: documents are lifted above each other so that one running maximum serves all
    lift = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc)))) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], reach[np.append(at[1:], len(doc)) - 1]


def later(doc: np.ndarray, a: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts rows by keys, document and place. Returns the order, which rows are the first of their keys, and which start later than that one."""
    by = np.lexsort((a, doc, *reversed(keys)))
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return by, new, (doc[by] != doc[head]) | (a[by] != a[head])


#: Rows before the first exchange are many; they carry a range as one number, its start above its length.
NAMES = ["anchor", "content", "doc", "at"]
LENGTH_BITS = 31


def packed_range(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << LENGTH_BITS | (b - a)


def unpacked_range(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = at >> LENGTH_BITS
    return a, a + (at & ((1 << LENGTH_BITS) - 1))


def batch_of(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], names=names)


def spread(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A key that deals finished ranges evenly."""
    return blend(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64))


def emit_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: rows (anchor, content, doc, at); content 0 marks a range that is known to be a repeat."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        parts: list[tuple[np.ndarray, ...]] = []
        chunk: list[int] = []
        size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (chunk and size + len(texts[i]) > CHUNK):
                for piece_ids, piece_offsets, pieces in pieces_of(ids, texts, chunk):
                    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
                    anchor, content, a, b = contexts(np.frombuffer(b"".join(pieces), np.uint8), lengths)
                    if len(a):
                        ends = np.cumsum(lengths)
                        owner = np.searchsorted(ends, a, side="right")
                        shift = piece_offsets[owner] - (ends - lengths)[owner]
                        parts.append((anchor, content | np.uint64(1), piece_ids[owner], a + shift, b + shift))
                chunk, size = [], 0
            if i < len(texts) and len(texts[i]) >= WINDOW:
                chunk.append(i)
                size += len(texts[i])
        if not parts:
            continue
        anchor, content, doc, a, b = (np.concatenate(c) for c in zip(*parts))
        by, new, repeat = later(doc, a, [anchor, content])
        first, known = by[new], by[repeat]
        yield batch_of(NAMES, anchor[first], content[first], doc[first], packed_range(a[first], b[first]))
        if len(known):
            d, x, y = merged(doc[known], a[known], b[known])
            yield batch_of(NAMES, spread(d, x), np.zeros(len(d), np.int64), d, packed_range(x, y))


def pieces_of(ids: np.ndarray, texts: list[bytes], chunk: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """The texts of a chunk; one longer than packed positions allow is cut into pieces that overlap by WINDOW - 1 bytes,
    so every window is in exactly one piece."""
    if not chunk:
        return
    step = (1 << 20) - WINDOW
    if len(chunk) == 1 and len(texts[chunk[0]]) > step:
        text = texts[chunk[0]]
        for at in range(0, len(text) - WINDOW + 1, step):
            yield ids[chunk], np.array([at]), [text[at : at + step + WINDOW - 1]]
    else:
        yield ids[chunk], np.zeros(len(chunk), np.int64), [texts[i] for i in chunk]


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of several batches as one, in the same order; the last group may be small."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: rows (anchor, doc, a, b); anchor 0 marks a repeat, else the context is to be compared with others of its anchor. The input is
    sorted by anchor, content, document and place; from one group of rows to the next only the last row's first equal is kept."""
    names = ["anchor", "doc", "a", "b"]
    none = np.zeros(0, np.int64)
    # anchor, content, doc, at of the first of the last context, and whether its anchor has had another context before
    last, several = (none, none, none, none), np.zeros(0, bool)
    for columns in gathered(batches, STREAM_ROWS):
        known = columns[1] == 0
        a, b = unpacked_range(columns[3][known])
        found = [(columns[2][known], a, b)]
        anchor, content, doc, at = (np.concatenate([x, c[~known]]) for x, c in zip(last, columns))
        if len(anchor):
            same_anchor = np.concatenate(([False], anchor[1:] == anchor[:-1]))
            new = ~(same_anchor & np.concatenate(([False], content[1:] == content[:-1])))
            head = np.flatnonzero(new)
            of = head[np.cumsum(new) - 1]
            a, b = unpacked_range(at)
            repeat = ~new & ((doc != doc[of]) | (a != a[of]))
            found.append((doc[repeat], a[repeat], b[repeat]))
            more = same_anchor[head]  # contexts with an earlier one of their anchor
            before = more.copy()
            before[: len(several)] = several
            open_ = before.copy()
            open_[:-1] |= more[1:]
            open_[: len(several)] &= ~several  # went out when it was seen
            out = head[open_]
            several = before[-1:] | open_[-1:]
            last = tuple(c[head[-1:]] for c in (anchor, content, doc, at))
            yield batch_of(names, anchor[out] | 1, doc[out], a[out], b[out])
        d, x, y = merged(*(np.concatenate(c) for c in zip(*found)))
        yield batch_of(names, np.zeros(len(d), np.int64), d, x, y)


FOUND = "anchor bigint, doc bigint, a bigint, b bigint, bytes binary"


def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3a: the bytes of the open contexts; finished ranges pass through with a key that deals them evenly and no bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        if not batch.num_rows:
            continue
        packed, lists = batch.column(0).to_pylist(), batch.column(1)
        counts = np.diff(lists.offsets.to_numpy())
        rows = lists.flatten()
        anchor, doc, a, b = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        out: list[bytes | None] = []
        at = 0
        for text, n in zip(packed, counts.tolist()):
            raw = unpack(text) if (anchor[at : at + n] != 0).any() else b""
            out += [raw[x:y] if k else None for k, x, y in zip(anchor[at : at + n].tolist(), a[at : at + n].tolist(), b[at : at + n].tolist())]
            at += n
        key = np.where(anchor == 0, spread(doc, a).view(np.int64), anchor)
        yield pa.record_batch([pa.array(key), pa.array(doc), pa.array(a), pa.array(b), pa.array(out, pa.binary())], names=["anchor", "doc", "a", "b", "bytes"])


def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3b: ranges (doc, a, b) that are repeats, from the suffix arrays of each anchor's contexts. The input is sorted by anchor."""
    keys, docs, places, texts, total = [], [], [], [], 0
    for batch in batches:
        open_ = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        anchor, doc, a, b = (batch.column(i).to_numpy() for i in range(4))
        if not open_.all():
            yield batch_of(["doc", "a", "b"], doc[~open_], a[~open_], b[~open_])
        if not open_.any():
            continue
        keys.append(anchor[open_])
        docs.append(doc[open_])
        places.append(a[open_])
        texts += batch.column(4).filter(pa.array(open_)).to_pylist()
        total += int((b - a)[open_].sum())
        if total > STREAM_BYTES:  # all whole anchors; the last one may go on
            key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            n = len(key) - int((key[::-1] != key[-1]).argmax()) if key[0] != key[-1] else 0
            if n:
                yield from compared(key[:n], doc[:n], place[:n], texts[:n])
                keys, docs, places, texts = [key[n:]], [doc[n:]], [place[n:]], texts[n:]
                total = sum(map(len, texts))
    if keys:
        yield from compared(np.concatenate(keys), np.concatenate(docs), np.concatenate(places), texts)


def compared(key: np.ndarray, doc: np.ndarray, place: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Repeats among the contexts of whole anchors: texts of similar sizes are sorted in step."""
    if not len(key):
        return
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    stop = np.append(start[1:], len(key))
    size = np.add.reduceat(length + 1, start)
    if size.max() > TEXT_BYTES:
        small = []
        for g in range(len(start)):
            rows = np.arange(start[g], stop[g])
            if size[g] <= TEXT_BYTES:
                small.append(rows)
            else:
                yield from in_pieces(key[start[g]], doc[rows], place[rows], [texts[i] for i in rows.tolist()])
        groups, size = small, size[size <= TEXT_BYTES]
    else:
        groups = [np.arange(a, b) for a, b in zip(start, stop)]
    yield from in_steps(groups, size, texts, doc, place)


def in_steps(groups: list[np.ndarray], size: np.ndarray, texts: list[bytes], doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    step: list[np.ndarray] = []
    total = 0
    for g in np.argsort(size, kind="stable").tolist():
        if step and total + size[g] > STEP_BYTES:
            yield repeats_by_suffixes(step, texts, doc, place)
            step, total = [], 0
        step.append(groups[g])
        total += int(size[g])
    if step:
        yield repeats_by_suffixes(step, texts, doc, place)


def anchors_in(key: np.int64, texts: list[bytes], length: np.ndarray) -> np.ndarray:
    """Where the anchor lies in each of its contexts: the first place from which the context's last window still covers it."""
    out = []
    for i in range(0, len(texts), 1000):
        size = length[i : i + 1000]
        ends = np.cumsum(size)
        hashes = Hashes(np.frombuffer(b"".join(texts[i : i + 1000]), np.uint8)).at(slice(0, int(ends[-1]) - ANCHOR + 1), ANCHOR).view(np.int64)
        hit = np.flatnonzero((hashes | 1) == key)
        out.append(hit[np.searchsorted(hit, ends - WINDOW)] - (ends - size))
    return np.concatenate(out)


def in_pieces(key: np.int64, doc: np.ndarray, place: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Repeats among very many contexts of one anchor. A piece holds contexts (rows) and windows that begin ``low`` to ``high`` bytes before the
    anchor, all with the same bytes from ``high`` - before to after it as far as every window of the piece covers them."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    anchor = anchors_in(key, texts, length)
    begin = np.cumsum(length) - length
    raw = np.frombuffer(b"".join(texts), np.uint8)
    spare = WINDOW - ANCHOR
    waiting = [(np.arange(len(texts)), 0, spare)]
    ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0
    while waiting:
        rows, low, high = waiting.pop()
        a, b = np.maximum(anchor[rows] - high, 0), np.minimum(anchor[rows] + WINDOW - low, length[rows])
        rows, a, b = (x[b - a >= WINDOW] for x in (rows, a, b))
        size = int((b - a + 1).sum())
        if size <= TEXT_BYTES:
            if len(rows) > 1:
                ready.append((rows, a, b))
                total += size
        elif low == high:  # all windows of the piece are one string
            yield repeats_of(np.zeros(len(rows), np.int64), doc[rows], place[rows] + a)
        else:
            middle = (low + high) // 2
            for x, y, first, count in ((middle + 1, high, -(middle + 1), middle + 1), (low, middle, ANCHOR, spare - middle)):
                # rows with a window of the half, by the bytes beside the anchor that all of these cover
                mine = rows[(anchor[rows] >= x) & (anchor[rows] + WINDOW - y <= length[rows])]
                if len(mine) > 1:
                    beside = raw[(begin[mine] + anchor[mine] + first)[:, None] + np.arange(count)]
                    _, of = np.unique(beside.view(np.dtype((np.void, count))).reshape(-1), return_inverse=True)
                    by = np.argsort(of, kind="stable")
                    waiting += [(part, x, y) for part in np.split(mine[by], np.flatnonzero(np.diff(of[by])) + 1) if len(part) > 1]
        if ready and (not waiting or total > STEP_BYTES):
            rows, a, b = (np.concatenate(c) for c in zip(*ready))
            cuts = np.cumsum([0, *(len(r) for r, _, _ in ready)])
            groups = [np.arange(x, y) for x, y in zip(cuts[:-1], cuts[1:])]
            part = [texts[i][x:y] for i, x, y in zip(rows.tolist(), a.tolist(), b.tolist())]
            ready, total = [], 0
            yield from in_steps(groups, np.array([int((b[g] - a[g] + 1).sum()) for g in groups]), part, doc[rows], place[rows] + a)


def repeats_by_suffixes(groups: list[np.ndarray], texts: list[bytes], doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    rows = np.concatenate(groups)
    length = np.fromiter((len(texts[i]) for i in rows.tolist()), np.int64, len(rows))
    per_text = np.fromiter(map(len, groups), np.int64, len(groups))
    last = np.cumsum(per_text) - 1
    # each text: a free place, then every context and a 1, the last 1 being the smallest code 0
    lead = np.zeros(len(rows), np.int64)
    lead[np.concatenate(([0], last[:-1] + 1))] = 1
    ends = np.cumsum(length + 1 + lead)
    begin = ends - length - 1
    codes = np.ones(int(ends[-1]), np.int64)
    inside = ranges(begin, length)
    raw = np.frombuffer(b"".join([texts[i] for i in rows.tolist()]), np.uint8)
    codes[inside] = raw.astype(np.int64) + 2
    codes[ends[last] - 1] = 0
    offsets = np.concatenate(([0], ends[last]))
    sorted_places = suffix_arrays(codes, offsets)
    owner = np.full(len(codes), -1)
    windows = length - WINDOW + 1
    owner[ranges(begin, windows)] = np.repeat(np.arange(len(rows)), windows)
    starts = sorted_places[owner[sorted_places] >= 0]
    small = np.zeros(len(codes), np.uint8)
    small[inside] = raw
    equal = np.empty(len(starts) - 1 if len(starts) else 0, bool)
    view = np.lib.stride_tricks.sliding_window_view(small, WINDOW)
    for i in range(0, len(equal), 50_000):
        part = view[starts[i : i + 50_001]]
        equal[i : i + 50_000] = (part[1:] == part[:-1]).all(1)
    text = np.repeat(np.arange(len(groups)), np.diff(offsets))
    equal &= text[starts[1:]] == text[starts[:-1]]
    run = np.concatenate(([0], np.cumsum(~equal))) if len(starts) else np.zeros(0, int)
    ctx = owner[starts]
    return repeats_of(run, doc[rows[ctx]], place[rows[ctx]] + starts - begin[ctx])


def repeats_of(run: np.ndarray, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Ranges of the windows that are not the earliest of their run of equal windows."""
    by, _, repeat = later(doc, start, [run])
    rows = by[repeat]
    return batch_of(["doc", "a", "b"], *merged(doc[rows], start[rows], start[rows] + WINDOW))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, kept (binary) and spans of every row."""
    spark = df.sparkSession
    bounded_batches(spark)
    source = rows_with_id(df, id_column, text)
    met = source.select("id", "raw").mapInArrow(emit_contexts, "anchor bigint, content bigint, doc bigint, at bigint")
    met = met.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "at")
    plan = met.mapInArrow(meet, "anchor bigint, doc bigint, a bigint, b bigint")
    by_document = plan.groupBy("doc").agg(F.collect_list(F.struct("anchor", "doc", "a", "b")).alias("rows"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([squeeze(x) for x in batch.column(2).to_pylist()], pa.binary())], names=["id", "given_id", "packed"])

    kind = df.schema[id_column].dataType.simpleString()
    packed = source.mapInArrow(pack, f"id bigint, given_id {kind}, packed binary")
    joined = packed.join(by_document, F.col("id") == F.col("doc")).select("packed", "rows")
    found = joined.mapInArrow(fetch, FOUND).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "doc bigint, a bigint, b bigint")
    cuts = found.groupBy("doc").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("stops"))
    whole = packed.join(cuts, F.col("id") == F.col("doc"), "left").select("given_id", "packed", "starts", "stops")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for squeezed, starts, stops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                raw = unpack(squeezed)
                kept, spans, end = raw, [], 0
                if starts:
                    _, a, b = merged(np.zeros(len(starts), np.int64), np.array(starts), np.minimum(np.array(stops), len(raw)))
                    spans = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x < y]
                    pieces = []
                    for x, y in spans:
                        pieces.append(raw[end:x])
                        end = y
                    kept = b"".join([*pieces, raw[end:]])
                for k, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans)):
                    out[k].append(v)
            arrays = [batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays += [pa.array(out["kept"], pa.binary()), pa.array([[{"start": x, "end": y} for x, y in s] for s in out["spans"]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.record_batch(arrays, names=names)

    extra = ", kept binary, spans array<struct<start: bigint, end: bigint>>" if with_text else ""
    return whole.mapInArrow(cut, f"`{id_column}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}")


def rows_with_id(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id (a number for each document, in their order), given_id and raw. Ids that are neither null nor repeated are their own numbers; else rows are
    sorted by id and text and numbered, once for both passes over them."""
    order = F.col(id_column).cast("long")
    rows = df.select(order.alias("id"), F.col(id_column).alias("given_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1").isEmpty():
        return rows
    by = [F.col("id").asc_nulls_last(), "text_hash", "text_hash_2"]
    hashed = rows.withColumn("text_hash", F.xxhash64("raw")).withColumn("text_hash_2", F.xxhash64(F.lit(1), "raw"))
    placed = checkpointed(hashed.orderBy(*by).withColumn("place", F.monotonically_increasing_id()))
    kind = df.schema[id_column].dataType.simpleString()

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, 0  # equal rows are neighbours in one partition
        for batch in batches:
            out = []
            for *row, place in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if row[0] is None or row != last:
                    last, doc = row, place
                out.append(doc)
            yield pa.record_batch([pa.array(out, pa.int64()), batch.column(1), batch.column(2)], names=["id", "given_id", "raw"])

    return placed.select("id", "given_id", "raw", "text_hash", "text_hash_2", "place").mapInArrow(number, f"id bigint, given_id {kind}, raw binary")
