"""Removal of repeated passages: every byte under a string of ``WIDTH`` bytes that starts earlier too.

A window is a string of ``WIDTH`` bytes in a text.  Its spot is the place of its least ``GRAM``-byte gram by a
hash, the first of equal ones, so equal windows have their spot at the same place, and windows one after the
other mostly share it; two windows of one spot are never equal.  The windows of a spot are one piece of text.  Grams that occur once in the corpus repeat
nothing; the pieces of all others go to the shard of their gram, equal pieces as one with its first occurrence.
A shard's suffixes are sorted with their common prefixes by induced sorting on disk (``induced_sort``), and among
the windows with ``WIDTH`` bytes in common all but the first in the order of texts are repeats.

A gram with very many different pieces is split: each of its windows also holds half of the missing bytes on one
side of the gram, which makes a longer gram of it, and so on up to whole windows, which are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.llm.induced_sort import Scratch, order
from roamgrid.llm.rows import join_groups, numbered
from roamgrid.plans.storage import written

WIDTH, GRAM = 100, 32
#: Grams up to this number are broadcast, 8 bytes each; beyond it spots are joined with them.
BROADCAST_GRAMS = 4_000_000
#: Different pieces of a gram that a shard takes, and bytes of pieces in a shard.
MOST_OF_GRAM, SHARD_BYTES = 20_000, 6 << 20
#: Bytes of texts that are looked at together.
CHUNK_BYTES = 4 << 20
#: Bytes of texts whose hashes are worked out together: what a processor's cache holds.
SPOT_BYTES = 128 << 10
MIX = np.uint64(0x9E3779B97F4A7C15)
SPOT = "struct<at:long,size:int,gram:int,key:long>"


def _hashed(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on; ``size`` is a power of two."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, int(MIX)
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def spots(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each spot: the text's number, where its first window begins, how many it has, where in it the gram is, and the gram's hash."""
    found, begin, size = [], 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= SPOT_BYTES or end == len(texts):
            one = _spots(texts[begin:end])
            found.append((one[0] + begin, *one[1:]))
            begin, size = end, 0
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _spots([])


def _spots(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < WIDTH:
        return none, none, none, none, none
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    h = _hashed(data, GRAM)
    least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # of equal ones the first
    width, wanted = 1, WIDTH - GRAM + 1
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    # windows inside one text
    inside = np.ones(len(least), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - WIDTH + 1) : end] = False
    window = np.flatnonzero(inside)
    if not len(window):
        return none, none, none, none, none
    place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    text = np.searchsorted(ends, window[first], "right")
    at = window[first] - (ends - lengths)[text]
    return text, at, np.diff(np.append(first, len(window))), place[first] - window[first], h[place[first]].view(np.int64)


def _chunks(batches) -> Iterator[list[tuple]]:
    """Rows as tuples, the texts of a chunk of few bytes together; a batch's columns are number, doc_id, text and more."""
    chunk, size = [], 0
    for b in batches:
        for number, doc_id, text, *more in zip(*b.columns):
            chunk.append((number.as_py(), doc_id.as_py(), text.as_buffer().to_pybytes(), *more))
            size += len(chunk[-1][2])
            if size >= CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


class _Spots:
    """Spots of repeated grams, found by a broadcast of these or given with each text."""

    def __init__(self, grams):
        self.grams = grams

    def of(self, chunk: list[tuple]) -> tuple[np.ndarray, ...]:
        if self.grams is None:
            own = [(i, *s.values()) for i, row in enumerate(chunk) for s in row[3].as_py() or ()]
            text, at, size, gram, key = np.array(sorted(own), np.int64).reshape(-1, 5).T
            return text, at, size, gram, key
        found = spots([row[2] for row in chunk])
        wanted = self.grams.value
        if not len(wanted):
            return tuple(x[:0] for x in found)
        there = np.minimum(np.searchsorted(wanted, found[4]), len(wanted) - 1)
        return tuple(x[wanted[there] == found[4]] for x in found)


def _repeated(rows: DataFrame) -> DataFrame:
    """``key``, ``n`` of grams that more than one spot has."""

    def run(batches):
        for chunk in _chunks(batches):
            key, n = np.unique(spots([row[2] for row in chunk])[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _with_spots(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with their spots of repeated grams, for more grams than are broadcast; by shuffles."""

    def run(batches):
        for chunk in _chunks(batches):
            text, at, size, gram, key = spots([row[2] for row in chunk])
            number = np.array([row[0] for row in chunk], np.int64)[text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, number, at, size.astype(np.int32), gram.astype(np.int32))], names=["key", "number", "at", "size", "gram"])

    found = written(rows.mapInArrow(run, "key long, number long, at long, size int, gram int"), "spots")
    kept = join_groups(found, repeated, ["key"], "n").groupBy("number").agg(F.collect_list(F.struct("at", "size", "gram", "key")).alias("own"))
    return rows.join(kept, "number", "left")


def _pieces(rows: DataFrame, known: _Spots) -> DataFrame:
    """``key``, ``piece``, ``low``, ``high`` (of the gram in it) and ``first`` (doc_id, number, at) of pieces of repeated grams."""

    def run(batches):
        for chunk in _chunks(batches):
            firsts: dict[bytes, tuple] = {}
            places = [(doc_id is not None, doc_id or 0, number) for number, doc_id, *_ in chunk]
            for text, at, size, gram, key in zip(*(x.tolist() for x in known.of(chunk))):
                piece = chunk[text][2][at : at + size + WIDTH - 1]
                before = firsts.get(piece)
                if before is None or (places[text], at) < before[:2]:
                    firsts[piece] = places[text], at, gram, key
            yield _piece_rows([(key, piece, gram, gram + GRAM, doc_id if there else None, number, at) for piece, ((there, doc_id, number), at, gram, key) in firsts.items()])

    return _first_of(rows.mapInArrow(run, PIECE))


PIECE = "key long, piece binary, low int, high int, doc_id long, number long, at long"
PIECE_KINDS = {"key": pa.int64(), "piece": pa.binary(), "low": pa.int32(), "high": pa.int32(), "doc_id": pa.int64(), "number": pa.int64(), "at": pa.int64()}


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(PIECE_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PIECE_KINDS.values())], names=list(PIECE_KINDS))


def _first_of(pieces: DataFrame) -> DataFrame:
    """Each piece of a gram once, where it stands first."""
    first = F.min(F.struct("doc_id", "number", "at")).alias("first")
    return pieces.groupBy("key", "piece").agg(first, F.min("low").alias("low"), F.min("high").alias("high")).select("key", "piece", "low", "high", "first.*")


def _split(pieces: DataFrame, most: int) -> DataFrame:
    """Pieces of grams that have too many of them under longer grams, until none has or the gram is the window."""
    while True:
        hot = pieces.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("high") - F.col("low")).alias("width")).where((F.col("n") > most) & (F.col("width") < WIDTH))
        hot = written(hot.select("key"), "hot_grams")
        if hot.isEmpty():
            return pieces
        # fewer than pieces / most
        rest = pieces.join(F.broadcast(hot), "key", "left_anti")
        finer = pieces.join(F.broadcast(hot), "key").select(*rest.columns).mapInArrow(_halved, PIECE)
        pieces = written(rest.unionByName(_first_of(finer)), "pieces")


def _halved(batches):
    for b in batches:
        out = []
        for row in b.to_pylist():
            piece, low, high = row["piece"], row["low"], row["high"]
            half = -(-(WIDTH - high + low) // 2)
            windows = len(piece) - WIDTH + 1
            left = max(0, min(windows, low - half + 1))  # so many windows hold the half before the gram
            for begin, end, side in ((0, left, -half), (left, windows, WIDTH - high + low - half + 1)):
                if begin < end:
                    a, z = (low + side, high) if side < 0 else (low, min(high + side, begin + WIDTH))
                    key = _key(piece[a:z])
                    out.append((key, piece[begin : end + WIDTH - 1], a - begin, z - begin, row["doc_id"], row["number"], row["at"] + begin))
        yield _piece_rows(out)


def _key(gram: bytes) -> int:
    h = len(gram)
    for byte in gram:
        h = (h * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 31
    return (h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _sorted_shard(batches):
    """``number``, ``at``, ``size`` of each piece of a shard and ``repeats``, begins and ends of the runs of its
    windows that stand earlier in another piece."""
    with Scratch() as scratch:
        parts = []
        for b in batches:
            if not b.num_rows:
                continue
            offsets = np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: b.num_rows + 1]
            data = scratch.column(int(offsets[-1] - offsets[0]), np.uint8)
            data[:] = np.frombuffer(b.column(1).buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            doc_id = b.column(4)
            rank = np.stack([np.asarray(doc_id.is_valid()), doc_id.fill_null(0).to_numpy(), b.column(5).to_numpy(), b.column(6).to_numpy()], 1).astype(np.int64)
            parts.append((data, np.diff(offsets).astype(np.int64), rank, b.column(0).to_numpy()))
        if not parts:
            return
        keys = np.concatenate([x[3] for x in parts])
        _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
        shared, texts, at = n[which] > 1, [], 0
        for data, lengths, _, key in parts:
            # the only piece of its gram shares no window: in one piece each has the gram elsewhere
            own = shared[at : at + len(key)]
            at += len(key)
            symbols = np.ones(int((lengths[own] + 1).sum()), np.uint16)  # 1 behind each piece
            here = np.ones(len(symbols), bool)
            here[np.cumsum(lengths[own] + 1) - 1] = False
            symbols[here] = data[np.repeat(own, lengths)].astype(np.uint16) + 2
            texts.append(scratch.column(len(symbols), np.uint16))
            texts[-1][:] = symbols
        lengths, ranks = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        parts = None
        yield from _runs(np.zeros(1, bool), np.zeros(int((~shared).sum()), np.int64), lengths[~shared], ranks[~shared])
        if not shared.any():
            return
        text = scratch.column(sum(map(len, texts)), np.uint16)
        np.concatenate(texts, out=text)
        texts, lengths, ranks = None, lengths[shared], ranks[shared]
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        marks = scratch.column(len(text) + 1, bool)
        carried, suffixes = None, order(text, WIDTH, scratch)
        text = None  # the order has its own copy
        for place, common in suffixes:
            carried = _mark(place, common >= WIDTH, starts, lengths, ranks, marks, carried)
        yield from _runs(marks, starts, lengths, ranks)


def _mark(place, same, starts, lengths, ranks, marks, carried):
    """Marks all windows of groups of equal ones but the first; the first one of a group that may go on is carried."""
    group = np.cumsum(~same)
    near = same.copy()
    near[:-1] |= same[1:]
    near[-1] = True
    at = np.flatnonzero(near)
    piece = np.searchsorted(starts, place[at], "right") - 1
    off = place[at] - starts[piece]
    own = off <= lengths[piece] - WIDTH
    at, piece, off = at[own], piece[own], off[own]
    rank = ranks[piece]
    rows = np.column_stack([group[at], rank[:, 0], rank[:, 1], rank[:, 2], rank[:, 3] + off, place[at]])
    if carried is not None and same[0]:
        rows = np.vstack([np.append(0, carried), rows])
    if not len(rows):
        return None
    rows = rows[np.lexsort(rows.T[-2::-1])]
    first = np.append(True, rows[1:, 0] != rows[:-1, 0])
    marks[rows[~first, -1]] = True
    last = rows[first][-1]
    return last[1:] if last[0] == group[-1] else None


def _runs(marks, starts, lengths, ranks):
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks])))
    begin, end = edges[::2], edges[1::2]
    piece = np.searchsorted(starts, begin, "right") - 1
    counts = np.bincount(piece, minlength=len(starts))
    flat = (np.stack([begin, end], 1) - starts[piece][:, None]).ravel().astype(np.int32)
    upto = np.append(0, np.cumsum(2 * counts)).astype(np.int32)
    for a in range(0, len(starts), 100_000):
        z = min(len(starts), a + 100_000)
        repeats = pa.ListArray.from_arrays(pa.array(upto[a : z + 1] - upto[a]), pa.array(flat[upto[a] : upto[z]]))
        yield pa.RecordBatch.from_arrays([pa.array(ranks[a:z, 2]), pa.array(ranks[a:z, 3]), pa.array((lengths[a:z] - WIDTH + 1).astype(np.int32)), repeats], names=["number", "at", "size", "repeats"])


def _without_repeats(chunk: list[tuple], own: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """What is left of the texts of a chunk and the removed spans: repeats are all windows of their spots, but for
    those of pieces that stand first here, of which the shard has told."""
    lengths = np.array([len(row[2]) for row in chunk], np.int64)
    base = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    data = np.frombuffer(b"".join(row[2] for row in chunk), np.uint8)
    steps = np.zeros(n + 1, np.int64)

    def add(begin: np.ndarray, end: np.ndarray, sign: int) -> None:
        nonlocal steps
        steps += sign * (np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))

    text, at, size = own[:3]
    add(base[text] + at, base[text] + at + size, 1)
    firsts = [row[-1].values if row[-1].is_valid else () for row in chunk]
    if told := [x for x in firsts if len(x)]:
        flat = pa.concat_arrays(told)
        begin = np.repeat(base, [len(x) for x in firsts]) + np.asarray(flat.field("at"))
        add(begin, begin + np.asarray(flat.field("size")), -1)
        runs = flat.field("repeats")
        bounds = np.asarray(runs.flatten(), np.int64).reshape(-1, 2) + np.repeat(begin, np.asarray(runs.value_lengths(), np.int64) // 2)[:, None]
        add(bounds[:, 0], bounds[:, 1], 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])))
    steps[:] = 0
    add(edges[::2], edges[1::2] + WIDTH - 1, 1)
    gone = np.cumsum(steps[:-1]) > 0
    # spans end with their texts
    first = np.zeros(n + 1, bool)
    first[base] = True
    before = np.append(False, gone[:-1]) if n else gone
    begin = np.flatnonzero(gone & (~before | first[:-1]))
    end = np.flatnonzero(gone & (~np.append(gone[1:], False) | first[1:])) + 1
    # a text without bytes has no place of its own, so spans belong to the last text that begins there
    of = np.searchsorted(base, begin, "right") - 1
    spans = np.stack([begin - base[of], end - base[of]], 1).ravel()
    upto = np.append(0, np.cumsum(2 * np.bincount(of, minlength=len(chunk)))).astype(np.int32)
    left = np.append(0, np.cumsum(~gone))
    offsets = np.append(left[base], left[n]).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gone].tobytes())])
    doc_ids = pa.array([row[1] for row in chunk], pa.int64())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(lengths), kept, pa.ListArray.from_arrays(upto, pa.array(spans))], names=["doc_id", "n_bytes", "kept", "spans"])


def remove_repeats(docs: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, most_of_gram: int = MOST_OF_GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row: ``doc_id``, ``n_bytes``, ``kept`` (bytes left), ``spans`` (begins and ends of removed bytes).

    Texts come in the order of doc_id, null first, rows of one doc_id as they stand in their files.  A null
    text counts as empty; texts under ``WIDTH`` bytes stay whole.  What is left may cut a character.  Repeated
    rows stay repeated, so the text of all but the first goes; an empty table gives an empty table; other
    columns are left out whatever their names.  Texts of any length are taken whole; a task holds one text,
    or few bytes of short ones, and the blocks of a shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    located = numbered(docs.select("doc_id", "text"))
    rows = located.select("number", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text")).withColumn("text", text)
    repeated = written(_repeated(rows), "repeated_grams")
    if repeated.count() <= broadcast_grams:
        keys = np.sort(repeated.select("key").toArrow().column(0).to_numpy())
        known = _Spots(spark.sparkContext.broadcast(keys))
    else:
        known, rows = _Spots(None), _with_spots(rows, repeated)
    pieces = _split(written(_pieces(rows, known), "pieces"), most_of_gram)
    size = pieces.agg(F.sum(F.length("piece"))).head()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    told = pieces.repartition(int(shards), "key").mapInArrow(_sorted_shard, "number long, at long, size int, repeats array<int>")
    told = told.groupBy("number").agg(F.collect_list(F.struct("at", "size", "repeats")).alias("firsts"))
    out = written(told, "told")

    def run(batches):
        for chunk in _chunks(batches):
            yield _without_repeats(chunk, known.of(chunk))

    names = ["number", "doc_id", "text", *(["own"] if known.grams is None else []), "firsts"]
    return rows.join(out, "number", "left").select(*names).mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<long>")


def digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``: what ``remove_repeats`` leaves, in short."""
    rows = remove_repeats(docs, **options)
    removed = F.col("n_bytes") - F.length("kept")
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.expr("size(spans) div 2").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
