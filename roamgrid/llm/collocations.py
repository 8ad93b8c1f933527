"""Collocations: frequent phrases of each language, mined by pivot partitioning.

A phrase's pivot is its rarest word.  Words are numbered from the most frequent of a language on, so the
pivot has a phrase's largest number.  For every place of a text the fragment around it is rewritten for the
word there: words that are rarer than it, or too rare for any phrase, end the fragment, and so does a place
further away than the longest phrase reaches.  The fragment goes to the place of its pivot, where its phrases
are counted and those with that pivot are kept; a phrase is met nowhere else.  Of a pivot that occurs twice in
a phrase the first place owns it.

Fragments of a pivot with many occurrences are dealt out by their hash into parts; the counts of such
pivots are added up afterwards, those of all others are final where they are made.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.llm.rows import numbered
from roamgrid.plans.storage import shuffle_width, written

LONGEST, LEAST_COUNT, MOST_OF_LANGUAGE = 4, 30, 2_000
#: A phrase goes if a longer one that holds it has so many hundredths of its occurrences.
CLOSED_PERCENT = 80
SCALE = 2_000_000
#: Frequent words up to this number are broadcast; beyond it each text is given the numbers of its own words.
BROADCAST_WORDS = 500_000
#: Phrases up to this number are broadcast where counts are looked up.
BROADCAST_PHRASES = 100_000
#: Occurrences of a pivot in one task at most, and parts for each shuffle partition.
MOST_OF_PIVOT, PARTS = 2_000_000, 10
#: Words, distinct counted words and fragments that a task holds at once.
CHUNK_WORDS, CHUNK_COUNTS, CHUNK_FRAGMENTS = 1_000_000, 200_000, 400_000

# What separates pieces, as one byte.
SEPARATE = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
REACH = LONGEST - 1


def pieces_of(text: bytes) -> list[list[bytes]]:
    """Words of each piece of a text in UTF-8, A-Z in lower case; all separators and blanks are ASCII."""
    return [piece.split() for piece in text.lower().translate(SEPARATE).split(b"\n")]


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``f``: occurrences of every word of every language, counted in tasks first."""

    def run(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(*b.columns):
                own = counts.setdefault(lang.as_py(), Counter())
                own.update(text.as_buffer().to_pybytes().lower().translate(SEPARATE).split())
                if len(own) > CHUNK_COUNTS:
                    yield _counted(counts)
                    counts = {}
        yield _counted(counts)

    return _texts(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs, words, n = [], [], []
    for lang, own in counts.items():
        langs += [lang] * len(own)
        words += own.keys()
        n += own.values()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "f"])


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"), *more)


def _numbered_words(counts: DataFrame, least: int, unit: int) -> DataFrame:
    """``id``, ``lang``, ``word``, ``f``, ``parts`` of frequent words; ids rise with rarity inside a language.

    Rows are sorted across partitions; a partition's first id follows from the sizes of those before it.
    """
    placed = counts.where(F.col("f") >= least).orderBy("lang", F.desc("f"), "word").withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "frequent_words")
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    first, starts = 1, []
    for r in sizes:
        starts.append((r.part, first))
        first += r.n
    starts = placed.sparkSession.createDataFrame(starts, "part long, start long")
    rows = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(starts), "part")
    number = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(number.alias("id"), "lang", "word", "f", F.ceil(F.col("f") / unit).cast("long").alias("parts"))


def fragments(docs: DataFrame, words: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``pivot``, ``part``, ``fragment``, ``n``: rewritten fragments that hold a phrase, equal ones of a chunk once.

    A fragment is seven 32-bit numbers: up to three words before the pivot, it, and up to three behind it.
    """
    if words.count() <= broadcast_words:
        known: dict = {}
        columns = words.select("lang", "word", "id", "parts").toArrow().to_pydict()
        for lang, word, number in zip(columns["lang"], columns["word"], columns["id"]):
            known.setdefault(lang, {})[word.encode()] = number
        shared = docs.sparkSession.sparkContext.broadcast((known, {i: p for i, p in zip(columns["id"], columns["parts"]) if p > 1}))
        rows = _texts(docs).withColumn("known", F.lit(None).cast("array<struct<word:binary,id:long,parts:long>>"))
    else:
        shared = None
        rows = _with_own_words(docs, words)

    def run(batches):
        chunk, hot = [], dict(shared.value[1]) if shared else {}
        for b in batches:
            for lang, text, own in zip(*b.columns):
                if shared:
                    number_of = shared.value[0].get(lang.as_py(), {}).get
                else:
                    own = own.as_py() or []
                    hot.update((x["id"], x["parts"]) for x in own if x["parts"] > 1)
                    number_of = {x["word"]: x["id"] for x in own}.get
                for piece in pieces_of(text.as_buffer().to_pybytes()):
                    if len(piece) > 1:
                        chunk.extend(map(number_of, piece, repeat(0)))
                        chunk.append(0)
                    if len(chunk) >= CHUNK_WORDS:
                        yield _rewritten(chunk, hot)  # between two pieces
                        chunk = []
        yield _rewritten(chunk, hot)

    return rows.mapInArrow(run, "pivot long, part long, fragment binary, n long")


def _with_own_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Texts with the numbers of their frequent words, for more words than are broadcast; joined by shuffles."""
    rows = written(_texts(numbered(docs.select("lang", "text")).select("row.*", "number"), "number"), "texts")

    def run(batches):
        for b in batches:
            for lang, text, number in zip(*b.columns):
                found = sorted(set(text.as_buffer().to_pybytes().lower().translate(SEPARATE).split()))
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(found), pa.int64()), pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string())], names=["number", "lang", "word"])

    own = rows.mapInArrow(run, "number long, lang string, word string").join(words, ["lang", "word"])
    own = own.groupBy("number").agg(F.collect_list(F.struct(F.col("word").cast("binary").alias("word"), "id", "parts")).alias("known"))
    return rows.join(own, "number", "left").select("lang", "text", "known")


def _rewritten(chunk: list[int], hot: dict[int, int]) -> pa.RecordBatch:
    """Fragments of a chunk of word numbers, 0 for words that end a fragment."""
    ids = np.zeros(len(chunk) + 2 * REACH, np.uint32)
    ids[REACH : REACH + len(chunk)] = chunk
    at = slice(REACH, REACH + len(chunk))
    pivot, columns = ids[at], [None] * (2 * REACH + 1)
    columns[REACH] = pivot
    for side in (-1, 1):
        open_ = pivot > 0
        for far in range(1, REACH + 1):
            word = ids[REACH + side * far : REACH + side * far + len(chunk)]
            open_ = open_ & (word > 0) & ((word < pivot) if side < 0 else (word <= pivot))
            columns[REACH + side * far] = np.where(open_, word, 0)
    held = (columns[REACH - 1] > 0) | (columns[REACH + 1] > 0)
    rows = np.empty((int(held.sum()), len(columns)), np.uint32)
    for k in range(len(columns)):
        rows[:, k], columns[k] = columns[k][held], None
    order, first, hashes = _grouped(rows)
    n = np.diff(np.append(first, len(rows)))
    rows, hashes = rows[order[first]], hashes[order[first]]
    pivot = rows[:, REACH].astype(np.int64)
    parts = np.ones(len(rows), np.uint64)
    if hot:
        names = np.array(sorted(hot), np.int64)
        counts = np.array([hot[i] for i in names.tolist()], np.uint64)
        there = np.minimum(np.searchsorted(names, pivot), len(names) - 1)
        parts = np.where(names[there] == pivot, counts[there], parts)
    # cold pivots have part -1: their counts are final where they are made
    part = np.where(parts > 1, ((hashes >> np.uint64(20)) % parts).astype(np.int64), -1)
    data = np.ascontiguousarray(rows.astype("<u4"))
    width = data.shape[1] * 4
    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(part), packed, pa.array(n.astype(np.int64))], names=["pivot", "part", "fragment", "n"])


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal rows together, where each group of equal rows begins in it, and the rows' hashes."""
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    differ = _changes(rows, order)
    if (differ & (h[order[1:]] == h[order[:-1]])).any():  # different rows of one hash: sorted by themselves
        order = np.lexsort(rows.T)
        differ = _changes(rows, order)
    return order, np.flatnonzero(np.append(True, differ)[: len(rows)]), h


def _changes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in an order; one column at a time is copied."""
    differ = np.zeros(max(0, len(rows) - 1), bool)
    for column in rows.T:
        column = column[order]
        differ |= column[1:] != column[:-1]
    return differ


def phrase_counts(found: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``gram`` (numbers of 2 to 4 words) and ``f`` of the phrases with ``least`` occurrences.

    All fragments of a pivot, or of one part of a hot one, meet in a task, sorted, and are mined there.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(-1, 2 * REACH + 1), b.column(3).to_numpy()))
            size += b.num_rows
            if size >= CHUNK_FRAGMENTS:
                pivot, part, rows, n = (np.concatenate(x) for x in zip(*held))
                # the last group may go on
                open_ = (pivot == pivot[-1]) & (part == part[-1])
                if not open_.all():
                    yield _mined(rows[~open_], n[~open_], part[~open_], least)
                held = [tuple(x[open_] for x in (pivot, part, rows, n))]
                size = int(open_.sum())
        if held:
            pivot, part, rows, n = (np.concatenate(x) for x in zip(*held))
            yield _mined(rows, n, part, least)

    together = found.repartition("pivot", "part").sortWithinPartitions("pivot", "part")
    mined = together.mapInArrow(run, "gram array<long>, f long")
    return mined.groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _mined(rows: np.ndarray, n: np.ndarray, part: np.ndarray, least: int) -> pa.RecordBatch:
    """Phrases with their fragments' pivot and their counts; rare ones of pivots that are whole here go."""
    spans = [(size, start) for size in range(2, LONGEST + 1) for start in range(REACH + 1 - size, REACH + 1)]
    held = [np.flatnonzero((rows[:, start : start + size] > 0).all(1)).astype(np.int32) for size, start in spans]
    # a phrase has the numbers of its words, 32 bits each as in a fragment
    grams, at = np.zeros((sum(map(len, held)), LONGEST), np.uint32), 0
    for (size, start), there in zip(spans, held):
        grams[at : at + len(there), :size] = rows[there, start : start + size]
        at += len(there)
    there = np.concatenate(held)
    del held
    counts, final = n[there], part[there] < 0
    order, first, _ = _grouped(grams)
    totals = np.add.reduceat(counts[order], first) if len(order) else counts
    grams, final = grams[order[first]], final[order[first]]
    keep = ~final | (totals >= least)
    grams, totals = grams[keep], totals[keep]
    sizes = (grams > 0).sum(1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(grams[grams > 0].astype(np.int64))), pa.array(totals.astype(np.int64))], names=["gram", "f"])


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most: int = MOST_OF_LANGUAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    Phrases of 2 to 4 words with ``least`` occurrences are cut into two parts; the lowest score, twice a
    million times a by the parts' occurrences, counts, that of the shortest first part on ties.  Phrases that
    a longer one nearly always holds are left out.  Null texts count as empty, a null language is ``und``.
    Repeated rows count each; other columns are left out whatever their names; an empty table, or one without
    frequent phrases, gives an empty table.  Products are decimals of up to 38 digits.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    counts = written(word_counts(docs), "word_counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    all_words = counts.agg(F.sum("f")).head()[0] or 0
    unit = max(1_000, min(MOST_OF_PIVOT, all_words // (PARTS * shuffle_width(spark))))
    words = written(_numbered_words(counts, least, unit), "words")
    phrases = written(phrase_counts(fragments(docs, words, broadcast_words), least), "phrases")

    n_phrases = phrases.count()
    small = (lambda df: F.broadcast(df)) if n_phrases + words.count() <= BROADCAST_PHRASES else (lambda df: df)
    parts = phrases.unionByName(words.select(F.array("id").alias("gram"), "f"))
    # both parts of every cut, each looked up by the part itself
    cut = phrases.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cut = cut.withColumn("left", F.slice("gram", F.lit(1), F.col("k"))).withColumn("right", F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")))
    cut = cut.join(small(parts.select(F.col("gram").alias("left"), F.col("f").alias("l"))), "left").join(small(parts.select(F.col("gram").alias("right"), F.col("f").alias("r"))), "right")
    product, total = F.col("a").cast("decimal(20,0)") * F.lit(SCALE), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    scored = cut.withColumns({"product": product, "total": total}).withColumn("score", F.expr("product div total"))
    best = scored.groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("gram", "a", "m.l", "m.r", "m.score")

    # phrases inside a longer one, with the most occurrences of such
    sizes = F.filter(F.sequence(F.lit(2), F.size("gram") - 1), lambda s: s < F.size("gram"))
    inner = phrases.where(F.size("gram") > 2).select("gram", "f", F.explode(sizes).alias("size"))
    inner = inner.select("f", F.explode(F.transform(F.sequence(F.lit(1), F.size("gram") - F.col("size") + 1), lambda i: F.slice("gram", i, F.col("size")))).alias("gram"))
    longer = inner.groupBy("gram").agg(F.max("f").alias("longer"))
    closed = best.join(longer, "gram", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * CLOSED_PERCENT)).drop("longer")

    named = closed.select("gram", F.posexplode("gram").alias("at", "id")).join(small(words.select("id", "lang", "word")), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy("gram").agg(F.first("lang").alias("lang"), text.alias("phrase"))
    rows = written(closed.join(named, "gram").drop("gram"), "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each of some parts of a language, then the best of these
    cells = max(1, math.isqrt(rows.count() // most))
    inside = Window.partitionBy("lang", "cell").orderBy(*order)
    few = rows.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(cells))).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= most).drop("cell", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
