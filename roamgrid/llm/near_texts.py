"""Groups of texts whose word shingles have at least a given Jaccard similarity, exactly.

Candidates come from SimHash fingerprints of the same shingles first, by op6's vantage-point tree: texts that
follow one another among those of linked fingerprints.  Fingerprints of 64 bits can't give all links, though:
texts of similarity 0.8 were found up to 17 bits apart, and at such a reach no tree over Hamming distances
excludes anything.  What the tree leaves unlinked comes from prefixes: under any one order of all shingles, two
sets of similarity ``s`` share one of their first ``n - ceil(s * n) + 1`` shingles, and more the larger they are.

1. Every text becomes the hashes of its distinct shingles; of these only the prefix leaves the task.
   Shingles that are frequent in a sample come last in the order, the others go by hash.  The sample
   only makes lists short, it doesn't change what is found.
2. A prefix shingle's list is its texts.  In long lists neighbours in one order of all texts are
   tried first, those that are neighbours in enough lists; so large groups of copies are joined by
   about one pair for each text, and their lists have nothing left to compare.
3. Of texts that share a list and aren't in one group yet, those are compared whose first common shingle
   stands early enough in both for the rest to be similar.  Lists of the same texts, as copies have many, are one.
4. A sample can't tell how frequent most shingles are, so lists may still be long, and texts of one base that aren't
   similar meet in many.  So pairs aren't rows: a list comes to a task, a very long one to several in parts, with
   each text's parities: a bit for each set of shingles with one remainder, telling whether a text has an odd number
   of them.  Two texts differ in no more bits than shingles, so no link is lost; a pair leaves the task if its bits
   allow for a link, which few do but links.
5. Every link is verified on the two whole texts.  Components over the links are the groups.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.llm import simhash
from roamgrid.llm.components import FEW_EDGES, connected_components
from roamgrid.llm.rows import join_groups, numbered, semi_join
from roamgrid.plans.storage import settings, shuffle_width, written

WORDS = 5
#: Least similarity in fifths: 4 stands for 0.8.
FIFTHS = 4
#: Bits in which fingerprints that the tree links differ, at most.
REACH = 2
#: Texts whose shingles are counted for the order, at most, and the texts of these that make one frequent.
SAMPLE, FREQUENT = 8_000, 3
#: Texts in a list from which neighbours in it are tried first, and how often, in another order each time.
LONG_LIST, ROUNDS = 6, 2
#: Texts of a list that a task compares with each other, or with as many others of it.
CROWDED = 1_024
#: Texts compared with all of a task's list at a time, bytes of parities compared at a time and pairs given at a time.
BLOCK, BLOCK_BYTES, GIVEN = 256, 1 << 22, 10_000
#: Texts that a Python worker holds at a time.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "200"}


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; of a shorter text the whole is one."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    found = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), np.uint64, len(found)))


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that several texts of a sample have."""
    some = texts.select("number").orderBy(F.xxhash64("number"), "number").limit(SAMPLE)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, words) for t in b.column(0).to_pylist()] + [np.zeros(0, np.uint64)]).view(np.int64))], names=["token"])

    counted = texts.join(F.broadcast(some), "number", "left_semi").select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("times"))
    counted = counted.where(F.col("times") >= FREQUENT).toArrow()
    tokens, times = counted.column(0).to_numpy().view(np.uint64), counted.column(1).to_numpy()
    order = np.argsort(tokens)
    return np.append(tokens[order], np.uint64(2**64 - 1)), np.append(times[order], 0)


def prefixes(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``token``, ``number``, ``n`` and ``place`` in the order for each shingle of each text's prefix; one row
    without a token for a text without words."""
    there = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, words))

    def run(batches):
        frequent, times = there.value
        for b in batches:
            tokens, at, sizes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            wordless = []
            for i, text in enumerate(b.column(1)):  # one text at a time is a Python string
                s = shingles(text.as_py(), words)
                n = len(s)
                if not n:
                    wordless.append(i)
                    continue
                k = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                first = n - -(-FIFTHS * n // 5) + 1
                tokens.append(s[np.argsort(np.where(frequent[k] == s, times[k], 0), kind="stable")[:first]])
                at.append(np.full(first, i))
                sizes.append(np.full(first, n, np.int32))
                places.append(np.arange(first, dtype=np.int32))
            token = pa.array(np.concatenate([*tokens, np.zeros(len(wordless), np.uint64)]).view(np.int64), mask=np.repeat([False, True], [sum(map(len, tokens)), len(wordless)]))
            none = np.zeros(len(wordless), np.int32)
            columns = [token, b.column(0).take(pa.array(np.concatenate([*at, np.array(wordless, np.int64)]))), *(pa.array(np.concatenate([*x, none])) for x in (sizes, places))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "number", "n", "place"])

    return texts.select("number", "text").mapInArrow(run, "token long, number long, n int, place int")


def _like_size(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= FIFTHS * F.greatest(a, b)


def _enough(common: Column, n: Column, m: Column) -> Column:
    """Whether sets with ``common`` shingles in both prefixes can be similar: beyond the prefix that ends
    first in the order, one of them has ``ceil(s * n) - 1`` shingles at most."""
    rest = F.floor((FIFTHS * F.greatest(n, m) + 4) / 5) - 1
    return (5 + FIFTHS) * (common + rest) >= FIFTHS * (n + m)


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs ``a``, ``b`` of numbers whose whole texts are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    some = written(semi_join(texts.select("number", "text"), written(needed, "needed_texts"), ["number"]), "compared_texts")
    both = pairs.join(some.withColumnsRenamed({"number": "a", "text": "of_a"}), "a").join(some.withColumnsRenamed({"number": "b", "text": "of_b"}), "b")

    def run(batches):
        for b in batches:
            alike = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = shingles(s.as_py(), words), shingles(t.as_py(), words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append((5 + FIFTHS) * common >= FIFTHS * (len(x) + len(y)))
            yield b.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def parities(s: np.ndarray) -> bytes:
    """Bits of a set of hashes, two to four for each: whether an odd number of hashes has this remainder."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes the sets of two rows of parities, in words, have not in common, at least; the longer rows are folded."""
    x, y = sorted((x, y), key=lambda v: v.shape[1])
    return np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(len(y), -1, x.shape[1]), axis=1)).sum(axis=1, dtype=np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """``least_differences`` of two texts."""
    return int(least_differences(*(np.frombuffer(v, np.uint64)[None] for v in (a, b)))[0])


def with_parities(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``number`` and ``bits``, its parities, of each text."""

    def run(batches):
        for b in batches:
            found = [parities(shingles(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["number", "bits"])

    return texts.select("number", "text").mapInArrow(run, "number long, bits binary")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "number", "left").withColumn("root", F.coalesce("root", "number"))


def _open_lists(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with each text's ``root`` by the links so far, without the lists of one root."""
    of_token = Window.partitionBy("token")
    rows = _with_roots(shared, connected_components(links, FEW_EDGES).withColumnRenamed("node", "number"))
    rows = rows.withColumn("low", F.min("root").over(of_token)).withColumn("high", F.max("root").over(of_token))
    return rows.where("low <> high").drop("low", "high")


def distinct_lists(rows: DataFrame) -> DataFrame:
    """The rows of one list of all those that hold the same texts, with the first ``place`` of these lists in each
    text and how many texts they hold (``many``).

    Lists are told apart by two hashes of their texts, as shingles are by one.
    """
    marks = [F.bit_xor(F.xxhash64("number", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    lists = rows.groupBy("token").agg(F.count("*").alias("many"), *marks)
    of_text = rows.drop("many").join(lists, "token").groupBy("many", "mark_1", "mark_2", "number", "n", "root")
    return written(of_text.agg(F.min("token").alias("token"), F.min("place").alias("place")).drop("mark_1", "mark_2"), "distinct_lists")


def _promising(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which of the pairs of places ``x``, ``y`` have parities that allow for a link."""
    sizes, fits = np.array([len(v) for v in bits]), np.zeros(len(x), bool)
    rows = {k: np.frombuffer(b"".join(v for v in bits if len(v) == k), np.uint64).reshape(-1, k // 8) for k in set(sizes.tolist())}
    at = np.zeros(len(bits), np.int64)
    for k in rows:
        at[sizes == k] = np.arange(len(rows[k]))
    for k in rows:
        for m in rows:
            pairs = np.flatnonzero((sizes[x] == k) & (sizes[y] == m))
            step = max(1, BLOCK_BYTES // max(k, m))
            for some in (pairs[i : i + step] for i in range(0, len(pairs), step)):
                apart = least_differences(rows[k][at[x[some]]], rows[m][at[y[some]]])
                fits[some] = (5 + FIFTHS) * apart <= (5 - FIFTHS) * (n[x[some]] + n[y[some]])
    return fits


def _pairs_of_list(rows: pa.Table) -> np.ndarray:
    """Pairs of numbers, the smaller first, of one list or of two parts of it: of different roots, similar if no shingle
    before the list's is common and if parities differ so little."""
    number, n, place, root, part = (rows.column(c).to_numpy().astype(np.int64) for c in ("number", "n", "place", "root", "part"))
    bits, found = rows.column("bits").to_pylist(), []
    whole, most = rows.column("low")[0] == rows.column("high")[0], (5 + FIFTHS) * (n - place)
    for i in range(0, len(number), BLOCK):
        own = slice(i, i + BLOCK)
        need = FIFTHS * (n[own, None] + n)
        meet = (number[own, None] < number) & (root[own, None] != root) & (most[own, None] >= need) & (most >= need)
        if not whole:
            meet &= part[own, None] != part
        x, y = np.nonzero(meet)
        if len(x):
            fits = _promising(x + i, y, n, bits)
            found.append(np.stack([number[x[fits] + i], number[y[fits]]], axis=1))
    return np.concatenate([np.zeros((0, 2), np.int64), *found])


def _pairs_of_lists(batches):
    """``a``, ``b`` of rows in order of (token, low, high)."""
    key, rows, found = None, [], []

    def given(pairs):
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        token, low, high = (batch.column(c).to_numpy() for c in ("token", "low", "high"))
        ends = np.flatnonzero((np.diff(token) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        for i, j in zip([0, *ends], [*ends, batch.num_rows]):
            if i == j:
                continue
            if rows and key != (token[i], low[i], high[i]):
                found.append(_pairs_of_list(pa.Table.from_batches(rows)))
                rows = []
            key = (token[i], low[i], high[i])
            rows.append(batch.slice(i, j - i))
        if sum(map(len, found)) >= GIVEN:
            yield given(found)
            found = []
    if rows:
        found.append(_pairs_of_list(pa.Table.from_batches(rows)))
    yield given(found)


def left_pairs(rows: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``a``, ``b``: texts of open lists and different roots that may be similar; all that are, are among them.

    A list is dealt by parts of ``CROWDED`` texts or so, each two of which meet in a task; most have one part.
    """
    lists = distinct_lists(rows)
    bits = with_parities(semi_join(texts, written(lists.select("number").distinct(), "listed_texts"), ["number"]), words)
    parts = F.ceil(F.col("many") / CROWDED).cast("int")
    one = lists.where(F.col("many") <= CROWDED).withColumns({c: F.lit(0) for c in ("part", "low", "high")})
    several = lists.where(F.col("many") > CROWDED).withColumn("part", F.pmod(F.xxhash64("number"), parts).cast("int"))
    several = several.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    several = several.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other")
    dealt = one.unionByName(several).drop("many").join(written(bits, "parities"), "number")
    dealt = dealt.repartition(shuffle_width(rows.sparkSession), "token", "low", "high").sortWithinPartitions("token", "low", "high", "number")
    return written(dealt.mapInArrow(_pairs_of_lists, "a long, b long").distinct(), "left_pairs")


def tree_pairs(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``a``, ``b``: neighbours among the texts whose fingerprints the tree puts into one component.

    They stand in one order of component, fingerprint and number, dealt by ranges, so a text is in few pairs, however
    many are alike: one with its neighbour on either side, and the two ends of a range with each other.  They aren't verified.
    """
    spark = texts.sparkSession
    fps = written(simhash.fingerprints(texts.select(F.col("number").alias("doc_id"), "text"), words).withColumnRenamed("doc_id", "number"), "text_fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.count("*").alias("n")), "distinct_text_fingerprints")
    roots = connected_components(simhash.links(distinct, REACH), FEW_EDGES).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp"))
    rows = join_groups(fps, written(named, "fingerprint_groups"), ["fp"], "n").select("root", "fp", "number")
    rows = rows.repartitionByRange(shuffle_width(spark), "root", "fp", "number").sortWithinPartitions("root", "fp", "number")
    found = written(rows.mapInArrow(_neighbours, "root long, fp long, a long, b long"), "tree_pairs")
    onward = Window.partitionBy("root").orderBy("fp", "a")
    ends = found.where("b IS NULL").select("a", F.lead("a").over(onward).alias("b")).where("a <> b")  # two for each range at most
    return found.where("b IS NOT NULL").select("a", "b").unionByName(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _neighbours(batches):
    """Pairs of rows that follow one another and have one root; the first and the last row are paired with null."""
    roots, fps, numbers = (np.zeros(0, np.int64) for _ in range(3))

    def given(root, fp, a, b, there=True):
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(fp), pa.array(a), pa.array(b, mask=np.full(len(b), not there))], names=["root", "fp", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = not len(numbers)
        roots, fps, numbers = (np.append(x[-1:], c.to_numpy(zero_copy_only=False)) for x, c in zip((roots, fps, numbers), batch.columns))
        if begins:
            yield given(roots[:1], fps[:1], numbers[:1], numbers[:1], False)
        like = roots[1:] == roots[:-1]
        yield given(roots[1:][like], fps[1:][like], np.minimum(numbers[1:], numbers[:-1])[like], np.maximum(numbers[1:], numbers[:-1])[like])
    if len(numbers):
        yield given(roots[-1:], fps[-1:], numbers[-1:], numbers[-1:], False)


def tree_links(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The verified of the pairs that the tree gives."""
    return written(verified(written(tree_pairs(texts, words), "tree_candidates"), texts, words), "links")


def links(shared: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``(a, b)``: verified pairs that span each group: those of the tree, then, for texts that it leaves
    apart, those from the lists of shared prefix shingles."""
    found = tree_links(texts, words)
    for k in range(ROUNDS):
        rows = _open_lists(shared, found).where(F.col("many") >= LONG_LIST)
        after = Window.partitionBy("token").orderBy(F.xxhash64("number", F.lit(k)), "number")
        pairs = rows.select(*(F.col(c).alias("a" + c) for c in ("number", "n", "root")), *(F.lead(c).over(after).alias("b" + c) for c in ("number", "n", "root")))
        pairs = pairs.where((F.col("aroot") != F.col("broot")) & _like_size(F.col("an"), F.col("bn")))
        pairs = pairs.groupBy(F.least("anumber", "bnumber").alias("a"), F.greatest("anumber", "bnumber").alias("b")).agg(F.count("*").alias("common"), F.max("an").alias("n"), F.max("bn").alias("m"))
        # neighbours in half of the lists that they need in common
        pairs = written(pairs.where(_enough(2 * F.col("common"), F.col("n"), F.col("m"))).select("a", "b"), "neighbours")
        new = verified(pairs, texts, words)
        found = written(found.unionByName(new), "links")
    rows = written(_open_lists(shared, found), "open_lists")
    return found.unionByName(verified(left_pairs(rows, texts, words), texts, words))


def similar(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``number`` and ``root``, the smallest number of its group, of each text of a group of several.

    ``texts``: ``number``, without repeats, and ``text``.  Linked are texts whose sets of word
    shingles, in lower case of ASCII, have a Jaccard similarity of 0.8 or more; texts without words,
    null ones included, are linked with each other.
    """
    # a text without words is a list of its own, so that no task meets all of these
    alone = F.when(F.col("token").isNull(), F.col("number"))
    many = F.when(F.col("token").isNotNull(), F.count("*").over(Window.partitionBy("token", alone))).otherwise(0)
    with settings(texts.sparkSession, **SMALL_BATCHES):
        shared = written(prefixes(texts, words).withColumn("many", many).where("many <> 1"), "shared_prefixes")
        worded = semi_join(texts, shared.where("token IS NULL").select("number"), ["number"], "left_anti")
        found = written(links(shared.where("token IS NOT NULL"), worded, words), "all_links")
    wordless = shared.where("token IS NULL").select("number")
    least = wordless.agg(F.min("number")).head()[0]
    groups = connected_components(found, FEW_EDGES).withColumnRenamed("node", "number")
    return groups.unionByName(wordless.withColumn("root", F.lit(least).cast("long")))


def drop_similar(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of similar texts only one row.

    Of a group the row with the smallest doc_id stays (a null one last), then the one that stands
    first.  Repeated rows, and rows of one doc_id with different texts, are told apart by where they
    stand.  An empty table gives an empty table.
    """
    rows = numbered(docs)
    texts = rows.select("number", F.col("row.text").cast("string").alias("text"))
    groups = written(similar(texts, words), "similar")
    named = semi_join(rows.select("number", F.col("row.doc_id").alias("doc_id")), groups.select("number"), ["number"]).join(groups, "number")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("first"))
    gone = groups.join(written(first.select(F.col("first.number").alias("number")), "kept_of_groups"), "number", "left_anti").select("number")
    return semi_join(rows, written(gone, "similar_gone"), ["number"], "left_anti").select("row.*")


def similar_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest doc_id of its group, for each row of ``docs``."""
    rows = numbered(docs).select("number", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    named = rows.select("number", "doc_id").join(similar(rows, words), "number", "left").withColumn("root", F.coalesce("root", "number"))
    groups = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(groups, "root").select("doc_id", "component_id")
