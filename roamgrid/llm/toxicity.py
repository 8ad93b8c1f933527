"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on windows of ordinary and of toxic texts.  A window is a
word between blanks; it is compressed with each dictionary, and the bytes that a toxic one saves beside
the ordinary one are its gain.  Each window ends in a constant that all dictionaries know, so that none
is too short for zstandard to compress.

Most windows of a toxic text are ordinary words.  So a toxic dictionary is trained twice over: a first
one on all windows of some toxic texts tells which windows of other toxic texts it compresses better
than the ordinary dictionary does; the last one is trained on those of these windows that recur, and
more often than in ordinary texts.

There is a toxic dictionary for each fold, trained on the other folds' toxic texts.  On the fold itself,
and on ordinary texts that no dictionary was trained on, a text's largest gains and its gains beyond a
window threshold are calibrated to a probability by logistic regression; the window threshold is the one
of a few under which these texts are most likely.  A text's score is the mean over the folds.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.llm.rows import fitted

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of doc_id.
LABELLED_ROWS = 9_000
#: Ordinary texts among them that a dictionary is trained on, at most, and half of them; the others calibrate.
ORDINARY_TEXTS = 3_000
#: Longest window; longer words are cut.
WINDOW_BYTES = 64
#: Sizes of the ordinary, the first toxic and the last toxic dictionary, and the trainer's segment
#: sizes for the first two and for the last; words to a training sample.
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES = 16_384, 16_384, 1_024
SEGMENT, LAST_SEGMENT, MATCH, SAMPLE_WORDS = 16, 24, 8, 4
#: Times that windows are chosen by dictionaries of other toxic texts, the gain for it, the share of the
#: toxic texts in which it must show, and how many times the ordinary texts' share that must be.
ROUNDS, CHOSEN_GAIN, RECURS, OFTENER = 2, 2, 0.01, 3
#: What ends every window and both dictionaries; of it a frame holds one reference.
TAIL = b" 0123456789abcdef0123456789"
FOLDS = 3
#: Window thresholds, in bytes of gain, among which calibration chooses.
WINDOW_THRESHOLDS = (1, 2, 3, 4)
#: Windows of which a worker keeps the gain.
CACHED_WINDOWS = 150_000
#: Rows that a filtering task turns into Python's strings at a time.
ROWS = 500
THRESHOLD = 0.3

#: Marks count as blanks, and capitals of ASCII as small letters.
_PLAIN = bytes.maketrans(b".,;:!?|*#$%&\"'()[]{}<>=+~^_/\\ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 29 + b"abcdefghijklmnopqrstuvwxyz")


def windows(text: bytes) -> list[bytes]:
    """The words of the whole text, long ones in pieces."""
    words = text.translate(_PLAIN).split()
    if len(text) > WINDOW_BYTES and max(map(len, words), default=0) > WINDOW_BYTES:
        words = [w[i : i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]
    return words


def _trained(words: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary that zstandard trains on samples of a few windows; of too few samples, their end itself."""
    samples = [b"  " + b"  ".join(words[i : i + SAMPLE_WORDS]) + b"  " for i in range(0, len(words), SAMPLE_WORDS)]
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=MATCH).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(content: bytes):
    """Compresses with a dictionary; short matches are sought, and frames hold nothing but the content.

    The dictionary's content is used without its tables of literals, so that two lengths differ by
    what is known of the window alone.
    """
    parameters = zstd.ZstdCompressionParameters.from_level(
        9, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, strategy=zstd.STRATEGY_LAZY2, window_log=20, format=zstd.FORMAT_ZSTD1_MAGICLESS
    )
    trained = zstd.ZstdCompressionDict(content + TAIL, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    return zstd.ZstdCompressor(dict_data=trained, compression_params=parameters).compress


class _Gains(dict):
    """Bytes that each toxic dictionary saves on a window."""

    def __init__(self, ordinary: bytes, *toxic: bytes):
        super().__init__()
        self.ordinary, self.toxic = _compressor(ordinary), [_compressor(t) for t in toxic]

    def __missing__(self, window: bytes) -> tuple[int, ...]:
        padded = b"  " + window + b"  " + TAIL
        n = len(self.ordinary(padded))
        self[window] = gains = tuple(n - len(t(padded)) for t in self.toxic)
        return gains

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row of gains for each window."""
        if len(self) > CACHED_WINDOWS:
            self.clear()
        return np.array(list(map(self.__getitem__, words)), np.int16).reshape(-1, len(self.toxic))


def train(base: bytes, ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> bytes:
    """A toxic dictionary from the windows of toxic texts, beside the ordinary one and its texts."""
    parts = [toxic[i::FOLDS] for i in range(FOLDS)]
    chosen = parts
    for k in range(ROUNDS):
        found = []
        for i in range(FOLDS):
            others = [w for j in range(FOLDS) if j != i or len(toxic) == 1 for text in chosen[j] for w in text]
            gains = _Gains(base, _trained(others, TOXIC_BYTES if k else FIRST_BYTES, LAST_SEGMENT if k else SEGMENT))
            # a window that a text repeats counts once
            found.append([[w for w in dict.fromkeys(text) if gains[w][0] >= CHOSEN_GAIN] for text in parts[i]])
        times = Counter(w for part in found for text in part for w in text)
        usual = Counter(w for text in ordinary for w in set(text) if w in times)
        share = lambda w: times[w] / len(toxic)
        telling = {w for w in times if share(w) >= RECURS and share(w) >= OFTENER * usual[w] / len(ordinary)}
        chosen = [[[w for w in text if w in telling] for text in part] for part in found]
    last = [w for i in range(len(toxic)) for w in chosen[i % FOLDS][i // FOLDS]]
    return _trained(last, TOXIC_BYTES, LAST_SEGMENT)


def measures(gains: np.ndarray, threshold: int) -> list[float]:
    """The largest gain, the mean of the three largest, and how far the windows' gains are beyond the
    threshold, on average and in all."""
    over = float(np.maximum(gains - threshold, 0).sum(dtype=np.int64))
    top = -np.sort(-gains.astype(float))[:3] if len(gains) else np.array([-8.0])
    return [top[0], top.mean(), np.log1p(100 * over / max(1, len(gains))), np.log1p(over)]


class ToxicityModel:
    """The ordinary dictionary and, for each fold, (toxic dictionary, window threshold, mean, scale, weights)."""

    def __init__(self, ordinary: bytes | None, folds: list[tuple]):
        self.ordinary, self.folds = ordinary, folds
        self._gains = None

    def __getstate__(self):
        return self.__dict__ | {"_gains": None}

    @classmethod
    def fit(cls, texts: list[str], labels: list[int]) -> ToxicityModel:
        """Fits on texts and their labels; repeated texts count once.

        Without rows of both labels the model scores every text 0.
        """
        rows = list(dict.fromkeys(((t or "").encode(), int(y)) for t, y in zip(texts, labels)))
        del texts, labels
        one: dict[bytes, bytes] = {}  # equal windows are one object
        cut = [([one.setdefault(w, w) for w in windows(t)], y) for t, y in rows]
        del one, rows
        ordinary, toxic = ([t for t, y in cut if y == k] for k in (0, 1))
        if len(ordinary) < 2 or not toxic:
            return cls(None, [])
        own, others = ordinary[::2][:ORDINARY_TEXTS], ordinary[1::2]
        base = _trained([w for text in own for w in text], ORDINARY_BYTES, SEGMENT)
        folds = []
        for fold in range(FOLDS):
            dictionary = train(base, own, [t for i, t in enumerate(toxic) if i % FOLDS != fold] or toxic)
            gains = _Gains(base, dictionary)
            held = [(gains.of(t)[:, 0], k) for k, some in enumerate((others[fold::FOLDS] or others, toxic[fold::FOLDS] or toxic)) for t in some]
            folds.append((dictionary, *_calibrated([g for g, _ in held], np.array([k for _, k in held], float), len(ordinary) / len(toxic))))
        return cls(base, folds)

    def forget(self) -> None:
        """Empties the table of gains, so that a worker that goes on to other work doesn't hold it."""
        self._gains = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not self.folds:
            return np.zeros(len(texts))
        if self._gains is None:
            self._gains = _Gains(self.ordinary, *(f[0] for f in self.folds))
        gains = [self._gains.of(windows((t or "").encode())) for t in texts]
        out = np.zeros(len(texts))
        for i, (_, threshold, mean, scale, weights) in enumerate(self.folds):
            x = np.array([measures(g[:, i], threshold) for g in gains]).reshape(-1, len(mean))
            out += _sigmoid(np.c_[(x - mean) / scale, np.ones(len(x))] @ weights)
        return out / len(self.folds)


def _calibrated(gains: list[np.ndarray], y: np.ndarray, ratio: float) -> tuple:
    """Window threshold, mean, scale and weights for texts that are toxic where ``y`` is 1; ``ratio``:
    ordinary texts to a toxic one among all."""
    weight = np.where(y == 1, 1.0, ratio * y.sum() / max(1, (y == 0).sum()))
    best = None
    for threshold in WINDOW_THRESHOLDS:
        x = np.array([measures(g, threshold) for g in gains])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        weights = _logistic((x - mean) / scale, y, weight)
        p = np.clip(_sigmoid(np.c_[(x - mean) / scale, np.ones(len(x))] @ weights), 1e-9, 1 - 1e-9)
        likely = (weight * np.log(np.where(y == 1, p, 1 - p))).sum()
        if best is None or likely > best[0]:
            best = likely, (threshold, mean, scale, weights)
    return best[1]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 2000, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    z = np.c_[z, np.ones(len(z))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        w -= rate * (z.T @ (weight * (_sigmoid(z @ w) - y)) / weight.sum() + decay * w)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Fits on at most ``rows`` labelled documents that are not held out.

    Only the chosen documents' texts come to the task that fits, and of identifiers with several texts no
    more than ``rows`` in all.  Labels that are null or differ for one
    document are left out, as are labels without a document.
    """
    chosen = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other AND toxic IN (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", "toxic")
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return fitted(found.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows), _fit_rows)


def _fit_rows(rows: list[dict]) -> ToxicityModel:
    rows.sort(key=lambda r: (hash(r["doc_id"]) * 2654435761 % 2**32, r["doc_id"], r["text"], r["toxic"]))
    texts, labels = [r["text"] for r in rows], [r["toxic"] for r in rows]
    rows.clear()
    return ToxicityModel.fit(texts, labels)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Whole texts are scored; null counts as empty and is scored too.  A null doc_id isn't held out.
    Other columns are left out; repeated rows stay repeated.
    """
    there = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = there.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    there = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            kept = there.value.scores(b.column(at).to_pylist()) < threshold
            yield b.filter(pa.array(kept))
        there.value.forget()

    return docs.mapInArrow(run, docs.schema)
