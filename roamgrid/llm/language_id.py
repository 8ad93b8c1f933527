"""Language identification with a linear-chain conditional random field over words.

Every word, of any length, has hashed features: its first and last one to four letters, all its letter
pairs and triples, and, if the lexicon of frequent training words has it, the word itself.  Labels are
languages; transitions between the labels of neighbouring words are learned with the features'
weights by maximising the conditional likelihood of sequences that switch between documents of
different languages.  Forward-backward gives each word's label probabilities; a text's language is
the label with the highest mean probability.

Forward-backward is exact for texts of any length: it runs over segments of all texts of a batch
side by side, joins the segments by their transfer matrices, and goes over them again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.llm.rows import fitted

#: Documents that a model is fitted on, at most: those with the smallest hashes of doc_id.
TRAINING_ROWS = 3_000
BUCKETS = 1 << 18
#: Letters of words whose features are made together, and how many words; longer words are taken one by one.
SHORT, TOGETHER = 24, 10_000
#: Times a word must occur in the training documents to be in the lexicon.
LEXICON_COUNT = 5
SEGMENT = 64
#: Rows that a filtering task turns into Python's strings at a time.
ROWS = 500
#: Words labelled together, and words whose scores a Python worker keeps.
BATCH_WORDS, CACHED_WORDS = 100_000, 150_000
UNDETERMINED = "und"
#: Mean probability below which the pipeline takes a text to have no certain language.
LEAST_SCORE = 0.4
#: Mean over a text's words of their own largest probability from which the pipeline takes even a
#: mixed text to be of certain languages.
LEAST_CERTAINTY = 0.6

_runs = re.compile(r"[^\W\d_]+").findall
_M = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


def find_words(text: str) -> list[str]:
    """Runs of letters; numerals such as superscripts, which re takes for word characters, end one."""
    words = _runs(text)
    if not words or "".join(words).isalpha():
        return words
    return [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x1000193)) * _M
    return (h ^ (h >> np.uint64(29))) * _M


def _short_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    fore = np.array(words, f"U{SHORT}").view(np.uint32).reshape(n, SHORT).astype(np.uint64)
    back = np.array([w[:-5:-1] for w in words], "U4").view(np.uint32).reshape(n, 4).astype(np.uint64)
    size = np.array([len(w) for w in words])
    none = np.uint64(BUCKETS)
    columns = []

    def add(h, there, salt):
        columns.append(np.where(there, _mix(h, salt) >> np.uint64(46), none))

    for letters, salt in ((fore, 1), (back, 11)):
        h = np.zeros(n, np.uint64)
        for k in range(4):
            h = h * _STEP + letters[:, k]
            add(h, size > k, salt + k)
    for k in range(int(size.max(initial=0)) - 1):
        pair = fore[:, k] * _STEP + fore[:, k + 1]
        add(pair, size > k + 1, 21)
        if k + 2 < SHORT:
            add(pair * _STEP + fore[:, k + 2], size > k + 2, 22)
    found = np.stack(columns, axis=1).astype(np.int32)
    there = found < BUCKETS
    return found[there], there.sum(axis=1)


def _long_features(word: str) -> np.ndarray:
    letters = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for ends, salt in ((letters[:4], 1), (letters[:-5:-1], 11)):
        h = np.zeros(1, np.uint64)
        for k in range(4):
            h = h * _STEP + ends[k]
            found.append(_mix(h, salt + k))
    pairs = letters[:-1] * _STEP + letters[1:]
    found += [_mix(pairs, 21), _mix(pairs[:-1] * _STEP + letters[2:], 22)]
    return (np.concatenate(found) >> np.uint64(46)).astype(np.int32)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features but the lexicon's, one word after the other, and how many each word has."""
    short = [w for w in words if len(w) <= SHORT]
    some = [_short_features(short[i : i + TOGETHER]) for i in range(0, len(short), TOGETHER)]
    flat, counts = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    if len(short) == len(words):
        return flat, counts
    parts = iter(np.split(flat, np.cumsum(counts)[:-1]))
    found = [next(parts) if len(w) <= SHORT else _long_features(w) for w in words]
    return np.concatenate(found), np.array([len(f) for f in found])


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each whole word."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class LanguageModel:
    """Weights of the field; ``labels`` in alphabetical order."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: np.ndarray, lexicon_weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.lexicon, self.lexicon_weights, self.transitions = labels, weights, lexicon, lexicon_weights, transitions
        self._words = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def forget(self) -> None:
        """Empties the table of words, so that a worker that goes on to other work doesn't hold it."""
        self._words = None

    def emissions(self, words: list[str]) -> np.ndarray:
        features, counts = word_features(words)
        out = np.add.reduceat(self.weights[features], _starts(counts))
        if len(self.lexicon):
            whole = word_hashes(words)
            at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            out += np.where((self.lexicon[at] == whole)[:, None], self.lexicon_weights[at], 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 for null and for texts without letters."""
        langs, scores, _ = self.predict_certainty(texts)
        return langs, scores

    def predict_certainty(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As predict, and the mean over each text's words of the word's largest label probability."""
        langs, scores, certain = [], [], []
        for ids, lengths in self._numbered(texts):
            p = _marginals(self._scores[ids].astype(float), lengths, np.exp(self.transitions))
            mean = _means(p, lengths)
            best = mean.argmax(axis=1)
            langs += [self.labels[k] if n else UNDETERMINED for k, n in zip(best, lengths)]
            scores.append(np.where(lengths > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0))
            certain.append(np.clip(_means(p.max(axis=1, keepdims=True), lengths)[:, 0], 0, 1))
        return langs, np.concatenate([*scores, np.zeros(0)]), np.concatenate([*certain, np.zeros(0)])

    def label_words(self, text: str | None) -> list[tuple[str, str]]:
        """Each word of a text and its most probable label."""
        words = find_words(text or "")
        if not words:
            return []
        p = _marginals(np.exp(_centred(self.emissions([w.lower() for w in words]))), np.array([len(words)]), np.exp(self.transitions))
        return [(w, self.labels[k]) for w, k in zip(words, p.argmax(axis=1))]

    def _numbered(self, texts):
        """Word numbers of some texts at a time, and how many words each has."""
        ids, lengths, total = [], [], 0
        for i, text in enumerate(texts):
            if not total and (self._words is None or len(self._words) > CACHED_WORDS):
                self._words, self._scores = _Numbers(), np.zeros((0, len(self.labels)), np.float32)
            found = find_words((text or "").lower())
            ids.append(np.fromiter(map(self._words.__getitem__, found), np.int32, len(found)))
            lengths.append(len(found))
            total += len(found)
            if total >= BATCH_WORDS or i == len(texts) - 1:
                self._score_new()
                yield np.concatenate(ids), np.array(lengths)
                ids, lengths, total = [], [], 0

    def _score_new(self):
        new = self._words.new
        if new:
            n = len(self._words)
            if n > len(self._scores):
                grown = np.zeros((max(n, 2 * len(self._scores)), len(self.labels)), np.float32)
                grown[: len(self._scores)] = self._scores
                self._scores = grown
            for i in range(0, len(new), TOGETHER):
                some = new[i : i + TOGETHER]
                first = n - len(new) + i
                self._scores[first : first + len(some)] = np.exp(_centred(self.emissions(some)))
            new.clear()

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], steps: int = 80, batch: int = 192, length: int = 48, seed: int = 7) -> LanguageModel:
        """Maximises the conditional likelihood over sequences cut from ``texts`` by AdaGrad.

        A sequence goes on with a piece of another random document after some words, about twelve.
        """
        labels = sorted(set(langs))
        number, docs = _Numbers(), []
        for t, y in zip(texts, langs):  # of a text only the numbers of its words are held
            words = find_words(t.lower())
            if words:
                docs.append((np.fromiter(map(number.__getitem__, words), np.int32, len(words)), labels.index(y)))
        k = max(1, len(labels))
        if not docs or k < 2:
            return cls(labels or [UNDETERMINED], np.zeros((BUCKETS + 1, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.zeros((k, k)))
        vocabulary, counts = number.new, np.bincount(np.concatenate([words for words, _ in docs]), minlength=len(number))
        del number
        features, counted = word_features(vocabulary)
        whole = word_hashes(vocabulary)
        frequent = counts >= LEXICON_COUNT
        lexicon = np.unique(whole[frequent])
        # a frequent word's own feature stands behind its others
        features = np.insert(features, np.cumsum(counted)[frequent], (BUCKETS + 1 + np.searchsorted(lexicon, whole[frequent])).astype(np.int32))
        counted = counted + frequent
        starts = _starts(counted)
        weights = np.zeros((BUCKETS + 1 + len(lexicon), k))
        speed = np.full_like(weights, 1e-3)
        transitions, t_speed = np.zeros((k, k)), np.full((k, k), 1e-3)
        random = np.random.default_rng(seed)
        of = [np.flatnonzero([y == j for _, y in docs]) for j in range(k)]
        for _ in range(steps):
            ids, gold = np.empty((batch, length), np.int64), np.empty((batch, length), np.int64)
            for b in range(batch):
                at = 0
                while at < length:
                    words, y = docs[random.choice(of[random.integers(k)])]
                    start = random.integers(len(words))
                    piece = words[start : start + 1 + random.geometric(1 / 12)][: length - at]
                    ids[b, at : at + len(piece)], gold[b, at : at + len(piece)] = piece, y
                    at += len(piece)
            used, where = np.unique(ids, return_inverse=True)
            many = counted[used]
            own = features[np.repeat(starts[used] - _starts(many), many) + np.arange(many.sum())]
            e = np.add.reduceat(weights[own], _starts(many))
            p, pairs = _expected(e[where.reshape(ids.shape)], transitions)
            error = p.copy()
            error[np.arange(batch)[:, None], np.arange(length)[None, :], gold] -= 1
            g = np.stack([np.bincount(where.ravel(), error[:, :, j].ravel(), len(used)) for j in range(k)], axis=1) / batch
            touched, slot = np.unique(own, return_inverse=True)
            gw = np.stack([np.bincount(slot, np.repeat(g[:, j], many), len(touched)) for j in range(k)], axis=1)
            gw += 1e-4 * weights[touched]
            speed[touched] += gw**2
            weights[touched] -= 0.1 * gw / np.sqrt(speed[touched])
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            gt = (pairs - seen) / batch + 1e-3 * transitions
            t_speed += gt**2
            transitions -= 0.1 * gt / np.sqrt(t_speed)
        return cls(labels, weights[: BUCKETS + 1].astype(np.float32), lexicon, weights[BUCKETS + 1 :].astype(np.float32), transitions)


class _Numbers(dict):
    """Numbers words in the order in which they come; ``new`` has those not scored yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _centred(e: np.ndarray) -> np.ndarray:
    return np.maximum(e - e.max(axis=1, keepdims=True), -60)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(axis=-1, keepdims=True), 1e-300)


def _expected(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities and expected transition counts of sequences of one length."""
    x = np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -60))
    a = np.exp(transitions)
    b, n, k = x.shape
    alpha, beta = np.empty_like(x), np.empty_like(x)
    now = np.full((b, k), 1 / k)
    for t in range(n):
        alpha[:, t] = now = _unit((now @ a) * x[:, t])
    now = np.ones((b, k))
    pairs = np.zeros((k, k))
    for t in range(n - 1, -1, -1):
        beta[:, t] = now
        if t:
            both = alpha[:, t - 1, :, None] * a * (x[:, t] * now)[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = _unit((now * x[:, t]) @ a.T)
    return _unit(alpha * beta), pairs


def _marginals(x: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Label probabilities of the words of several texts, whose scores stand one after the other in ``x``."""
    k = a.shape[0]
    segments = -(-lengths // SEGMENT)
    n = int(segments.sum())
    if not n:
        return np.zeros((0, k))
    text_of = np.repeat(np.arange(len(lengths)), segments)
    rank = np.arange(n) - np.repeat(np.cumsum(segments) - segments, segments)
    starts = np.repeat(np.cumsum(lengths) - lengths, segments) + rank * SEGMENT
    size = np.minimum(SEGMENT, lengths[text_of] - rank * SEGMENT)
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    longer = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments with more than t words
    transfer = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(SEGMENT):
        m = longer[t]
        if not m:
            break
        step = (transfer[:m].reshape(-1, k) @ a).reshape(m, k, k) * x[starts[:m] + t][:, None, :]
        transfer[:m] = step / np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.cumsum(segments) - segments
    alpha, beta = np.full((n, k), 1 / k), np.ones((n, k))
    for j in range(1, int(segments.max())):
        at = first[segments > j] + j
        before = place[at - 1]
        alpha[place[at]] = _unit(np.einsum("nk,nkl->nl", alpha[before], transfer[before]))
    for j in range(int(segments.max()) - 1, 0, -1):
        at = first[segments > j] + j
        after = place[at]
        beta[place[at - 1]] = _unit(np.einsum("nkl,nl->nk", transfer[after], beta[after]))
    out = np.empty((len(x), k))
    for t in range(SEGMENT):
        m = longer[t]
        if not m:
            break
        alpha[:m] = _unit((alpha[:m] @ a) * x[starts[:m] + t])
        out[starts[:m] + t] = alpha[:m]
    for t in range(SEGMENT - 1, -1, -1):
        m = longer[t]
        if m:
            at = starts[:m] + t
            out[at] *= beta[:m]
            beta[:m] = _unit((beta[:m] * x[at]) @ a.T)
    return _unit(out)


def _means(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
    ends = np.cumsum(lengths)
    return (total[ends] - total[ends - lengths]) / np.maximum(lengths, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> LanguageModel:
    """Fits on at most ``rows`` documents with a language that are not held out.

    The documents are chosen by their identifiers alone; only their texts come to the task that fits, and of
    identifiers with several texts or languages no more than ``rows`` in all.
    """
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.select("doc_id").distinct().orderBy(*order).limit(rows)
    found = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    return fitted(found.distinct().orderBy(*order, "lang", "text").limit(rows), _fit_rows)


def _fit_rows(rows: list[dict]) -> LanguageModel:
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    texts, langs = [r["text"] for r in rows], [r["lang"] for r in rows]
    rows.clear()
    return LanguageModel.fit(texts, langs)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for each row of ``docs``.

    Whole texts are labelled.  ``und`` with score 0 for null and for texts without a letter; a null
    doc_id isn't held out.  Equal means go to the alphabetically first language.  Other columns are
    left out; repeated rows stay repeated.
    """
    there = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = there.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id`` and ``words`` (array of word and lang) for each row: where a text switches language."""
    there = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            words = [[{"word": w, "lang": y} for w, y in there.value.label_words(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, kind)], names=["doc_id", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, words array<struct<word: string, lang: string>>")


def keep_determined(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least this score, or
    whose words have certain languages, however these are mixed.

    Null texts and those without a letter go.  A model that has learned no language, as from a table
    without any, rejects no text that has letters.
    """
    there = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        nothing_learned = there.value.labels == [UNDETERMINED]
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            langs, scores, certain = there.value.predict_certainty(b.column(at).to_pylist())
            kept = [c > 0 if nothing_learned else x != UNDETERMINED and (s >= least or c >= LEAST_CERTAINTY) for x, s, c in zip(langs, scores, certain)]
            yield b.filter(pa.array(kept, pa.bool_()))
        there.value.forget()

    return docs.mapInArrow(run, docs.schema)
