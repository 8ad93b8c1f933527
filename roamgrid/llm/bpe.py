"""Byte-level BPE encoding and decoding with a compiled tokenization automaton.

The merges are compiled, in rank order, into one deterministic automaton whose arcs are labelled
with tokens and which accepts exactly the token sequences that BPE yields.  It starts as one state
with an arc for each byte.  The gadget of merge ``u v -> w`` changes it so that ``u v`` can no longer
be read and ``w`` is read in its place:

* arcs labelled ``u`` are led to a copy of their target that has no ``v`` arc;
* every state with a ``u`` arc gets a ``w`` arc to where ``v`` led.

All arcs with one label lead to one state, so the table of transitions is: a target for each label,
and for each state the labels that it lacks.  ``v`` missing from a state also removes the tokens
made later from ``v`` as their left part, because a ``w`` arc is only added beside a ``u`` arc.
With tokens numbered in preorder of the "left part" forest, later children first, each gadget
removes one interval of numbers; a state is a set of intervals.

A word is encoded by following arcs from the start, longest label first; a place from which no arc
goes on is marked and left.  Each prefix of a word has exactly one accepted tokenization, so a place
has one state, no place is tried twice, and the first path to reach the end is the only one.
Decoding emits the arc labels' bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contractions that byte-level BPE cuts off as words, and Unicode's white space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Blocks of Unicode 16 that Python's table lacks: first and last code point.
UNICODE_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16D40, 0x16D7F), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF)]
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Words that a Python worker keeps encoded; the table is emptied when full.
CACHED_WORDS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


SPACE, LETTER, NUMBER, OTHER = range(4)


def character_classes() -> np.ndarray:
    """The class of every code point, by which texts are split into words."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for first, last in UNICODE_16:
        for c in range(first, last + 1):
            table[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER
    table[WHITE_SPACE] = SPACE
    return table


def split_words(text: str, classes: np.ndarray) -> list[str]:
    """Runs of one class, each with one blank before it; of other white space the last stands alone.

    Contractions are cut off where a run would begin with them.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[points]
    starts = np.empty(len(kind) + 1, bool)
    starts[0] = starts[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:-1])
    after = np.flatnonzero(starts[1:-1] & (kind[:-1] == SPACE)) + 1  # runs that follow white space
    starts[after - 1] = True
    starts[after[points[after - 1] == 0x20]] = False
    if "'" in text:
        for i in np.flatnonzero(starts[:-1] & (points == 0x27)).tolist():
            for cut in CONTRACTIONS:
                if text.startswith(cut, i):
                    starts[i + 1] = False
                    starts[i + len(cut)] = True
                    break
    at = np.flatnonzero(starts).tolist()
    return [text[a:b] for a, b in zip(at, at[1:])]


class Automaton:
    """Transition table over tokens 0..n-1: ``target[label]`` and each state's missing intervals."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """``labels[i]``: bytes of token i; ``merges``: (left, right, made) in rank order.

        Tokens that are neither a single byte nor made by a merge have no arc.  Raises ValueError
        if two merges make one token.
        """
        n = len(labels)
        self.labels = labels
        if {x[0] for x in labels if len(x) == 1} != set(range(256)):
            raise ValueError("the vocabulary needs a token for each byte")
        made_by = {}
        children: list[list[int]] = [[] for _ in range(n)]
        for rank, (u, _, w) in enumerate(merges):
            if w in made_by:
                raise ValueError(f"two merges make token {w}")
            made_by[w] = rank
            children[u].append(w)  # in rank order
        self.number, below = self._preorder(n, children, made_by)
        parent, first, last = [-1], [0], [0]  # state 0 lacks nothing
        target: list[int | None] = [0 if len(x) == 1 else None for x in labels]
        for rank, (u, v, w) in enumerate(merges):
            if target[u] is None or target[v] is None:
                continue
            at, number = target[u], self.number[v]
            while at > 0 and not first[at] <= number < last[at]:
                at = parent[at]
            if at > 0:
                continue  # u is never followed by v, so the merge makes nothing
            target[w] = target[v]
            ranks, ends = below[v]
            parent.append(target[u])
            first.append(number)
            last.append(ends[bisect_right(ranks, -rank)])
            target[u] = len(parent) - 1
        self.target = target
        self._flatten(parent, first, last)
        self._trie()

    @staticmethod
    def _preorder(n, children, made_by):
        """Numbers with later children first, and for each token where its children's subtrees end."""
        size = [1] * n
        left = {}
        for u in range(n):
            for w in children[u]:
                left[w] = u
        for w in sorted(left, key=made_by.get, reverse=True):
            size[left[w]] += size[w]
        number, below, at = [0] * n, [([], [0])] * n, 0
        for root in (i for i in range(n) if i not in left):
            number[root], at = at, at + size[root]
            stack = [root]
            while stack:
                u = stack.pop()
                end = number[u] + 1
                ranks, ends = [], [end]
                for w in reversed(children[u]):
                    number[w] = end
                    end += size[w]
                    ranks.append(-made_by[w])
                    ends.append(end)
                    stack.append(w)
                below[u] = ranks, ends
        return number, below

    def _flatten(self, parent, first, last):
        """Each live state's intervals, joined and sorted, in one table."""
        live = sorted({s for s in self.target if s is not None})
        renamed = {s: i for i, s in enumerate(live)}
        bounds = []
        for s in live:
            spans = []
            while s > 0:
                spans.append((first[s], last[s]))
                s = parent[s]
            spans.sort()
            flat: list[int] = []
            for a, b in spans:
                if flat and a <= flat[-1]:
                    flat[-1] = max(flat[-1], b)
                else:
                    flat += (a, b)
            bounds.append(flat)
        self.missing = bounds
        self.target = [None if s is None else renamed[s] for s in self.target]

    def _trie(self):
        """One dictionary for each trie node: byte -> child, and -1 -> the token that ends there."""
        self.root: dict = {}
        self.token_of: dict[bytes, int] = {}
        for token, label in enumerate(self.labels):
            if self.target[token] is not None:
                node = self.root
                for b in label:
                    node = node.setdefault(b, {})
                node[-1] = token
                self.token_of[label] = token

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("root", "token_of")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._trie()

    def has_arc(self, state: int, token: int) -> bool:
        return not bisect_right(self.missing[state], self.number[token]) & 1

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the automaton's only accepting path that spells ``word``."""
        whole = self.token_of.get(word)
        if whole is not None:
            return [whole]  # the first state lacks no arc
        n, path, dead, lacks = len(word), [], set(), ()
        target, missing, number = self.target, self.missing, self.number
        at, tries = 0, self._labels_at(word, 0)
        stack = []
        while at < n:
            while tries:
                token, end = tries.pop()  # the longest first
                if end not in dead and not bisect_right(lacks, number[token]) & 1:
                    stack.append((at, tries, lacks))
                    path.append(token)
                    at, lacks = end, missing[target[token]]
                    tries = self._labels_at(word, at)
                    break
            else:  # no arc from here: the accepting path doesn't pass this place
                dead.add(at)
                at, tries, lacks = stack.pop()
                path.pop()
        return path

    def _labels_at(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """Tokens that the word has at a place, shortest first, and where they end."""
        node, found = self.root, []
        for j in range(at, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            token = node.get(-1)
            if token is not None:
                found.append((token, j + 1))
        return found


class Codec:
    """A vocabulary's automaton with the splitting of texts and its special tokens."""

    def __init__(self, automaton: Automaton, specials: dict[str, int], n_tokens: int):
        self.automaton, self.specials = automaton, specials
        self.classes = character_classes()
        self.labels = [*automaton.labels, *[b""] * (n_tokens - len(automaton.labels))]
        for text, token in specials.items():
            self.labels[token] = text.encode()
        self._ready()

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Codec:
        """Reads a byte-level BPE vocabulary in the tokenizers library's JSON format.

        ``path`` is a local file of the driver or any path that Spark reads.
        """
        try:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
        except FileNotFoundError:
            spec = json.loads(spark.read.text(path, wholetext=True).head()[0])
        model, letters = spec["model"], byte_letters()
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        split = spec.get("pre_tokenizer") or {}
        if odd or model.get("ignore_merges") or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {odd or split}")
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec.get("added_tokens", [])):
            raise ValueError("special tokens that take in the text around them are not supported")
        vocab = model["vocab"]
        n = max([*vocab.values(), *added.values()]) + 1
        labels = [b""] * n
        for token, i in vocab.items():
            if token not in added:
                labels[i] = bytes(letters[c] for c in token)
        merges = []
        for pair in model["merges"]:
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        return cls(Automaton(labels, merges), added, n)

    def _ready(self):
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.decimal = [str(i) for i in range(len(self.labels))]
        self.cache = _Words(self.automaton)

    def __getstate__(self):
        return {"automaton": self.automaton, "specials": self.specials, "labels": self.labels, "classes": self.classes}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def _packed(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, split_words(text, self.classes)))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text; special tokens' strings become their ids; null counts as empty."""
        if not text:
            return np.zeros(0, np.int32)
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self._packed(text), np.int32)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += (self._packed(text[at : m.start()]), np.int32(self.specials[m[0]]).tobytes())
            at = m.end()
        return np.frombuffer(b"".join([*parts, self._packed(text[at:])]), np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The arc labels' bytes one after the other."""
        return b"".join(map(self.labels.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        ids = self.encode(text).tolist()
        listed = ",".join(map(self.decimal.__getitem__, ids)).encode()
        back = self.decode(ids).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest()


class _Words(dict):
    """Packed token ids of each word, filled on first use."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        packed = array("i", self.automaton.encode(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = packed
        return packed


def encode(df: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and ``token_ids`` (array of int) for each row; null and empty texts give no ids.

    Other columns of ``df`` are left out, whatever their names.  Repeated rows stay repeated, texts of any
    length are encoded whole, and an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for b in batches:
            ids = [shared.value.encode(t) for t in b.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "token_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Columns ``id_col`` and ``text`` for each row of token ids; a null list gives an empty text.

    Other columns are left out, repeated rows stay repeated, lists of any length are decoded whole, and
    an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for b in batches:
            texts = [shared.value.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, codec: Codec) -> DataFrame:
    """Encodes every text and decodes it again: ``doc_id``, ``n_tokens`` and the digests of both.

    One row for each input row.  A null text counts as empty: no tokens, digests of the empty
    string.  Works batch by batch without a shuffle; memory follows one batch of texts.
    """
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for b in batches:
            rows = [shared.value.digests(t) for t in b.column(1).to_pylist()]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
