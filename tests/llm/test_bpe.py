"""BPE against the tokenizers library."""

import hashlib
import itertools
import pickle

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roamgrid.llm import bpe, registry
from tests.llm.samples import ODD, no_documents, odd_documents

PATH = public_tokenizers.path(registry.TOKENIZER_FILE)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(str(PATH))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.Codec.from_file(spark, PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_all_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:4] for r in registry.op1_bpe_round_trip(spark, sf).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_odd_rows(spark, library, codec):
    got = sorted((r.doc_id or 0, *tuple(r)[1:4]) for r in bpe.round_trip(odd_documents(spark), codec).collect())
    assert got == sorted((i or 0, *expected(library, t)) for i, t in ODD)
    assert bpe.round_trip(no_documents(spark), codec).count() == 0


def test_special_tokens(library, codec):
    for token in codec.specials:
        for text in (token, f"a{token}b", f" {token} {token}", token[:-1]):
            assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=8), st.sampled_from([" ", "  ", "\n", "\t ", "'s", "'ll", "'", "the", "ing", "1234", "...", " ", "　", "\U0001f600", "漢"])), max_size=20))
def test_any_text(library, codec, parts):
    text = "".join(parts)
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text).tolist()) == library.decode(codec.encode(text).tolist(), skip_special_tokens=False)


def merged(word, merges):
    """Merges one pair after the other, the lowest rank and then the leftmost first."""
    ranks = {(u, v): (i, w) for i, (u, v, w) in enumerate(merges)}
    word = list(word)
    while True:
        found = min(((*ranks[p], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks), key=lambda x: (x[0], x[2]), default=None)
        if not found:
            return word
        word[found[2] : found[2] + 2] = [found[1]]


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25))
def test_any_merges(pairs):
    """The automaton against plain merging, over all short words of three letters."""
    labels = [bytes([i]) for i in range(256)]
    merges, made = [], {}
    tokens = [97, 98, 99]
    for a, b in pairs:
        u, v = tokens[a % len(tokens)], tokens[b % len(tokens)]
        text = labels[u] + labels[v]
        if text in made or len(text) > 6:
            continue
        made[text] = len(labels)
        merges.append((u, v, len(labels)))
        tokens.append(len(labels))
        labels.append(text)
    automaton = pickle.loads(pickle.dumps(bpe.Automaton(labels, merges)))
    automaton.token_of = {}  # so that whole words go through the transitions, too
    for n in range(1, 7):
        for word in itertools.product(b"abc", repeat=n):
            assert automaton.encode(bytes(word)) == merged(word, merges)


def test_encode_then_decode(spark, codec):
    ids = bpe.encode(odd_documents(spark), codec)
    back = bpe.decode(ids, codec)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in ODD)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert bpe.decode(nothing, codec).head().text == ""
    assert codec.decode([codec.automaton.token_of[b"\xe6"]]) == "�"
