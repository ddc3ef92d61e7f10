import hashlib
import random

import pytest

from planarflow.llm import pieces
from planarflow.llm.common import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_are_those_of_the_library(lib):
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "😀", "ing", "<s>", "</s>", "<0x41>", "\0", "ß", "1", "ababab", " "]
    own = pieces.codec(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        ids = lib.encode(text)
        assert own.encode(text, end=False) == ids
        assert own.decode(ids) == lib.decode(ids)


def test_each_prefix_has_one_last_piece():
    own = pieces.codec(PATH)
    word = "▁unthinkableness"
    for end in range(1, len(word) + 1):
        fits = [i for i in range(len(own.pieces)) if own.pieces[i] in own.rank and word[:end].endswith(own.pieces[i]) and own.merged(word[:end])[-1] == own.pieces[i]]
        assert len(fits) == 1


def test_long_runs_need_no_quadratic_time(lib):
    text = "abracadabra" * 5000
    assert pieces.codec(PATH).encode(text, end=False) == lib.encode(text)


def test_whole_table(spark, docs, lib):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_pieces(docs).collect()}
    want = set()
    for r in docs.collect():
        ids = [*lib.encode(r.text or ""), lib.eos_id()]
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == want
    assert pieces.encode_pieces(docs).count() == docs.count()


def test_real_outputs(docs):
    for r in pieces.encode_pieces(docs, keep_ids=True).collect():
        assert len(r.ids) == r.n_tokens and r.ids[-1] == 2


def test_empty_table(no_docs):
    assert pieces.encode_pieces(no_docs).count() == 0
