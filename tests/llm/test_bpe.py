from __future__ import annotations

import hashlib
import random
from itertools import chain

import numpy as np
import public_tokenizers as public
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, odd_texts, words
from veridraft.llm import bpe
from veridraft.llm.pretokens import Memory, stretches

PATH = public.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
PAIRS = bpe.BytePairs(RANKS)
CUT = regex.compile(public.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXT = st.text(st.sampled_from("abeinorst 'AZé日́²3\n\t\r\x1c\x85\xa0  　.,!_") | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_same_as_the_library(text):
    assert "".join(stretches(text)) == text
    values = lambda new: [list(chain(*PAIRS.encode_pieces([p.encode() for p in CUT.findall(s)]))) for s in new]
    ids = [i for v in next(Memory(values).of([text])) for i in v]
    assert ids == REFERENCE.encode_ordinary(text)
    assert PAIRS.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcaab"), min_size=1, max_size=40), st.integers(0, 10**6))
def test_any_ranks(text, seed):
    """Ranks in no order of training, where a merge can open a lower rank."""
    rng = random.Random(seed)
    tokens = {text[i:j].encode() for i in range(len(text)) for j in range(i + 2, min(len(text), i + 6))}
    tokens = rng.sample(sorted(tokens), len(tokens) // 2)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(tokens)}
    own = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=len(ranks))
    pieces = [text, text[1:], text[::-1], text]
    assert bpe.BytePairs(ranks).encode_pieces([p.encode() for p in pieces]) == [own.encode_ordinary(p) for p in pieces]


def test_white_space_of_the_pattern():
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for c in every:
        for text in (f"a{c} b", f"a {c}b", f"{c}{c}x"):
            got = list(chain(*PAIRS.encode_pieces([p.encode() for p in CUT.findall(text)])))
            assert got == REFERENCE.encode_ordinary(text), hex(ord(c))


def test_long_pieces_together():
    rng = random.Random(3)
    pieces = ["".join(rng.choices("abcdefgh", k=60_000)) + "a" * 60_000, "", "b" * 30_001, "x", " the"]
    got = PAIRS.encode_pieces([p.encode() for p in pieces])
    assert got == [REFERENCE.encode_ordinary(p) for p in pieces]


def test_queue_gives_the_lowest_rank():
    rng, queue, held = random.Random(4), bpe.RankQueue(50_000), {}
    for k in range(3000):
        if held and rng.random() < 0.5:
            rank = queue.first()
            assert rank == min(held) and queue.take(rank).tolist() == sorted(held.pop(rank))
        else:
            rank = rng.choice([rng.randrange(50_000), 63, 64, 4095, 4096, 49_999])
            queue.push(rank, np.array([k]))
            held.setdefault(rank, []).append(k)


@pytest.mark.parametrize("extra", [[], ["n_tokens", "kept"]])
def test_query(spark, extra):
    rng = random.Random(1)
    texts = odd_texts(rng) + ["it's  we'll\n don't <|endoftext|>"] * 2 + [words(rng, 300)]
    df = documents(spark, texts, extra=extra)
    rows = {r.doc_id: r for r in bpe.encode_documents(df, PATH, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = REFERENCE.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want
    assert bpe.encode_documents(documents(spark, []), PATH, public.PATTERN).count() == 0


def test_long_pre_tokens_of_ranks_that_open_lower_ones():
    """80,000 repeats of such a token in seconds, and the library's ids for mixtures of them."""
    import time

    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    pairs = bpe.BytePairs(ranks)
    library = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    opening = sorted((t for t, r in ranks.items() if pairs.opens[r] and t.isalpha()), key=lambda t: ranks[t])
    rng = random.Random(21)
    cases = [t * 60 for t in opening[:60]]
    for _ in range(150):
        some = rng.sample(opening[:400], 4)
        cases.append(b"".join(rng.choices(some, k=rng.randint(2, 80))))
        cases.append(bytes(rng.choices(b"".join(some), k=rng.randint(2, 200))))
    got = pairs.encode_pieces(cases)
    for case, ids in zip(cases, got):
        assert ids == library.encode_ordinary(case.decode()), case
        assert pairs.decode(ids) == case
    start = time.time()
    for unit in (b"st", b"est", b"th", opening[0] + opening[1]):
        assert pairs.decode(pairs.encode_pieces([unit * 80_000])[0]) == unit * 80_000
    assert time.time() - start < 60
