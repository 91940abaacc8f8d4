import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import bpe

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(VOCAB)
LIBRARY = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Encoder(RANKS, P.PATTERN, cache=50)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_as_the_library(text):
    ids = OURS.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_long_pretokens():
    rng = random.Random(1)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "東京都" * 3000, "=" * 5000):
        assert OURS.encode(text) == LIBRARY.encode_ordinary(text)


def test_queue_order():
    q = bpe.RankQueue(1000)
    rng = random.Random(2)
    items = [(rng.randrange(1000), k) for k in rng.sample(range(5000), 500)]
    for r, k in items:
        q.push(r, k)
    assert [q.pop() for _ in items] == sorted(items)
    assert q.summary == 0


def test_query_columns_and_odd_rows(spark):
    df = odd_documents(spark)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    rows = bpe.round_trip(df, VOCAB, P.PATTERN).collect()
    assert len(rows) == 10
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(empty_documents(spark), VOCAB, P.PATTERN).count() == 0
    ids = bpe.encode_column(df, VOCAB, P.PATTERN)
    back = bpe.decode_column(ids, VOCAB, P.PATTERN).collect()
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in back)


def test_the_cache_is_bounded_in_characters():
    known = bpe.Known(len, 100, chars=50)
    for k in range(1000):
        assert known["x" * (k % 30)] == k % 30
        assert sum(map(len, known)) < 80 and sum(map(len, known.old)) < 80
    assert known["y" * 10_000] == 10_000 and "y" * 10_000 not in known
