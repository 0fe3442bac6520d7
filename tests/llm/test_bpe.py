import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pastlane.llm.arrays import SLICE_BYTES
from pastlane.llm.bpe import Encoder, _round_trips, bpe_decode, bpe_encode, load_ranks
from pastlane.llm.catalog import RANKS, bpe_digests

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(public_tokenizers.path(RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library(ranks, library):
    encoder = Encoder(ranks, PATTERN)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.text(), st.text("abé \n"), st.none()), max_size=5))
    def check(texts):
        assert [x.tolist() for x in encoder.texts(texts)] == [library.encode_ordinary(x or "") for x in texts]

    check()
    long = ["a" * 3000, "ab" * 2000, "\n" * 500 + " " * 300, "thé" * 1500]
    assert [x.tolist() for x in encoder.texts(long)] == [library.encode_ordinary(x) for x in long]


def test_smaller_rank_that_comes_up_late():
    # Joining c and d makes a pair of less rank than the one whose bucket is being emptied.
    ranks = {bytes([x]): x for x in range(256)} | {b"cd": 300, b"acd": 290, b"ab": 310}
    library = tiktoken.Encoding("late", pat_str=r"\w+", mergeable_ranks={**ranks}, special_tokens={})
    text = "acdcdacdabcd"
    assert Encoder(ranks, r"\w+").texts([text])[0].tolist() == library.encode_ordinary(text)


def test_odd_rows_and_round_trip(odd_docs, no_docs, ranks, library):
    encoded = bpe_encode(odd_docs, ranks, PATTERN)  # replaces a column of the same name
    rows = bpe_decode(encoded, ranks).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded).decode() == (row.text or "")
    digests = {(r.doc_id, r.n_tokens): r for r in bpe_digests(odd_docs).collect()}
    for row in rows:
        got = digests[row.doc_id, len(row.ids)]
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe_digests(no_docs).count() == 0


def test_round_trips_are_given_away_by_slices(ranks):
    texts = ["ab " * (SLICE_BYTES // 4)] * 3 + ["c", None]
    made = list(_round_trips(iter([pa.array(texts)]), ranks, public_tokenizers.PATTERN))
    assert [len(x) for x in made] == [1, 1, 3]
    assert [x for part in made for x in part.field("decoded").to_pylist()] == [(x or "").encode() for x in texts]
