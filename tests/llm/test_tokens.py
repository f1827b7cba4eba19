"""What a worker remembers of tokenized pieces stays within a bound of bytes, and the ids do not depend on it."""

import sys

import public_tokenizers

from levelgrid.llm import tokens


def size(memo: dict) -> int:
    return sys.getsizeof(memo) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memo.items())


def test_memo_is_bounded_in_bytes():
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    first, most = encoder.encode("n0 n1 n2 of it"), 0
    for k in range(0, 800_000, 50_000):
        encoder.encode(" ".join(f"n{i}" for i in range(k, k + 50_000)))
        most = max(most, size(encoder.memo))
    assert most <= 64 << 20
    assert encoder.encode("n0 n1 n2 of it") == first
