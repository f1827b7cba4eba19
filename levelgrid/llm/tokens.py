"""Token ids of whole texts by a public tokenizer, memoized by white-space-free pieces."""

from __future__ import annotations

import os
import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
# Pieces remembered by one Python worker, some 50 MB; beyond it the memo starts anew. A worker keeps it after its
# task, and an executor has a worker for each of its cores.
MEMO = 250_000

# A Latin-1 word with closing marks (no quote, no angle bracket). Such letters are composed already and
# lower-case one by one; the marks are one token run of their own.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\\[-`{-~]*)")
# The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_ALPHABET = dict(zip(_PRINTABLE, map(chr, _PRINTABLE))) | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}

_encoders: dict[str, "Encoder"] = {}


class _Memo(dict):
    """Ids of a piece, found on first use; a word and its closing marks are remembered apart as well."""

    def __init__(self, model):
        super().__init__({"": b""})
        self.model = model
        self.tokenize = model.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(model.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            out = np.array(self.model.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            word, marks = plain.groups()
            low = word.lower()
            if marks or low != piece:
                out = self[low] + self[marks]
            else:
                spelled = low if low.isascii() else "".join([_ALPHABET[b] for b in low.encode()])
                packed = self.packed
                out = b"".join([packed[t.id] for t in self.tokenize(spelled)])
        self[piece] = out
        return out


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes.

    The vocabulary file drops white space and never joins across it, so the ids of a text are those of
    its pieces between blanks, one after the other. Only characters that every layer takes for white
    space (blank, tab, line feed, carriage return) cut here.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.memo = _Memo(self.model)

    def encode(self, text: str | None) -> bytes:
        parts = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.memo) > MEMO:
            self.memo = _Memo(self.model)
        return b"".join(map(self.memo.__getitem__, parts))


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker for a vocabulary file (the public word vocabulary when none is named)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
