"""Token ids by the tokenizers library, with a bounded memory of words met before.

Ids come from the library: from its BPE model word by word, and for words outside printable
Latin-1 from its whole encoder. White space is never part of a token of this vocabulary, so a
text's ids are those of its white-space separated parts in order; `encode` relies on that and
`tests/llm` holds it against the library's own `encode` of whole texts.

The file must have the layout of `word_bpe_49k.json`: NFC, lower case, white space dropped, BPE
over byte characters. The memory of words is emptied when full, so it is bounded at any size.
"""

import os

import numpy as np
import regex

#: Fixed values of the vocabulary: its split pattern and the strings it reads as special tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

WORDS_KEPT = 500_000
WORD_BYTES = 64


def default_tokenizer():
    """Path of the vocabulary installed with the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters():
    """The printable stand-in of each Latin-1 character's UTF-8 bytes, for str.translate."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


class Encoder(dict):
    """Words (bytes without ASCII white space) to their ids as little-endian uint32 bytes."""

    def __init__(self, path, words_kept=WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.model._resize_cache(0)  # words are remembered here
        self.parts = regex.compile(SPLIT).findall
        self.simple = regex.compile("[!-~¡-ÿ]+").fullmatch
        self.signs = _byte_characters()
        self.words_kept = words_kept
        self.pieces = {}

    def __missing__(self, word):
        text = word.decode()
        if len(word) > WORD_BYTES or not self.simple(text):
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return self._keep(word, ids) if len(word) <= WORD_BYTES else ids
        out = []
        for part in self.parts(text.lower()):
            ids = self.pieces.get(part)
            if ids is None:
                tokens = self.model.tokenize(part.translate(self.signs))
                ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
                if len(self.pieces) >= self.words_kept:
                    self.pieces.clear()
                self.pieces[part] = ids
            out.append(ids)
        return self._keep(word, b"".join(out))

    def _keep(self, word, ids):
        if len(self) >= self.words_kept:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, data):
        """Ids of a whole UTF-8 text, as little-endian uint32 bytes."""
        if b"<|" in data and any(s in data for s in SPECIAL):
            ids = self.whole.encode(data.decode(), add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, data.split()))


_ENCODERS = {}


def encoder(path):
    """One encoder for each Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
