"""Byte-level BPE ids of texts."""

import base64
import functools
import json

import numpy as np


def tokenizer_path(name):
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, equal to the tokenizers library's `encode(text, add_special_tokens=False).ids` for the file `path`.

    `ranks_path` holds the same vocabulary as ranks for tiktoken, which finds
    the same ids several times faster; tests compare the two. Texts that hold
    an added token's string, which the library takes for that token, go through
    the library itself.
    """

    def __init__(self, path, ranks_path):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            self.added = [token["content"] for token in json.load(f)["added_tokens"]]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded by workers that meet an added token's string only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text):
        """The ids of one text (None or empty: none) as an array of unsigned 32-bit numbers."""
        if text and any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.plain(text)

    def plain(self, text):
        """The same, but with the strings of added tokens as ordinary text."""
        return np.array(self.fast.encode_ordinary(text) if text else [], "<u4")

    def decode(self, ids):
        """The bytes of ids without added tokens."""
        return self.fast.decode_bytes(ids)


_ENCODERS = {}


def encoder(path, ranks_path):
    """This worker's encoder for a file; tasks share it."""
    if (path, ranks_path) not in _ENCODERS:
        _ENCODERS[path, ranks_path] = Encoder(path, ranks_path)
    return _ENCODERS[path, ranks_path]
