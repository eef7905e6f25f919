"""Token ids of whole texts by a byte-level `tokenizers` file."""

from __future__ import annotations

import json
import re

import numpy as np

# How byte-level pre-tokenization of this family splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: longer runs of white space go to `tokenizers`; tiktoken's backtracking fails above about a million.
LONG = 100_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG}}}")


# What a file must say of its steps for the faster way to give the same ids.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WholeTokenizer:
    """The ids that `tokenizers` gives whole texts with add_special_tokens=False.

    A string of a special token inside a text is that token, as the library has it, or ordinary text where `ordinary`
    is set. Where a file is plain byte-level BPE that numbers its tokens in the order of its merges, the merges run in
    `tiktoken`, which gives the same ids in a quarter of the time; any other file, texts that hold the string of an
    added token, and texts with a long run of white space run in `tokenizers` itself.
    """

    def __init__(self, path: str, ordinary: bool = False):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = ordinary
        own = lambda text: whole.encode(text, add_special_tokens=False).ids
        file = json.loads(whole.to_str())
        model, added = file["model"], whole.get_added_tokens_decoder().values()
        vocab, letters = model["vocab"], _alphabet()
        pieces = {t: i for t, i in vocab.items() if t not in {x.content for x in added}}
        plain = file["normalizer"] is None and BYTE_LEVEL.items() <= (file["pre_tokenizer"] or {}).items()
        plain = plain and all(model.get(name) == value for name, value in PLAIN_BPE.items())
        merges = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] if plain else []
        self.encode = own
        if plain and merges == sorted(merges) and all(c in letters for t in pieces for c in t):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in pieces.items()}
            fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            apart = [x.content for x in added if not (ordinary and x.special)]

            def encode(text: str) -> list[int]:
                slow = any(x in text for x in apart) or len(text) >= LONG and _LONG_SPACE.search(text)
                return own(text) if slow else fast(text)

            self.encode = encode

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        return np.array(self.encode(text) if text else [], dtype="<u4")


def token_bytes(path: str) -> list[bytes]:
    """The bytes of text that each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    whole, letters = Tokenizer.from_file(path), _alphabet()
    vocab = whole.get_vocab(with_added_tokens=True)
    added = whole.get_added_tokens_decoder()
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        if i not in added:
            out[i] = bytes(letters[c] for c in piece)
    for i, token in added.items():
        out[i] = token.content.encode()
    return out


def byte_lengths(path: str) -> np.ndarray:
    """How many bytes of text each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    vocab = whole.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for piece, i in vocab.items():
        out[i] = len(piece)  # one character of the vocabulary's alphabet stands for one byte
    for i, token in whole.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out
