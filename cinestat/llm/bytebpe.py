"""Whole-document encoding with a byte-level BPE file.

The ids are those of the tokenizers library for the same file. Its vocabulary
numbers tokens in merge order, so the ids double as merge ranks, and the same
merges run several times faster in tiktoken; the rank table is built here from
the tokenizers file itself. Texts that hold a special token's string, and texts
that the faster engine refuses, are encoded by the tokenizers library as they
stand.
"""

from __future__ import annotations

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# the split pattern of byte-level vocabularies of this kind (a fixed value of the format)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters stand
    for themselves, the other bytes, in order, for the characters from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in visible}
    for n, b in enumerate(b for b in range(256) if b not in set(visible)):
        out[chr(256 + n)] = b
    return out


class ByteBPE:
    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        as_byte = byte_of_character()
        ranks = {bytes(as_byte[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, little-endian unsigned 32-bit."""
        if not any(s in text for s in self.specials):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001, S110  a panic of the engine is no Exception; the library takes the text
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for (a special token: its string)."""
        out = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for t, i in self.tok.get_vocab(with_added_tokens=True).items():
            # in the vocabulary each byte is written as one character
            out[i] = len(t.encode()) if t in self.specials else len(t)
        return out


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One encoder per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]
