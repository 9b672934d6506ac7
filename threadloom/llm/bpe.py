"""Byte-level BPE ids and pre-tokens, equal to those of the tokenizers library for ``byte_bpe_50k.json``.

Texts whose code points all lie under U+0530 are cut by a compiled character-class pattern and looked up piece by piece;
character classes of later Unicode versions cannot differ there. Any other text goes through the library itself.
"""

from __future__ import annotations

import base64
import gc
import re
import unicodedata
from functools import cache

#: The marker that the library's default turns into its own id wherever it stands in a text.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_PLAIN = 0x530
_OTHER = re.compile(f"[^\\x00-{chr(_PLAIN - 1)}]")
#: Pieces remembered by one worker; beyond it the memory starts anew.
_REMEMBERED = 400_000


def _ranges(wanted) -> str:
    out, start = [], None
    for i in range(_PLAIN + 1):
        inside = i < _PLAIN and wanted(chr(i))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = None
    return "".join(out)


@cache
def _pattern() -> re.Pattern:
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = "\\t-\\r\\u0020\\u0085\\u00a0"
    return re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


@cache
def library(path: str):
    """The tokenizer itself."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _merger(path: str):
    """Ids of one piece's bytes by merge rank; the ``.tiktoken`` file beside the ``.json`` has the same vocabulary."""
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return pieces._core_bpe.encode_single_piece


class Encoder:
    """One per worker and vocabulary file."""

    def __init__(self, path: str) -> None:
        self.path, self.find, self.known = path, _pattern().findall, {}
        gc.freeze()

    def _learn(self, piece: str) -> list[int]:
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        ids = _merger(self.path)(piece.encode())
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        """All ids of a whole text."""
        if _OTHER.search(text):
            return library(self.path).encode(text, add_special_tokens=False).ids
        get, learn, out = self.known.get, self._learn, []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(SPECIAL_ID)
            for piece in self.find(part):
                out += get(piece) or learn(piece)
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a whole text, and how often the special marker stands in it."""
        if not _OTHER.search(text):
            if SPECIAL not in text:
                return self.find(text), 0
            parts = text.split(SPECIAL)
            return [p for part in parts for p in self.find(part)], len(parts) - 1
        cut, parts = library(self.path).pre_tokenizer.pre_tokenize_str, text.split(SPECIAL)
        return [part[a:b] for part in parts for _, (a, b) in cut(part)], len(parts) - 1

    def count(self, piece: str) -> int:
        """Number of ids of one pre-token."""
        return len(_merger(self.path)(piece.encode()))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    """The vocabulary file as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
