"""Token ids of whole texts as packed little-endian ids, word by word with a bounded cache.

White space never joins two tokens of the word-end vocabulary, so a text's ids are those of its
space-separated parts one after another. Parts made of plain Latin letters and ASCII marks go through a
byte-pair table in which a word's last character carries an end mark; all other parts (other scripts,
combining marks, special-token strings) go through the tokenizer library itself.
"""

from __future__ import annotations

import json
import sys
from array import array
from types import ModuleType

import numpy as np
import regex

DEFAULT_VOCABULARY = "word_bpe_49k.json"
CACHED_PARTS = 120_000
MARKS = frozenset(".,!?;:")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class WordTokenizer(dict):
    """Maps a text without spaces to its ids as bytes; ``encode`` does whole texts."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        letters = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            body, mark = (token[: -len(end)], b"\xff") if end and token.endswith(end) else (token, b"")
            if body and all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + mark] = i
        ranks.pop(b"\xff", None)  # no byte of UTF-8; it is the end mark here
        self.ends = bool(end)
        free = max(ranks.values()) + 1000
        for b in range(256):
            ranks.setdefault(bytes([b]), free + b)
        self.pairs = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]*")
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.older_pieces.get(piece)
            if found is None:
                found = array("I", self.pairs._core_bpe.encode_single_piece(piece.encode() + b"\xff")).tobytes()
            if len(self.pieces) >= CACHED_PARTS:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def __missing__(self, part: str) -> bytes:
        if self.ends and (part.isascii() or self.plain.fullmatch(part)) and "<|" not in part:
            low = part.lower()
            if low.isalpha():
                found = self._piece(low)
            elif low[:-1].isalpha() and low[-1:] in MARKS:
                found = self._piece(low[:-1]) + self._piece(low[-1])
            else:
                found = b"".join(map(self._piece, self.pattern.findall(low)))
        else:
            found = np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= 64:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def worker_tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer for ``path``. Python workers serve many tasks; tables and caches are made once in each."""
    held = sys.modules.setdefault("_motionframe_tokenizers", ModuleType("_motionframe_tokenizers")).__dict__
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]
