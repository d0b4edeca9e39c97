"""Exact encoding of whole texts with public byte-pair vocabularies, by the merge engine of tiktoken.

The vocabulary files are those of the tokenizers library, and the ids are the ones that it gives for the whole text
(the tests compare them). Its merge loop gets through about 1 MB/s on one core; the same ranks run seven times as
fast here. Texts with something out of the ordinary (special tokens, NUL, context-dependent lower case) go through
the tokenizers library itself, whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b if b in shown else next(hidden)): b for b in range(256)}


class Encoder:
    """encode(text) -> ids; end_id, if given, follows each text."""

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        spec = json.load(open(path))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.n_ids = 1 + max(self.plain.get_vocab(with_added_tokens=True).values())
        self.end = [] if end_id is None else [end_id]
        self.setup(spec)

    def whole(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids

    def setup(self, spec: dict) -> None:
        raise NotImplementedError

    def ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode(self, text: str) -> np.ndarray:
        found = self.whole(text) if any(s in text for s in self.specials) else self.ids(text)
        found += self.end
        return np.frombuffer(array("I", found), np.uint32)


class ByteEncoder(Encoder):
    """Byte-level BPE whose pre-tokens carry the space before them."""

    def setup(self, spec: dict) -> None:
        import tiktoken

        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in self.vocabulary.items()}

        def engine(spaces: str):
            words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
            return tiktoken.Encoding("bytes", pat_str=words + spaces, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        # without neighbouring white space the look-ahead never matters, and a pattern without it runs much faster
        self.any_spaces, self.lone_spaces = engine(r"\s+(?!\S)|\s+"), engine(r"\s+")
        self.neighbours = ["  ", " \n", "\n ", "\n\n", "\t", "\v", "\f", "\r", "\x85", "\xa0"]
        self.neighbours += [" ", " ", " ", " ", " ", "　", *map(chr, range(0x2000, 0x200B))]

    def ids(self, text: str) -> list[int]:
        return (self.any_spaces if any(s in text for s in self.neighbours) else self.lone_spaces)(text)


#: Classes of characters for the word encoder.
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


def _class_of(char: str) -> int:
    if char.isspace() and char not in "\x1c\x1d\x1e\x1f":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(char)[0], OTHER)


class WordEncoder(Encoder):
    """BPE over normalised words with a word-end mark: white space separates, and is dropped. Each pre-token gets a NUL
    behind it, which stands for the mark among the ranks."""

    def setup(self, spec: dict) -> None:
        import regex
        import tiktoken

        symbols, mark = byte_symbols(), spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in self.vocabulary.items():
            body, end = (token[: -len(mark)], b"\0") if token.endswith(mark) else (token, b"")
            if all(symbols.get(c) for c in body):
                ranks[bytes(symbols[c] for c in body) + end] = i
        for b in range(256):  # the engine wants all bytes; those that are no tokens occur in no UTF-8 text, or only marked
            ranks.setdefault(bytes([b]), max(self.vocabulary.values()) + 1000 + b)
        # the ids of marked bytes are below those of all other merges, so a word's last byte takes its mark first
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\s\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.short = regex.compile("'(?:[stmd]|re|ve|ll)").search
        # what Python's tables don't know yet, the library's newer ones may
        self.classes = np.array([UNKNOWN if unicodedata.category(c) == "Cn" else _class_of(c) for c in map(chr, range(0x110000))], np.uint8)

    def ids(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if any(c in text for c in "\u0130\u0345\u03a3"):  # their lower case depends on context
                return self.whole(text)
        if "\0" in text:
            return self.whole(text)
        marked = self.marked(text.lower())
        return self.whole(text) if marked is None else self.merge(marked)

    def marked(self, text: str) -> str | None:
        """The text with a NUL behind each pre-token; None if it has a character that isn't known here."""
        if "'" in text and self.short(text):
            if not text.isascii() and (self.classes[np.frombuffer(text.encode("utf-32-le"), "<u4")] == UNKNOWN).any():
                return None
            return self.pieces.sub(lambda m: m[0] + "\0", text)
        try:  # mostly a byte a character does
            coding, chars = "latin-1", np.frombuffer(text.encode("latin-1"), np.uint8)
            kinds = self.classes[chars]
        except UnicodeEncodeError:
            coding, chars = "utf-32-le", np.frombuffer(text.encode("utf-32-le"), "<u4")
            kinds = self.classes[chars]
            if (kinds == UNKNOWN).any():
                return None
        ends = kinds != SPACE
        ends[:-1] &= (kinds[:-1] != kinds[1:]) | (kinds[:-1] == NUMBER)
        places = np.flatnonzero(ends)
        return np.insert(chars, places + 1, 0).tobytes().decode(coding)


_LOADED: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """The encoder for a vocabulary file, once for each worker process; its kind follows from the file."""
    key = (path, end_id)
    if key not in _LOADED:
        marked = json.load(open(path))["model"].get("end_of_word_suffix")
        _LOADED[key] = (WordEncoder if marked else ByteEncoder)(path, end_id)
    return _LOADED[key]
