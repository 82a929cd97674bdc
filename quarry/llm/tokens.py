"""Whole-text encoding with the tokenizers library, with a bounded cache of words.

A byte-level BPE without normaliser splits a text before every lone space, and around every lone line break, whatever stands
there. So a text's ids are its words' ids in a row, and each distinct word is encoded once per worker. Texts with other or
doubled white space are cut only before lone spaces. Texts that hold the string of an added token, and all texts of tokenizers of
other kinds, are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: ASCII marks that stand for themselves in the byte alphabet; no apostrophe, which opens contractions.
_TAIL = ".,!?;:*#$%&"
#: The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
_KEEP = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_ALPHABET = {b: b for b in _KEEP} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _KEEP)}
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")


class _Words(dict):
    """word -> its ids as bytes; a miss is encoded, and a full cache starts anew."""

    def __init__(self, encode, cap: int):
        super().__init__()
        self.encode, self.cap = encode, cap

    def __missing__(self, word):
        ids = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.cap:
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Encodes texts to little-endian ids, two bytes each where the vocabulary allows, else four."""

    def __init__(self, path: str, cap: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec["model"].get("type", "BPE") == "BPE" and not spec.get("normalizer") and not spec.get("post_processor")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        )
        if self.by_word:
            self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
            self.space, self.line = (self.pre.pre_tokenize_str(c)[0][0] for c in (" ", "\n"))
            self.pieces = _Words(self._piece, cap // 2)
            self.words = _Words(self._word, cap)
            self.chunks = _Words(self._chunk, cap // 8)
            self.line_ids = len(self._piece(self.line))

    def _piece(self, mapped: str) -> bytes:
        """Ids of one pre-token in the byte alphabet."""
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word with the space before it; a word after a line break comes with the break instead."""
        if word.isalpha() and word.isascii():
            return self.pieces[self.space + word]
        if word[0] == "\n":
            head, lead, body = self.pieces[self.line], "", word[1:]
        else:
            head, lead, body = b"", self.space, word
        core = body.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # one run of letters, then one of marks
            mapped = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_ALPHABET)
            ids = self.pieces[lead + mapped]
            return head + ids + self.pieces[body[len(core) :]] if len(core) < len(body) else head + ids
        return self._chunk(word if head else " " + word)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p] for p, _ in self.pre.pre_tokenize_str(chunk)])

    def encode(self, text: str) -> bytes:
        """The whole text's ids as bytes."""
        if not text:
            return b""
        if not self.by_word or any(map(text.__contains__, self.added)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        words = ("\n" + text).replace("\n", " \n").split(" ")
        if words[0] == "" and "" not in words[1:] and "\n" not in words and text.replace("\n", "").isprintable():
            return b"".join(map(self.words.__getitem__, words[1:]))[self.line_ids :]
        return b"".join(map(self.chunks.__getitem__, _LONE_SPACE.split(text)))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
