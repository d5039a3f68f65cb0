"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The tokenizer itself (the ``tokenizers`` library) encodes; texts are taken apart at spaces and line
ends, where its pre-tokenizer always cuts, so ids of a text are the ids of its words one after the
other.  Words of plain letters and signs skip the slow normaliser: they are lower-cased here, cut by the
file's own pattern and given to the file's own model.  All other words go through the whole tokenizer.
"""

from __future__ import annotations

import json
import struct

import numpy as np

DEFAULT = "word_bpe_49k.json"
CACHE_WORDS = 300_000
CACHE_PIECES = 150_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LONGEST_CACHED = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class WordEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        self.added = tuple(t["content"] for t in kind["added_tokens"])
        norm, pre = kind["normalizer"] or {}, kind["pre_tokenizer"] or {}
        steps = [n.get("type") for n in norm.get("normalizers", [])]
        cuts = pre.get("pretokenizers", [])
        self.by_words = (steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
                         and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"])
        if self.by_words:
            self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
            # composed letters whose lower case is a single letter in every Unicode version
            self.plain = regex.compile("[!-~¡-įı-ɏ]+")
            self.signs = _byte_signs()
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pattern cuts, in lower case."""
        got = self.pieces.get(piece) or self.old_pieces.get(piece)
        if got is None:
            signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
            ids = [t.id for t in self.model.tokenize(signs)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self.pieces) >= CACHE_PIECES:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def _encode(self, word: str) -> bytes:
        # letters with marks after them, the most frequent kind, need no pattern: the marks are one piece
        core = word.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or self.plain.fullmatch(core)):
            got = self._piece(core.lower())
            return got if len(core) == len(word) else got + self._piece(word[len(core):])
        if self.plain.fullmatch(word) and not any(t in word for t in self.added):
            return b"".join(map(self._piece, self.pattern.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in ``young``.  About the last ``CACHE_WORDS`` new ones are kept: memory is bounded."""
        found, old, encode = {}, self.old, self._encode
        for w in words:
            got = old.get(w)
            found[w] = encode(w) if got is None else got
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young.update((w, i) for w, i in found.items() if len(w) <= LONGEST_CACHED)
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, each as four little-endian bytes."""
        if not text:
            return b""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ws = text.replace("\n", " ").split(" ")
        got = list(map(self.young.get, ws))
        if None in got:
            new = self._learn({w for w, g in zip(ws, got) if g is None})
            got = [new[w] if g is None else g for w, g in zip(ws, got)]
        return b"".join(got)


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees the encoders of this Python worker: workers live on, and later stages need their memory."""
    _ENCODERS.clear()
