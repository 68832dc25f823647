"""Token ids of whole texts, through the tokenizers library, each distinct word once per worker.

For texts whose characters lie below U+0250 the vocabulary's normaliser is lower-casing and its splitter a plain pattern,
so words are cut here, and only words not met before go through the library (its model, byte-level pre-tokenizer and
merges).  Any other text goes through the library as it is.  Both ways give the same ids (tested).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .shared import kept

#: Words and pieces remembered by a worker, some 130 bytes each (bounds its memory, not the result).
REMEMBERED = 500_000
#: Characters for which the shortcut isn't known to hold; \\x1c-\\x1f and \\x85 are white space to one pattern language only.
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")
#: The splitter's own pattern, for the characters left.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|[^\s\w]+(?:_|[^\s\w])*|_(?:_|[^\s\w])*")
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The normaliser and splitter that words are cut like here; another vocabulary's texts go through the library whole.
_NORMALISER = ["NFC", r"Replace \s+", "Lowercase"]
_SPLITTER = [r"Split 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel"]


def _steps(spec: dict | None) -> list[str]:
    """Names and patterns of a sequence of steps."""
    parts = (spec or {}).get("normalizers") or (spec or {}).get("pretokenizers") or []
    return [" ".join(filter(None, (p["type"], p.get("pattern", {}).get("Regex")))) for p in parts]


class Encoder:
    """``encode(text)`` gives little-endian unsigned 16-bit ids as bytes; the vocabulary must have under 65,536 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self._whole = path, None
        spec = json.load(open(path, encoding="utf-8"))
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.words = None
        if self.suffix and _steps(spec.get("normalizer")) == _NORMALISER and _steps(spec.get("pre_tokenizer")) == _SPLITTER:
            self.words = Tokenizer.from_file(path)
            self.words.encode_special_tokens = True
            # white space, digits and case are dealt with before the library sees a word
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
            vocabulary = self.words.get_vocab()
            assert max(vocabulary.values()) < 1 << 16
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            for token, i in vocabulary.items():
                self.ends[i] = token.endswith(self.suffix)
        self.known: dict[str, bytes] = {}  # ids of words, and of pieces, which are words by themselves

    @property
    def whole(self):
        """The tokenizer as it is, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return self._whole

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: encoded many to a text, cut again after each word-ending id."""
        texts = [" ".join(pieces[at : at + 100]) for at in range(0, len(pieces), 100)]
        ids = np.array([i for x in self.words.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids], "<u2")
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(pieces):  # a vocabulary without some byte: one at a time
            for p in pieces:
                self.known[p] = np.array(self.words.encode(p, add_special_tokens=False).ids, "<u2").tobytes()
            return
        raw, at = ids.tobytes(), 0
        for p, e in zip(pieces, stop.tolist(), strict=True):
            self.known[p] = raw[2 * at : 2 * e]
            at = e

    def _meet(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if not new:
            return
        if len(self.known) > REMEMBERED:
            self.known, new = {}, words
        known = self.known
        plain = {w for w in new if _PLAIN.fullmatch(w)}
        cut = {w: _SPLIT.findall(w) for w in new.difference(plain)}
        missing = [p for p in plain.union(*cut.values()) if p not in known]
        if missing:
            self._learn(missing)
        for w, parts in cut.items():
            known[w] = b"".join([known[p] for p in parts])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new words of all of them are learnt together."""
        cut = [None if self.words is None or _OTHER.search(t) else t.lower().split() for t in texts]
        self._meet(set().union(*(w for w in cut if w)))
        get = self.known.__getitem__
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, cut, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}
kept(_encoders.clear)


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
