"""Token ids of whole texts by a public word-level BPE vocabulary, through a cache of pre-tokens.

The vocabulary's pre-tokenizer drops white space, and in text of ASCII and Latin-1 characters it always
cuts between runs of letters, single digits and runs of other signs. Such pieces are looked up in a
cache, or encoded alone the first time; their ids in a row are the text's. Words with any other
character, or an apostrophe, which starts contractions, are encoded whole. All ids come from the
tokenizers library; the cache is bounded and only saves repeated calls.
"""

from __future__ import annotations

import os
import re

import numpy as np

WORD_VOCABULARY = "word_bpe_49k.json"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = rf"{_LETTERS}0-9!-&(-/:-@\[-`{{-~"
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_LOWER_RUN = re.compile(f"[{_LOWER}]+")
_ODD = re.compile(rf"[^\s{_SIMPLE}]")
_ODD_WORD = re.compile(rf"((?<!\S)[{_SIMPLE}]*+[^\s{_SIMPLE}]\S*)")
# Special tokens, and characters that are white space to this module only: the whole text is encoded.
_UNUSUAL = re.compile(r"<\||[\x1c-\x1f]")


class _Cache(dict):
    """Texts to ids. A run of lower-case letters is one pre-token as it stands, so the vocabulary's model gets
    it at once, its bytes spelt as the byte-level alphabet does."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self._tokenizer, self._model, self._most = tokenizer, tokenizer.model, most
        spell = tokenizer.pre_tokenizer.pre_tokenize_str
        self._spelling = {ord(c): "".join(part for part, _ in spell(c)) for c in _LOWER}

    def __missing__(self, text: str) -> bytes:
        if _LOWER_RUN.fullmatch(text):
            ids = [t.id for t in self._model.tokenize(text.translate(self._spelling))]
        else:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        found = np.asarray(ids, "<u4").tobytes()
        if len(text) <= 64:
            if len(self) >= self._most:
                self.clear()
            self[text] = found
        return found


class WordTokens:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str | None = None, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self._look_up = _Cache(
            Tokenizer.from_file(path or public_tokenizers.path(WORD_VOCABULARY)), most
        ).__getitem__

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self._look_up, _PARTS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self._look_up(text)
        if not _ODD.search(text):
            return self._simple(text)
        return b"".join(
            self._look_up(part) if k % 2 else self._simple(part) for k, part in enumerate(_ODD_WORD.split(text))
        )


    def forget(self) -> None:
        self._look_up.__self__.clear()


_LOADED: dict[str | None, WordTokens] = {}


def word_tokens(path: str | None = None) -> WordTokens:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
