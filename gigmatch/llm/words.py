"""Words of a text, as the pre-tokeniser of the public lower-case word vocabulary cuts them."""

from __future__ import annotations

import os
import re
import unicodedata

import regex

#: Contractions that the vocabulary's pre-tokeniser cuts off, and the end mark of its last pieces.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
END = "</w>"

_LATIN = "a-zß-öø-ÿĀ-įı-ſ"
#: Texts of these characters alone need no Unicode normalisation, and lower-casing changes them one by one.
_PLAIN_TEXT = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿĀ-įı-ňŊ-ž]*")
#: Letters come first, as they are frequent and no contraction begins with one.
_PLAIN_WORD = re.compile(rf"[{_LATIN}]+|{CONTRACTIONS}|[0-9]|[^\s{_LATIN}0-9]+")
_ANY_WORD = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+")


def default_vocabulary() -> str:
    """Path of the lower-case word vocabulary; any file of that format may be given instead."""
    try:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    except ImportError:
        return os.path.join("/opt/tokenizers", "word_bpe_49k.json")


def is_plain(text: str) -> bool:
    return _PLAIN_TEXT.fullmatch(text) is not None and "<|" not in text


def plain_words(text: str) -> list[str]:
    return _PLAIN_WORD.findall(text.lower())


def words(text: str) -> list[str]:
    if is_plain(text):
        return plain_words(text)
    return _ANY_WORD.findall("".join(c.lower() for c in unicodedata.normalize("NFC", text)))


class Numbers(dict):
    """Numbers words in the order of their first lookup; ``new`` lists those not yet dealt with."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number
