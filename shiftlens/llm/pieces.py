"""Splitting text as byte-level tokenizers do, before any merge."""

from __future__ import annotations

import re

import regex

#: Of the first 256 code points, those that \p{L}, \p{N} and \s stand for.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


class Splitter:
    """All matches of a pattern with \\p{L}, \\p{N} and \\s; texts of Latin-1 characters take a faster road."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        # Inside a negated class the names become ranges; elsewhere a class of their own.
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]")
        narrow = inside.replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"\s", f"[{_S}]").replace(r"\S", f"[^{_S}]")
        self.narrow = re.compile(narrow)

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.full.findall(text)
        return self.narrow.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Keys of parts of the text that no match crosses: it is cut before each space that something else than white space
        follows. A key stands for a space and itself, or, after MARK, for the rest of itself; words_of gives its matches."""
        if text.endswith(" ") or _AWKWARD.search(text):
            return [MARK + word for word in self(text)]
        parts = text.split(" ")
        parts[0] = MARK + parts[0]
        return parts

    def words_of(self, key: str) -> list[str]:
        if key.isalpha():  # letters, as \p{L}: one match
            return [" " + key]
        if key[-1:] in _STOPS and key[:-1].isalpha():
            return [" " + key[:-1], key[-1]]
        return self(key_text(key))


#: No text can hold it: texts are valid UTF-8.
MARK = "\ud800"
_STOPS = (",", ".", ";", ":", "!", "?")
#: A space before other white space (or what some engines take for it): there a match may hold several of them.
_AWKWARD = re.compile(" [\t-\r\x1c- \x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def key_text(key: str) -> str:
    return key[1:] if key.startswith(MARK) else " " + key


def word_key(word: str) -> str:
    """The key of a piece that is one word."""
    return word[1:] if word.startswith(" ") else MARK + word
