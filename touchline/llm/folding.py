"""Folding of disguised spellings to plain lower-case letters, and splitting into passages."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "ս": "u",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    }
)
# Digits and signs used for letters inside words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "£": "l"})

#: The sign of a hidden letter.
HIDDEN = "*"

_BROKEN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{2,}")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_MARKS = re.compile("[̀-ͯ]")
_DISGUISED = re.compile(r"(?<![a-z0-9@$€£*#_])(?=[a-z]+[0-9@$€£*#_]+[a-z]|[0-9@$€£*#_]+[a-z][0-9@$€£*#_]|[0-9@$€£*#_]+[a-z]{2}|[a-z]{2,}[@$*#_])[a-z0-9@$€£*#_]+")
_MASKS = re.compile(r"[*#_]+")
_SPACED = re.compile(r"(?<![a-z0-9*])[a-z*](?:(?: ?[.\-_·] ?| )[a-z*]){2,}(?![a-z0-9*])")
_SEPARATORS = re.compile(r"[ .\-_·]+")
_REPEATS = re.compile(r"([a-z])(?=\1)")
_DIGITS = re.compile(r"[0-9]+")
_HANDLE = re.compile(r"(?<!\S)@[a-z_]+[0-9]+")
_BLANKS = re.compile(r"[^\S\n]+")
_ENDS = re.compile(r"[.!?…¡¿\n]+|[☀-➿\U0001f000-\U0001faff]+")
_OTHER = re.compile(r"[^\w*' ]+")


def _repair(m: re.Match) -> str:
    for codec in ("latin-1", "cp1252"):
        try:
            return m.group().encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return m.group()


def _plain(m: re.Match) -> str:
    word = m.group()
    if sum(c.isdigit() for c in word) > 0.6 * len(word):
        return word
    return _MASKS.sub(HIDDEN, word.translate(LEET))


def fold(text: str) -> str:
    """Repair broken encodings, drop user handles, then fold case, accents, look-alikes, digits for letters, spaced-out words and repeats."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _BROKEN.sub(_repair, text))
        text = _INVISIBLE.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFD", text.lower())).translate(LOOKALIKES)
    text = _BLANKS.sub(" ", text.lower().replace("’", "'"))
    text = _DISGUISED.sub(_plain, _HANDLE.sub(" ", text))
    text = _SPACED.sub(lambda m: _SEPARATORS.sub("", m.group()), text)
    return _DIGITS.sub("0", _REPEATS.sub("", text))


def passages(text: str | None, words: int = 16) -> list[str]:
    """Folded passages of the whole text: between sentence ends, longer ones as windows of `words` words at half steps."""
    out = []
    for part in _ENDS.split(fold(text or "")):
        tokens = _OTHER.sub(" ", part).split()
        if not any(c.isalpha() for t in tokens for c in t):
            continue
        step = words // 2
        for at in range(0, max(1, len(tokens) - step), step) if len(tokens) > words else (0,):
            out.append(" " + " ".join(tokens[at : at + words]) + " ")
    return out
