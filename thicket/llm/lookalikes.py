"""Mapping tables behind the one-consistent-form operator, built from the Unicode data of the Python runtime.

All tables are static and small (a few thousand rows whatever the corpus), so broadcasting them is bounded.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

#: Letters of other scripts that are drawn like a Latin letter. Fixed values.
CYRILLIC = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
}
OTHER = {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ք": "p", "ɑ": "a", "ɡ": "g", "ı": "i", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴏ": "o", "ᴄ": "c", "ѡ": "w"}

#: Hyphens that are drawn like the ASCII one (dashes are other punctuation and stay). Fixed values.
HYPHENS = "‐‑‒⁃−﹣－˗"

#: Invisible although not of category Cf.
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(chr(x) for x in range(0xFE00, 0xFE10))

#: Tags of compatibility decompositions whose result looks the same. Superscripts, fractions and circles don't.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>"}


def _ligature(ch: str) -> bool:
    x = ord(ch)
    return 0xFB00 <= x <= 0xFB06 or 0xFB13 <= x <= 0xFB17 or 0x0132 <= x <= 0x0133 or 0x01C4 <= x <= 0x01CC or 0x01F1 <= x <= 0x01F3 or 0x2160 <= x <= 0x217F or x == 0xB5


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in INVISIBLE_EXTRA or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r\f\v\x85")


@functools.cache
def invisible_characters() -> str:
    return "".join(chr(x) for x in range(sys.maxunicode + 1) if _invisible(chr(x)))


def invisible_class() -> str:
    """The invisible characters as the inside of a regular expression's class (Java and Python)."""
    out, chars = [], sorted(map(ord, invisible_characters()))
    i = 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\x{{{chars[i]:X}}}" + (f"-\\x{{{chars[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


def decompose(ch: str, letters: dict[str, str]) -> str:
    """Full decomposition of one character into what it looks like, before recomposition."""
    if _invisible(ch):
        return ""
    if ch in letters:
        return letters[ch]
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp") or ch == "\x85":
        return "\n"
    if ch in HYPHENS:
        return "-"
    d = unicodedata.decomposition(ch)
    if not d:
        return unicodedata.normalize("NFD", ch)  # Hangul
    tag, *rest = d.split() if d.startswith("<") else ("", *d.split())
    if tag and tag not in SAME_LOOK and not _ligature(ch):
        return ch
    return "".join(decompose(chr(int(x, 16)), letters) for x in rest)


#: The letter tables by the script of the word that a character stands in.
CONTEXTS: dict[str, dict[str, str]] = {
    "latin": {**CYRILLIC, **GREEK, **OTHER},
    "cyrillic": {**{v: k for k, v in reversed(CYRILLIC.items())}, **{g: c for g, l in GREEK.items() for c, k in reversed(CYRILLIC.items()) if k == l}},
    "greek": {**{v: k for k, v in reversed(GREEK.items())}, **{c: g for c, l in CYRILLIC.items() for g, k in reversed(GREEK.items()) if k == l}},
}


def native_only(script: str) -> str:
    """Letters of a script that no Latin letter resembles; a word with one of them is a word of that script."""
    lo, hi, table = {"cyrillic": (0x400, 0x52F, CYRILLIC), "greek": (0x386, 0x3FF, GREEK)}[script]
    out = []
    for x in range(lo, hi + 1):
        base = unicodedata.normalize("NFD", chr(x))[0]
        if unicodedata.category(chr(x))[0] == "L" and base not in table:
            out.append(chr(x))
    if script == "greek":  # signs used alone in Latin text: a unit is no word
        out = [c for c in out if c not in "Ωµμπ"]
    return "".join(out)


@functools.cache
def compositions() -> dict[str, str]:
    """base + mark -> composed character, for the primary composites."""
    out = {}
    for x in range(0xC0, sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(x))
        if d and not d.startswith("<") and len(p := d.split()) == 2:
            pair = chr(int(p[0], 16)) + chr(int(p[1], 16))
            if unicodedata.normalize("NFC", pair) == chr(x):
                out[pair] = chr(x)
    return out


@functools.cache
def mapping_rows() -> list[tuple[str, str, list[tuple[str, int]]]]:
    """(context, character, [(character it becomes, combining class)]) for every character that changes.

    ``latin``: a character on its own; the result is already recomposed. ``cluster``: a character with combining
    marks after it; the result is decomposed. ``cyrillic``, ``greek``: a character in a word of that script.
    """
    rows = []
    for x in range(sys.maxunicode + 1):
        if 0xD800 <= x <= 0xDFFF or 0xAC00 <= x <= 0xD7A3:
            continue
        ch = chr(x)
        ccc = unicodedata.combining(ch)
        for ctx in ("latin", "cluster", "cyrillic", "greek"):
            letters = CONTEXTS["latin" if ctx == "cluster" else ctx]
            if x < 128 and ch not in letters and not _invisible(ch):
                continue
            d = decompose(ch, letters)
            if ctx == "latin" and not ccc:
                d = unicodedata.normalize("NFC", d)
            if d != ch or (ccc and ctx != "latin"):
                if ctx in ("cyrillic", "greek") and unicodedata.category(ch)[0] not in "LMC":
                    continue
                rows.append((ctx, ch, [(c, unicodedata.combining(c)) for c in d]))
    return rows


@functools.cache
def single_map() -> dict[int, str]:
    """For str.translate: every character on its own, in Latin context."""
    return {ord(ch): "".join(c for c, _ in out) for ctx, ch, out in mapping_rows() if ctx == "latin"}
