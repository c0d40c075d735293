"""Spelling-independent forms of titles and names: encoding repair, script, accents, case."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from marquetry.llm.skeleton import skeleton

# A letter-by-letter romanisation of Cyrillic.
CYRILLIC = str.maketrans("абвгдежзийклмнопрстуфхцчшщъыьэюяіјѕ", "abvgdejziiklmnoprstufhccss'i'euaijs")
_MARKS = re.compile("[̀-ͯ]")
_MOJIBAKE = re.compile("[ÂÃâãÐÑ].")


def repair(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again (also after lower-casing)."""
    if not _MOJIBAKE.search(text):
        return text
    for candidate in (text, text.replace("ã", "Ã").replace("â", "Â"), text.title() if text.islower() else text):
        for codec in ("cp1252", "latin-1"):
            try:
                return candidate.encode(codec).decode("utf-8")
            except UnicodeError:
                pass
    # some letters only: repair the pairs that decode
    def pair(m: re.Match[str]) -> str:
        try:
            return m.group(0).replace("ã", "Ã").replace("â", "Â").encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group(0)

    return _MOJIBAKE.sub(pair, text)


def plain(text: str | None) -> str:
    """Lower-case Latin letters, digits and punctuation; "" for null."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    text = repair(text).casefold()
    letters = sum("Ѐ" <= c <= "ӿ" for c in text)
    if letters * 2 > sum(c.isalpha() for c in text):
        text = text.translate(CYRILLIC)
    text = skeleton(text) or ""
    text = _MARKS.sub("", unicodedata.normalize("NFD", text)).casefold()
    return text.translate(CYRILLIC)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & masks.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for equal, 0 when either is empty."""
    if a == b:
        return 1.0 if a else 0.0
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def lcs_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_ratio`` of many pairs at once: the bit-parallel rows of all pairs advance together."""
    out = np.zeros(len(a))
    wide = np.array([len(x) > 60 for x in a], bool)
    for i in np.flatnonzero(wide):
        out[i] = lcs_ratio(a[i], b[i])
    some = np.flatnonzero(~wide)
    for part in np.array_split(some, max(1, len(some) // 4096)):
        if not len(part):
            continue
        x, y = np.array([a[i] for i in part], "U"), np.array([b[i] for i in part], "U")
        n, m = np.char.str_len(x), np.char.str_len(y)
        x = np.ascontiguousarray(x).view(np.uint32).reshape(len(part), -1)
        y = np.ascontiguousarray(y).view(np.uint32).reshape(len(part), -1)
        powers = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
        full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        row = full.copy()
        for j in range(y.shape[1]):
            mask = np.where((x == y[:, j : j + 1]) & (y[:, j : j + 1] > 0), powers, np.uint64(0)).sum(1, dtype=np.uint64)
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
        common = n - np.bitwise_count(row)
        out[part] = 2 * common / np.maximum(n + m, 1)
    return out
