"""Problem 10: oversized texts in pieces, by packing their structure tree.

A text's breaks form a tree: headings (by depth), blocks, lines and list items, sentences, words,
characters. Sizes are tokens. Subtrees that fit stay whole; sibling subtrees are merged bottom-up as
long as they fit together; only a node that is too large is descended into. Every piece but the
first begins with the last ``overlap`` tokens of the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.tokens import TOKENIZER, encoder, slices, spread

LIMIT, OVERLAP = 1024, 64
# Strength of a break: 12..7 headings of depth 1..6, then blocks, lines, sentences, words, characters.
HEADING, BLOCK, LINE, SENTENCE, WORD, CHARACTER = 13, 6, 5, 4, 3, 2
_BREAKS = (
    (re.compile(rb"(?m)^(#{1,6})[ \t]"), lambda m: (m.start(), HEADING - len(m.group(1)))),
    (re.compile(rb"(?i)<h([1-6])\b"), lambda m: (m.start(), HEADING - int(m.group(1)))),
    (re.compile(rb"(?m)^(={2,6})[^=\n]+=+[ \t]*$"), lambda m: (m.start(), HEADING - len(m.group(1)))),
    (re.compile(rb"(?:\r?\n[ \t]*){2,}"), lambda m: (m.end(), BLOCK)),
    (re.compile(rb"(?i)<(?:p|div|section|article|ul|ol|table|blockquote)\b"), lambda m: (m.start(), BLOCK)),
    (re.compile(rb"\r?\n"), lambda m: (m.end(), LINE)),
    (re.compile(rb"(?i)<(?:li|tr|br)\b"), lambda m: (m.start(), LINE)),
    (re.compile(rb"[.!?]+[\"')\]]*(?=\s)"), lambda m: (m.end(), SENTENCE)),
    (re.compile("(?:。|！|？|…)+(?:」|』|）)*".encode()), lambda m: (m.end(), SENTENCE)),
    (re.compile(rb"(?<=\S)(?=[ \t])"), lambda m: (m.start(), WORD)),
)


def break_strengths(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Strength of the cut before each token (index 0 unused); 0 inside a character."""
    n = len(ends)
    starts = np.r_[0, ends[:-1]]
    strength = np.zeros(n + 1, np.int8)
    first = np.frombuffer(raw, np.uint8)[np.minimum(starts, max(len(raw) - 1, 0))]
    strength[:n] = np.where((first & 0xC0) != 0x80, CHARACTER, 0)
    for pattern, place in _BREAKS:
        found = [place(m) for m in pattern.finditer(raw)]
        if not found:
            continue
        at, force = np.array(found, np.int64).T
        token = np.searchsorted(starts, at, "left")
        # a break inside a token moves to the next token's start
        np.maximum.at(strength, np.minimum(token, n), np.where(strength[np.minimum(token, n)] > 0, force, 0).astype(np.int8))
    return strength


def pack(strength: np.ndarray, start: int, stop: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most ``limit`` tokens that cover [start, stop), cut at the strongest breaks."""
    done: list[tuple[int, int, int]] = []  # (from, to, parent)
    todo, parents = [(start, stop, HEADING, 0)], 0
    while todo:
        a, b, level, parent = todo.pop()
        if b - a <= limit:
            if done and done[-1][2] == parent and b - done[-1][0] <= limit:
                done[-1] = (done[-1][0], b, parent)
            else:
                done.append((a, b, parent))
            continue
        inner = strength[a + 1 : b]
        level = min(level, int(inner.max()))
        if level <= 0:  # one character of more tokens than a piece may have
            done += [(i, min(i + limit, b), -1) for i in range(a, b, limit)]
            continue
        cuts = a + 1 + np.flatnonzero(inner >= level)
        bounds = [a, *cuts.tolist(), b]
        parents += 1
        todo += [(x, y, level - 1, parents) for x, y in reversed(list(zip(bounds[:-1], bounds[1:])))]
    return [(a, b) for a, b, _ in done]


def split(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER, with_text: bool = True) -> DataFrame:
    """Pieces (key, piece_no, token_start, token_end, overlap, n_tokens[, piece]) of every text.

    A text of at most ``limit`` tokens is one piece without overlap; a null, empty or blank text is
    one piece too (0 tokens for null and empty). Longer texts: each piece holds the ``overlap`` tokens
    before token_start and its own tokens, ``limit`` at most together. ``piece`` is the text those
    tokens spell; where an overlap begins inside a character, that character is left out. Other
    columns are never read; repeated rows give their pieces each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    schema = f"{key} bigint, piece_no int, token_start int, token_end int, overlap int, n_tokens int" + (", piece string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                ids, offsets = enc.encode(part)
                rows, cols, out = [], [], []
                for i in range(b - a):
                    n = int(offsets[i + 1] - offsets[i])
                    if n <= limit:
                        rows.append(i)
                        cols.append((0, 0, n, 0, n))
                        if with_text:
                            out.append(part[i].as_py())
                        continue
                    raw = part[i].as_py().encode()
                    ends = np.cumsum(enc.lengths[ids[offsets[i] : offsets[i + 1]]])
                    for no, (s, e) in enumerate(pack(break_strengths(raw, ends), 0, n, limit - overlap)):
                        begin = max(0, s - overlap)
                        rows.append(i)
                        cols.append((no, s, e, s - begin, e - begin))
                        if with_text:
                            piece = raw[(int(ends[begin - 1]) if begin else 0) : int(ends[e - 1])]
                            out.append(piece.decode("utf-8", "ignore"))
                    if with_text:
                        del raw
                columns = [pa.array(c, pa.int32()) for c in zip(*cols)]
                arrays = [keys.slice(a, b - a).take(pa.array(rows)), *columns] + ([pa.array(out, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return spread(df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("t"))).mapInArrow(run, schema)
