"""Problem 9: evaluation texts inside training texts, in spite of edits.

Texts become word codes. Windows sized by the item walk through a CGK embedding (Chakraborty, Goldenberg,
Koucký, 2016): a cursor emits the word under it at every step and moves on by a random bit of step and
word, so two windows within a few word edits emit the same words at most steps. Repeated bit-sampling
LSH buckets the emitted words; windows that share a bucket with an item's are candidates, and an exact
alignment of words decides. Windows start at every word of every document and item.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.skeleton import skeleton
from marquetry.llm.tokens import slices, spread
from marquetry.session import Scratch

#: Share of an item's words that must stand in a row.
LEAK_SHARE = 1 / 3
#: Sizes of windows: an item's is the largest that fits into the part of its shortest passage below.
WINDOWS = (*range(1, 11), 13, 17, 22, 29, 38, 50, 65)
#: Share of the shortest passage that a window takes, so that several start in it; ten words fit anyway.
WINDOW_SHARE, SHORT_PASSAGE = 0.6, 10
#: Independent walks, sampled bucket keys of each, steps sampled for a key.
WALKS, KEYS, SAMPLED = 4, 4, 5
#: Words of a window that a candidate must share with the item's window before it is aligned.
SHARED = 0.6
#: Alignment score (equal words less edits) that a passage has a word at least.
LIKENESS = 0.3
#: Words of a passage that must stand within DRIFT words of a hit's diagonal before it is aligned.
DENSE, DRIFT = 0.65, 6
#: Evaluation items handled in one pass over the documents.
BLOCK_ITEMS = 5_000
_TAG = re.compile(r"<[^<>]{1,200}>")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_ACCENTS = re.compile("[̀-ͯ]")


def words(text: str | None) -> list[str]:
    """Words as compared: no markup, entities, accents, look-alikes, invisible characters or case."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        lines = re.sub(r"\s", " ", text)
        text = _ACCENTS.sub("", skeleton(lines) or "").casefold()
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


def window_of(n_words: int, share: float = LEAK_SHARE) -> int:
    """Words of the windows of an item of ``n_words``."""
    passage = max(1, int(np.ceil(n_words * share)))
    room = max(min(passage, SHORT_PASSAGE), int(passage * WINDOW_SHARE))
    return max(w for w in WINDOWS if w <= room)


@dataclass
class Index:
    """Bucket keys of a block of items."""

    window: int
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    ids: list[int]
    keys: list[np.ndarray] = field(default_factory=list)  # per table: sorted keys
    where: list[np.ndarray] = field(default_factory=list)  # per table: positions in the flat items
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    steps: list[list[np.ndarray]] = field(default_factory=list)


def _pad(window: int) -> int:
    return 2 * window + 2


def build(items: list[tuple[int, list[str]]], window: int, seed: int = 9) -> Index:
    """Index of items (id, words), all of ``window`` words or more."""
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32) for _, ws in items]
    out = Index(window, vocabulary, coded, [i for i, _ in items])
    rng = np.random.default_rng(seed)
    length = max(1, 2 * window - 4)
    out.bits = rng.integers(0, 2, (WALKS, length, len(vocabulary) + 1), dtype=np.int8)
    # early steps are reached before most edits, later ones tell windows apart
    out.steps = [[np.sort(rng.choice(length, min(SAMPLED, length), replace=False)) for _ in range(KEYS)] for _ in range(WALKS)]
    blank = np.zeros(_pad(window), np.int32)
    out.flat = np.concatenate([x for c in coded for x in (c, blank)]) if coded else blank
    out.offset = np.cumsum([0, *[len(c) + len(blank) for c in coded]])
    starts = np.concatenate([np.arange(len(c) - window + 1) + o for c, o in zip(coded, out.offset)]) if coded else np.zeros(0, np.int64)
    out.owner = (np.searchsorted(out.offset, np.arange(len(out.flat)), "right") - 1).astype(np.int32)
    for key in buckets(out, out.flat, starts):
        order = np.argsort(key, kind="stable")
        out.keys.append(key[order])
        out.where.append(starts[order])
    return out


def buckets(index: Index, codes: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """One array of bucket keys per table, for the windows at ``starts``."""
    for walk in range(WALKS):
        pos = starts.copy()
        keys = [np.zeros(len(starts), np.uint64) for _ in range(KEYS)]
        last = max(int(s[-1]) for s in index.steps[walk])
        for step in range(last + 1):
            here = codes[pos]
            for key, sampled in zip(keys, index.steps[walk]):
                if step in sampled:
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key += here.astype(np.uint64) + np.uint64(step)
                    key ^= key >> np.uint64(29)
            pos += index.bits[walk, step][here]
        yield from keys


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(item words spanned, of them equal) by the best local alignment: +1 equal, -1 an edit."""

    def sweep(a: np.ndarray, b: np.ndarray, floor: bool) -> tuple[int, int, int]:
        n = len(a)
        ramp = np.arange(n + 1)
        row = np.zeros(n + 1, np.int64) if floor else -ramp
        best = (0, 0, 0)
        for j, w in enumerate(b):
            fresh = np.empty(n + 1, np.int64)
            fresh[0] = 0 if floor else -(j + 1)
            fresh[1:] = np.maximum(row[:-1] + np.where(a == w, 1, -1), row[1:] - 1)
            if floor:
                np.maximum(fresh, 0, out=fresh)
            fresh = np.maximum.accumulate(fresh + ramp) - ramp
            top = int(fresh.argmax())
            if fresh[top] > best[0]:
                best = (int(fresh[top]), top, j + 1)
            row = fresh
        return best

    score, i, j = sweep(item, text, True)
    if not score:
        return 0, 0
    _, back, _ = sweep(item[:i][::-1], text[:j][::-1], False)
    return back, score


def dense(index: Index, codes: np.ndarray, bounds: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, share: float) -> np.ndarray:
    """Which hits have DENSE of the words of some ``share`` of their item near the hit's diagonal.

    An accepted passage has more equal words than edits by LIKENESS of its words, so at least
    (1 + LIKENESS) / 2 = DENSE of them are equal; they stand near the diagonal unless more than DRIFT
    words were added or left out on balance.
    """
    out = np.zeros(len(p), bool)
    lengths = np.array([len(x) for x in index.items])
    for a in range(0, len(p), 4096):
        part = slice(a, a + 4096)
        owner = index.owner[q[part]]
        n, begin = lengths[owner], index.offset[owner]
        at = np.arange(int(n.max()))
        item = index.flat[np.minimum(begin[:, None] + at, len(index.flat) - 1)]
        inside = at < n[:, None]
        spot = p[part, None] - q[part, None] + begin[:, None] + at
        low, high = bounds[doc[part]][:, None], bounds[doc[part] + 1][:, None]
        match = np.zeros(item.shape, bool)
        for shift in range(-DRIFT, DRIFT + 1):
            there = spot + shift
            match |= (codes[np.clip(there, 0, len(codes) - 1)] == item) & (there >= low) & (there < high)
        total = np.concatenate([np.zeros((len(owner), 1), np.int64), np.cumsum(match & inside, 1)], 1)
        run = np.ceil(n * share).astype(np.int64)
        stop = np.minimum(np.arange(total.shape[1]), n[:, None])
        inner = total - np.take_along_axis(total, np.maximum(stop - run[:, None], 0), 1)
        out[part] = inner.max(1) >= np.ceil(DENSE * run)
    return out


def search(index: Index, docs: list[list[str]], share: float = LEAK_SHARE) -> list[tuple[int, int, int, int, int]]:
    """(document, item, words spanned, alignment score, words of the item) of all candidates."""
    w, lookup = index.window, index.vocabulary
    blank = [0] * _pad(w)
    flat: list[int] = []
    offset = [0]
    for ws in docs:
        flat += [lookup.get(x, 0) for x in ws]
        flat += blank
        offset.append(len(flat))
    codes, bounds = np.array(flat, np.int32), np.array(offset)
    doc = np.repeat(np.arange(len(docs)), np.diff(bounds))
    known = np.cumsum(np.r_[0, codes > 0])
    starts = np.arange(max(0, len(codes) - _pad(w)))
    starts = starts[(starts + w <= bounds[doc[starts] + 1] - _pad(w))]
    starts = starts[known[starts + w] - known[starts] >= int(np.ceil(SHARED * w))]
    found: list[np.ndarray] = []
    for t, key in enumerate(buckets(index, codes, starts)):
        lo = np.searchsorted(index.keys[t], key, "left")
        hi = np.searchsorted(index.keys[t], key, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        many = hi[hit] - lo[hit]
        p = np.repeat(starts[hit], many)
        begin = np.repeat(lo[hit] - np.r_[0, np.cumsum(many)[:-1]], many)
        q = index.where[t][begin + np.arange(many.sum())]
        found.append(p * len(index.flat) + q)
    if not found:
        return []
    p, q = np.divmod(np.unique(np.concatenate(found)), len(index.flat))
    near = index.flat[np.maximum(q[:, None] + np.arange(-2, w + 3), 0)]
    mine = codes[p[:, None] + np.arange(w)]
    equal = np.zeros(len(p), np.int64)
    for c in range(w):
        equal += ((mine[:, c : c + 1] == near) & (mine[:, c : c + 1] > 0)).any(1)
    keep = equal >= np.ceil(SHARED * w)
    p, q = p[keep], q[keep]
    keep = dense(index, codes, bounds, doc[p], p, q, share)
    p, q = p[keep], q[keep]
    both = np.stack([doc[p], index.owner[q]], 1)
    out = []
    order = np.lexsort((p, both[:, 1], both[:, 0]))
    both, p = both[order], p[order]
    edges = np.flatnonzero(np.r_[True, (np.diff(both, axis=0) != 0).any(1), True]) if len(p) else []
    for a, b in zip(edges[:-1], edges[1:]):
        d, i = both[a]
        item = index.items[i]
        reach = len(item) + 16
        best = (0, 0)
        # hits far apart are aligned apart: a text may be much longer than the item
        for group in np.split(p[a:b], np.flatnonzero(np.diff(p[a:b]) > 2 * reach) + 1):
            text = codes[max(bounds[d], group[0] - reach) : min(bounds[d + 1], group[-1] + w + reach)]
            best = max(best, align(item, text))
        out.append((int(d), index.ids[i], best[0], best[1], len(item)))
    return out


def leaks(df: DataFrame, evals: DataFrame, key: str = "doc_id", text: str = "text", eval_key: str = "eval_id", eval_text: str = "text", share: float = LEAK_SHARE) -> DataFrame:
    """Rows (key, eval_key, spanned, n_words) of the texts that hold an item or ``share`` of it in a row.

    ``spanned`` is how many of the item's ``n_words`` the aligned passage covers; single words in it
    may be changed, added or left out. Null, empty and wordless texts and items leak nothing; repeated
    rows give one row each pair. Items are divided by hash into blocks of about BLOCK_ITEMS (a table of
    a few hundred is one block), and each block is a pass of its own over the documents, which are
    never shuffled: only one block's items are with the driver and the tasks at a time.
    """
    asked = evals.select(F.col(eval_key).cast("bigint").alias("i"), F.col(eval_text).cast("string").alias("t")).where("i is not null and t <> ''").distinct()
    picked = spread(df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("t")).where("t <> ''"))
    scratch = Scratch(df.sparkSession)
    blocks = -(-asked.count() // BLOCK_ITEMS)
    if blocks > 1:
        asked = scratch.keep(asked)
    passes = []
    for number in range(max(blocks, 1)):
        rows = asked if blocks <= 1 else asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number)
        found = _pass(picked, [(r.i, ws) for r in rows.collect() if (ws := words(r.t))], key, eval_key, share)
        passes.append(found if blocks <= 1 else scratch.keep(found))
    found = functools.reduce(DataFrame.unionByName, passes)
    return found.groupBy(key, eval_key).agg(F.max("spanned").alias("spanned"), F.max("n_words").alias("n_words"))


def _pass(docs: DataFrame, items: list[tuple[int, list[str]]], key: str, eval_key: str, share: float) -> DataFrame:
    """Hits of one block of items (id, words) in documents (key, t)."""
    by_window: dict[int, list[tuple[int, list[str]]]] = {}
    for item, ws in sorted(items):
        by_window.setdefault(window_of(len(ws), share), []).append((item, ws))
    groups = sorted(by_window.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [build(part, window) for window, part in groups]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                found = [words(t) for t in texts.slice(a, b - a).to_pylist()]
                for index in indexes:
                    hits = [hit for hit in search(index, found, share) if hit[2] >= share * hit[4] and hit[3] >= LIKENESS * hit[2]]
                    if hits:
                        rows, ids, spans, _, n = zip(*hits)
                        yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(rows)), pa.array(ids, pa.int64()), pa.array(spans, pa.int32()), pa.array(n, pa.int32())], names=[key, eval_key, "spanned", "n_words"])

    return docs.mapInArrow(run, f"{key} bigint, {eval_key} bigint, spanned int, n_words int")
