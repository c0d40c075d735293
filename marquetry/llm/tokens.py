"""Problem 8: the corpus as token ids, by forced-boundary splitting.

Two bytes that stand beside each other inside no token of the vocabulary can never be merged, so a
text may be cut between them and the fragments encoded on their own. The pair table comes from the
vocabulary itself; a cut is taken only where the pre-tokenizer, too, sees the same on both sides:
between characters, not after white space (whose run it would look beyond) and not before an
apostrophe (which may open a contraction). Fragments recur, so each distinct one is encoded once a
task and looked up ever after.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Distinct fragments remembered by a task; beyond that the memory starts afresh.
MEMO_FRAGMENTS = 200_000
#: Longer fragments are encoded but not remembered.
MEMO_BYTES = 48
#: Bytes of text handled at a time; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class FragmentEncoder:
    """Encodes texts of one vocabulary file, fragment by fragment."""

    def __init__(self, path: str = TOKENIZER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        model = json.loads(Path(path).read_text())
        letters = _byte_letters()
        special = {t["content"] for t in model.get("added_tokens", [])}
        spelled = {i: bytes(letters[c] for c in word) for word, i in model["model"]["vocab"].items() if word not in special}
        self.lengths = np.zeros(max(spelled) + 2, np.int32)
        for i, b in spelled.items():
            self.lengths[i] = len(b)
        joined = [b for b in spelled.values() if len(b) > 1]
        flat = np.frombuffer(b"".join(joined), np.uint8).astype(np.int64)
        ends = np.cumsum([len(b) for b in joined])
        inner = np.ones(len(flat) - 1, bool)
        inner[ends[:-1] - 1] = False
        self.joinable = np.zeros(65536, bool)
        self.joinable[(flat[:-1] * 256 + flat[1:])[inner]] = True
        self.memo: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.memo.clear()
        self.pool, self.starts, self.sizes = [], [], []
        self.filled = 0

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions where a buffer of UTF-8 may be cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        left, right = data[:-1], data[1:]
        free = ~self.joinable[left.astype(np.int64) * 256 + right]
        free &= (right & 0xC0) != 0x80
        free &= right != 0x27
        free &= ~((left <= 32) & ((left >= 28) | ((left >= 9) & (left <= 13))))
        at = np.flatnonzero(free)
        wide = at[left[at] >= 0x80]
        if len(wide):  # blanks of more than one byte
            a, b, c = data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 1, 0)], data[wide]
            blank = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            blank |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
            at = np.setdiff1d(at, wide[blank], assume_unique=True)
        return at + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text); null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = int(offsets[0])
        raw = (texts.buffers()[2] or pa.py_buffer(b""))[base : int(offsets[-1])].to_pybytes()
        offsets = offsets - base
        bounds = np.union1d(self.cuts(np.frombuffer(raw, np.uint8)), offsets)
        edges = bounds.tolist()
        fragments = [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]
        if len(self.memo) > MEMO_FRAGMENTS:
            self._reset()
        fresh = list({f for f in fragments if f not in self.memo})
        lost = []
        if fresh:
            for f, e in zip(fresh, self.tokenizer.encode_batch([f.decode("utf-8") for f in fresh], add_special_tokens=False)):
                self.memo[f] = len(self.starts)
                self.starts.append(self.filled)
                self.sizes.append(len(e.ids))
                self.pool.append(np.array(e.ids, np.int32))
                self.filled += len(e.ids)
                if len(f) > MEMO_BYTES:
                    lost.append(f)
        pool = np.concatenate(self.pool) if self.pool else np.zeros(0, np.int32)
        self.pool = [pool]
        codes = np.array([self.memo[f] for f in fragments], np.int64)
        for f in lost:
            del self.memo[f]
        sizes = np.array(self.sizes, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        starts = np.array(self.starts, np.int64)[codes] if len(codes) else sizes
        filled = np.r_[0, np.cumsum(sizes)]
        ids = pool[np.repeat(starts - filled[:-1], sizes) + np.arange(filled[-1])] if len(codes) else pool[:0]
        if len(pool) > 8 * MEMO_FRAGMENTS:
            self._reset()
        return ids, filled[np.searchsorted(bounds, offsets)] if len(bounds) else np.zeros(len(texts) + 1, np.int64)


_ENCODERS: dict[str, FragmentEncoder] = {}


def encoder(path: str = TOKENIZER) -> FragmentEncoder:
    """The encoder of a vocabulary file, made once a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FragmentEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores; one with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Rows (key, ids array<int>) of every row: the ids of its text without special tokens.

    Null and empty texts have an empty list. Equal to encoding each text whole. Repeated keys give
    a row each; other columns are never read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                ids, offsets = enc.encode(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=[key, "ids"])

    return spread(df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("t"))).mapInArrow(run, f"{key} bigint, ids array<int>")
