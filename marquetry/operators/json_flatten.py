"""Flat child tables out of nested JSON text, by Arrow buffers and index kernels.

No document is parsed row by row. A batch of bodies is one byte buffer; numpy kernels mark the
quotes, the structural bytes and the scalars, a running sum gives every token its level, and one
sort per batch gives every token the index of the bracket that holds it (its parent). Child records
are then selected by key and ancestry over those parent indexes, their ids gathered from the buffer
by offsets, and the payload's own keys propagated with Arrow ``take``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at a time; one longer body is handled alone.
SLICE_BYTES = 4 << 20
OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR, START = range(9)

_STRUCT = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"{}[]:,"):
    _STRUCT[_c] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Child:
    """A record to emit: objects standing under ``key``, in bodies of ``endpoint``.

    ``parent`` says whose id goes beside them: ``column`` (the payload's own key column), ``owner``
    (the object that has ``key``) or the name of a key (the nearest enclosing object under that key).
    ``within`` asks for an ancestor under that key, however far up.
    """

    kind: str
    endpoint: str
    key: str
    parent: str
    within: str | None = None


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of a byte buffer as one string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def parents_of(level: np.ndarray, is_open: np.ndarray) -> np.ndarray:
    """For every token the index of the open bracket that holds it, -1 at the top."""
    n = len(level)
    opens = np.flatnonzero(is_open)
    rank = np.concatenate([level[opens] + 1, level])
    index = np.concatenate([opens, np.arange(n)])
    heading = np.concatenate([np.ones(len(opens), bool), np.zeros(n, bool)])
    order = np.lexsort((~heading, index, rank))
    index, heading = index[order], heading[order]
    last = np.maximum.accumulate(np.where(heading, np.arange(len(order)), -1))
    parent = np.full(n, -1, np.int64)
    member = ~heading
    held = np.where(last[member] >= 0, index[np.maximum(last[member], 0)], -1)
    parent[index[member]] = held
    parent[level == 0] = -1
    return parent


class Tokens:
    """Tokens of a batch of bodies; only those of whole JSON documents remain."""

    def __init__(self, bodies: pa.Array):
        joined = pc.binary_join_element_wise(bodies, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        self.data, self.ok = data, np.ones(len(bodies), bool)
        quote = data == 34
        slashes = np.flatnonzero(data == 92)
        if len(slashes):
            breaks = np.diff(slashes) != 1
            first, last = slashes[np.r_[True, breaks]], slashes[np.r_[breaks, True]]
            quote[last[(last - first) % 2 == 0] + 1] = False
        odd = np.flatnonzero(np.add.reduceat(quote, offsets[:-1], dtype=np.int64) % 2) if len(bodies) else []
        for d in odd:
            quote[offsets[d] : offsets[d + 1]] = False
        self.ok[odd] = False
        inside = np.cumsum(quote, dtype=np.int64) % 2 == 1
        struct = np.where(inside | quote, 255, _STRUCT[data])
        at = np.flatnonzero(struct != 255)
        open_quote, close_quote = np.flatnonzero(quote & inside), np.flatnonzero(quote & ~inside)
        plain = ~(inside | quote | _SPACE[data] | (struct != 255))
        edge = np.diff(np.r_[False, plain, False].astype(np.int8))
        run, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        pos = np.concatenate([at, open_quote, run])
        end = np.concatenate([at + 1, close_quote, stop])
        kind = np.concatenate([struct[at], np.full(len(open_quote), STRING), np.full(len(run), SCALAR)]).astype(np.uint8)
        order = np.argsort(pos, kind="stable")
        pos, end, kind = pos[order], end[order], kind[order]
        doc = np.searchsorted(offsets, pos, "right") - 1
        keep = self.ok[doc]
        pos, end, kind, doc = pos[keep], end[keep], kind[keep], doc[keep]
        level = self._levels(kind, doc, len(bodies))
        keep = self.ok[doc]
        self.pos, self.end, self.kind, self.doc, self.level = pos[keep], end[keep], kind[keep], doc[keep], level[keep]
        self.is_open = (self.kind == OPEN_OBJ) | (self.kind == OPEN_ARR)
        self.parent = parents_of(self.level, self.is_open)
        self._grammar()

    def _levels(self, kind: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Levels within each document; documents whose brackets don't balance are refused."""
        if not len(kind):
            self.ok[:] = False
            return np.zeros(0, np.int64)
        opens = (kind == OPEN_OBJ) | (kind == OPEN_ARR)
        step = opens.astype(np.int64) - ((kind == CLOSE_OBJ) | (kind == CLOSE_ARR))
        total = np.cumsum(step)
        starts = np.flatnonzero(np.r_[True, np.diff(doc) != 0])
        base = np.repeat(total[starts] - step[starts], np.diff(np.r_[starts, len(doc)]))
        level = total - step - base
        after = total - base
        bad = np.ones(docs, bool)
        here = doc[starts]
        ends = np.r_[starts[1:], len(doc)] - 1
        tops = np.add.reduceat((level == 0).astype(np.int64), starts)
        bad[here] = (after[ends] != 0) | (np.minimum.reduceat(np.minimum(level, after), starts) < 0) | (tops != 1)
        self.ok &= ~bad
        return level

    def _grammar(self) -> None:
        kind, parent, doc = self.kind, self.parent, self.doc
        n = len(kind)
        if not n:
            return
        prev = np.r_[START, kind[:-1]]
        prev[np.r_[True, np.diff(doc) != 0]] = START
        prev2 = np.r_[START, prev[:-1]]
        following = np.r_[kind[1:], START]
        following[np.r_[np.diff(doc) != 0, True]] = START
        holder = np.where(parent >= 0, kind[np.maximum(parent, 0)], START)
        value = (kind == STRING) | (kind == SCALAR) | self.is_open
        begins = (prev == OPEN_OBJ) | (prev == COMMA)
        self.is_key = (kind == STRING) & (holder == OPEN_OBJ) & begins
        close = (kind == CLOSE_OBJ) | (kind == CLOSE_ARR)
        ended = (prev == STRING) | (prev == SCALAR) | (prev == CLOSE_OBJ) | (prev == CLOSE_ARR)
        good = np.ones(n, bool)
        good &= ~(self.is_key & (following != COLON))
        good &= ~(value & ~self.is_key & (holder == OPEN_OBJ) & (prev != COLON))
        good &= ~(value & (holder == OPEN_ARR) & (prev != OPEN_ARR) & (prev != COMMA))
        good &= ~((kind == COLON) & ~((holder == OPEN_OBJ) & (prev == STRING) & ((prev2 == OPEN_OBJ) | (prev2 == COMMA))))
        good &= ~((kind == COMMA) & ~ended)
        good &= ~(close & ~(ended | (prev == holder)))
        good &= ~(close & (kind - 1 != holder))
        scalars = np.flatnonzero(kind == SCALAR)
        if len(scalars):
            text = gather(self.data, self.pos[scalars], self.end[scalars])
            fits = pc.or_(pc.match_substring_regex(text, _NUMBER), pc.is_in(text, pa.array(["true", "false", "null"], pa.large_string())))
            good[scalars] &= fits.to_numpy(zero_copy_only=False)
        self.ok[doc[~good]] = False
        self.is_value = value & ~self.is_key

    def strings(self, tokens: np.ndarray) -> pa.Array:
        """Text of string and scalar tokens; escapes resolved where there are any."""
        start = self.pos[tokens] + (self.kind[tokens] == STRING)
        text = gather(self.data, start, self.end[tokens])
        marked = pc.match_substring(text, "\\").to_numpy(zero_copy_only=False)
        if not marked.any():
            return text
        values = text.to_pylist()
        for i in np.flatnonzero(marked):
            try:
                values[i] = json.loads(f'"{values[i]}"', strict=False).encode("utf-8", "replace").decode("utf-8")
            except ValueError:
                pass
        return pa.array(values, pa.large_string())


def _unwrap(bodies: pa.Array, tokens: Tokens) -> tuple[np.ndarray, list[str]]:
    """Documents holding JSON inside a string, and their text with that string spliced in."""
    candidate = np.flatnonzero((tokens.kind == STRING) & tokens.is_value & tokens.ok[tokens.doc]) if len(tokens.kind) else np.zeros(0, np.int64)
    first = tokens.data[np.minimum(tokens.pos[candidate] + 1, len(tokens.data) - 1)]
    candidate = candidate[np.isin(first, np.frombuffer(b"{[ \\\xef", np.uint8)) & (tokens.end[candidate] - tokens.pos[candidate] > 2)]
    inner = pc.utf8_trim(tokens.strings(candidate), " \t\r\n\ufeff")
    # a string in a string, too, when brackets stand in it
    opens = pc.match_substring_regex(inner, r'^(?:[\[{]|"[^\[{]*[\[{])').to_numpy(zero_copy_only=False)
    candidate, inner = candidate[opens], inner.filter(pa.array(opens))
    whole = Tokens(inner).ok if len(inner) else np.zeros(0, bool)
    cuts: dict[int, list[tuple[int, int, str]]] = {}
    for t, text in zip(candidate[whole], inner.filter(pa.array(whole)).to_pylist()):
        cuts.setdefault(int(tokens.doc[t]), []).append((int(tokens.pos[t]), int(tokens.end[t]) + 1, text))
    if not cuts:
        return np.zeros(0, np.int64), []
    lengths = np.r_[0, np.cumsum(np.asarray(pc.binary_length(bodies)) + 1)]
    texts = []
    for d in sorted(cuts):
        begin, stop, parts = int(lengths[d]), int(lengths[d + 1]) - 1, []
        for s, e, text in cuts[d]:
            parts += [tokens.data[begin:s].tobytes(), text.encode()]
            begin = e
        texts.append(b"".join([*parts, tokens.data[begin:stop].tobytes()]).decode("utf-8", "replace"))
    return np.array(sorted(cuts), np.int64), texts


def _flatten(bodies: pa.Array, endpoints: pa.Array, own: pa.Array, children: list[Child]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """(row, kind, parent id, child id) arrays of a batch; row counts within the batch.

    Documents that hold JSON inside strings are opened and come round again until none is left to open;
    each round takes quotes and escapes away, so the rounds end.
    """
    rows = np.arange(len(bodies))
    while len(bodies):
        tokens = Tokens(bodies)
        again, texts = _unwrap(bodies, tokens)
        tokens.ok[again] = False
        for row, *rest in _children(tokens, endpoints, own, children):
            yield rows[row], *rest
        taken = pa.array(again)
        rows, bodies, endpoints, own = rows[again], pa.array(texts, pa.large_string()), endpoints.take(taken), own.take(taken)


def _children(tokens: Tokens, endpoints: pa.Array, own: pa.Array, children: list[Child]) -> list[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """(row, kind, parent id, child id) arrays of documents in which nothing is left to open."""
    out: list[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]] = []
    if not len(tokens.kind) or not tokens.ok.any():
        return out
    kind, parent, level, n = tokens.kind, tokens.parent, tokens.level, len(tokens.kind)
    # every value's key, as a code; keys that are only digits stand for list positions
    keyed = np.flatnonzero(tokens.is_value & (np.r_[START, kind[:-1]] == COLON) & (level > 0))
    names = tokens.strings(keyed - 2).dictionary_encode()
    words = names.dictionary.to_pylist()
    code = np.full(n, -1, np.int64)
    place = np.array([w.isdigit() for w in words] or [False])
    codes = names.indices.to_numpy()
    code[keyed] = np.where(place[codes], -1, codes) if len(keyed) else codes
    of = {w: i for i, w in enumerate(words)}
    nodes = np.flatnonzero(tokens.is_open)
    wanted = {c.key for c in children} | {c.within for c in children if c.within} | {c.parent for c in children if c.parent not in ("column", "owner")}
    effective, owner = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    nearest = {w: np.full(n, -1, np.int64) for w in wanted if w in of}
    by_level = nodes[np.argsort(level[nodes], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, np.diff(level[by_level]) != 0, True]) if len(by_level) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        v = by_level[a:b]
        up = parent[v]
        known = up >= 0
        held = np.maximum(up, 0)
        effective[v] = np.where(code[v] >= 0, code[v], np.where(known, effective[held], -1))
        owner[v] = np.where(code[v] >= 0, up, np.where(known, owner[held], -1))
        for w, near in nearest.items():
            near[v] = np.where(effective[v] == of[w], v, np.where(known, near[held], -1))
    # the last usable id of every object
    ids = np.full(n, -1, np.int64)
    if "id" in of:
        own_id = keyed[code[keyed] == of["id"]]
        own_id = own_id[(kind[own_id] == STRING) | (kind[own_id] == SCALAR)]
        ids[parent[own_id]] = own_id

    def id_text(objects: np.ndarray) -> pa.Array:
        at = ids[objects]
        text = tokens.strings(np.maximum(at, 0))
        word = pc.and_(pc.is_in(text, pa.array(["true", "false", "null"], pa.large_string())), pa.array(kind[np.maximum(at, 0)] == SCALAR))
        text = pc.utf8_trim_whitespace(text)
        usable = pc.and_(pc.and_(pa.array((objects >= 0) & (at >= 0)), pc.invert(word)), pc.not_equal(text, ""))
        return pc.if_else(usable, text, pa.scalar(None, pa.large_string()))

    objects = nodes[(kind[nodes] == OPEN_OBJ) & tokens.ok[tokens.doc[nodes]]]
    for child in children:
        if child.key not in of or (child.within and child.within not in of):
            continue
        hit = objects[effective[objects] == of[child.key]]
        hit = hit[pc.equal(endpoints.take(pa.array(tokens.doc[hit])), child.endpoint).fill_null(False).to_numpy(zero_copy_only=False)] if len(hit) else hit
        if child.within:
            hit = hit[nearest[child.within][hit] >= 0]
        if not len(hit):
            continue
        rows = tokens.doc[hit]
        if child.parent == "column":
            above = own.take(pa.array(rows))
        elif child.parent == "owner":
            above = id_text(owner[hit])
        elif child.parent in of:
            above = id_text(nearest[child.parent][hit])
        else:
            continue
        below = id_text(hit)
        keep = pc.and_(pc.is_valid(above), pc.is_valid(below))
        chosen = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
        take = pa.array(chosen)
        out.append((rows[chosen], pa.array([child.kind] * len(chosen), pa.large_string()), above.take(take), below.take(take)))
    return out


def flatten(df: DataFrame, children: list[Child], key: str = "payload_id", body: str = "body", endpoint: str = "endpoint", own: str = "request_key") -> DataFrame:
    """Rows (key, rec_kind, parent_id, child_id) of the child records in JSON text column ``body``.

    Distinct rows. Ids are trimmed text; an object without an id (none, null or blank), or whose
    parent has none, gives no row. A null, empty or incomplete body, or one that is not JSON, gives
    none; a byte-order mark is allowed, and JSON written as a string inside JSON is opened wherever
    it stands. A lone object counts as a list of one, and an object keyed by numbers as a list.
    Other columns of ``df`` are never read. An empty table gives no rows.
    """
    schema = f"{key} bigint, rec_kind string, parent_id string, child_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            points = pc.utf8_lower(pc.utf8_trim_whitespace(batch.column(1).cast(pa.large_string())))
            owns = pc.utf8_trim_whitespace(batch.column(2).cast(pa.large_string()))
            owns = pc.if_else(pc.equal(owns, ""), pa.scalar(None, pa.large_string()), owns)
            texts = pc.replace_substring_regex(batch.column(3).cast(pa.large_string()).fill_null(""), "^﻿+", "")
            ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
            start = 0
            while start < len(batch):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
                size = stop - start
                part = pc.if_else(pa.scalar(True), texts.slice(start, size), texts.slice(start, size))
                for row, kinds, above, below in _flatten(part, points.slice(start, size), owns.slice(start, size), children):
                    yield pa.RecordBatch.from_arrays([keys.slice(start, size).take(pa.array(row)), kinds.cast(pa.string()), above.cast(pa.string()), below.cast(pa.string())], names=[key, "rec_kind", "parent_id", "child_id"])
                start = stop

    picked = df.select(df[key].cast("bigint").alias(key), df[endpoint].cast("string").alias("e"), df[own].cast("string").alias("o"), df[body].cast("string").alias("b"))
    return picked.where("b is not null and b <> ''").mapInArrow(run, schema).distinct()
