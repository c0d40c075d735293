"""Skeletons, token ids, pieces and leaks: round trips and brute force."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquetry.llm import leaks, pieces, skeleton, tokens

DOCS = "doc_id long, text string, ids string, t string"


def test_what_reads_the_same():
    same = ["Tower", "Ｔｏｗｅｒ", "Тоwеr", "T​ower", "‪Tower‬", "Tower ".strip("x"), "To͏wer"]
    assert len({skeleton.skeleton(t) for t in same}) == 1
    assert skeleton.skeleton("é") == skeleton.skeleton("é") != skeleton.skeleton("e")
    assert skeleton.skeleton("ﾊﾞ") == skeleton.skeleton("バ")
    assert skeleton.skeleton("Ⅳ") == skeleton.skeleton("IV")
    for a, b in (("x²", "x2"), ("a", "A"), ("l", "I"), ("n", "m")):
        assert skeleton.skeleton(a) != skeleton.skeleton(b)
    assert skeleton.skeleton(None) is None and skeleton.skeleton("​ ") == ""


def test_look_alike_pairs(spark):
    rows = [(1, "Tower", "x"), (1, "Tower", "x"), (2, "Тower", "x"), (3, "Tower", "x"), (4, None, "x"), (5, "", "x"), (6, "​", "x"), (7, "tower", "x"), (8, "q" * 9000, "x"), (9, "ԛ" + "q" * 8999, "x"), (1, "Tоwer", "x")]
    df = spark.createDataFrame(rows, "pk long, title string, s string")
    assert sorted(tuple(r) for r in skeleton.look_alikes(df, "pk", "title").collect()) == [(1, 2), (1, 3), (2, 3), (8, 9)]
    assert skeleton.look_alikes(spark.createDataFrame([], df.schema), "pk", "title").count() == 0
    forms = {r.pk: r.form for r in skeleton.with_skeletons(df.where("pk in (2, 4)"), "title", "form", composed=True).collect()}
    assert forms == {2: "Tower", 4: None}


ALPHABET = [*"abc'sdlltmrevX. ,!?-\n\t\r 19é字ß—’ 　 \u0085​😀`~\x1c\x0b", "'s", "'ll", "  ", "\n\n", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join) | st.text(max_size=40))
def test_fragments_encode_like_the_whole(text):
    enc = tokens.encoder()
    ids, offsets = enc.encode(pa.array([text, None, "", text]))
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[: offsets[1]].tolist() == want == ids[offsets[3] :].tolist()
    assert offsets[1] == offsets[2] == offsets[3]


def test_token_ids(spark):
    long = "kunxqvanjh" * 40_000
    df = spark.createDataFrame([(1, "Hello world", "a", "b"), (2, None, "a", "b"), (3, "", "a", "b"), (4, long, "a", "b"), (1, "Hello world", "a", "b")], DOCS)
    got = [(r.doc_id, r.ids) for r in tokens.token_ids(df).collect()]
    want = tokens.encoder().tokenizer
    assert sorted(got) == sorted([(1, want.encode("Hello world").ids)] * 2 + [(2, []), (3, []), (4, want.encode(long).ids)])
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_FRAGMENTS", 5)
    enc = tokens.FragmentEncoder()
    for i in range(30):
        text = " ".join(f"word{j}" for j in range(i, i + 9))
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == enc.tokenizer.encode(text).ids


@pytest.mark.parametrize("make", [lambda r: " ".join(r.choice(["alpha", "beta.", "γάμμα", "<li>x", "- item"]) for _ in range(900)), lambda r: "\n\n".join("# Head\n" + "word " * r.randint(1, 400) for _ in range(9)), lambda r: "字" * 1500, lambda r: "x" * 9000, lambda r: "".join(r.choice("bdgkmnpr") + r.choice("aeiou") for _ in range(5000))])
def test_pieces_cover_and_overlap(make):
    enc = tokens.encoder()
    text = make(random.Random(3))
    ids, _ = enc.encode(pa.array([text]))
    ends = np.cumsum(enc.lengths[ids])
    strength = pieces.break_strengths(text.encode(), ends)
    got = pieces.pack(strength, 0, len(ids), 256)
    assert got[0][0] == 0 and got[-1][1] == len(ids)
    assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(0 < b - a <= 256 for a, b in got)
    assert all(strength[a] > 0 for a, _ in got[1:])


def test_headings_come_before_lines():
    enc = tokens.encoder()
    text = "\n".join(["# One", *["a line of text here"] * 10, "# Two", *["another line of text"] * 10])
    ids, _ = enc.encode(pa.array([text]))
    ends = np.cumsum(enc.lengths[ids])
    got = pieces.pack(pieces.break_strengths(text.encode(), ends), 0, len(ids), len(ids) * 2 // 3)
    assert [text.encode()[(ends[a - 1] if a else 0) :][:5] for a, _ in got] == [b"# One", b"# Two"]


def test_split(spark):
    df = spark.createDataFrame([(1, "one two. " * 1500, "a", "b"), (2, None, "a", "b"), (3, "", "a", "b"), (4, "short", "a", "b"), (5, " ", "a", "b")], DOCS)
    rows = pieces.split(df).orderBy("doc_id", "piece_no").collect()
    by = {d: [r for r in rows if r.doc_id == d] for d in range(1, 6)}
    assert [(len(by[d]), by[d][0].n_tokens) for d in (2, 3, 4, 5)] == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert all(r.n_tokens <= 1024 and r.overlap == (64 if r.piece_no else 0) for r in by[1])
    enc = tokens.encoder()
    whole = enc.tokenizer.encode("one two. " * 1500).ids
    assert all(enc.tokenizer.encode(r.piece).ids == whole[r.token_start - r.overlap : r.token_end] for r in by[1])
    assert pieces.split(df, with_text=False).where("piece_no > 0").select("doc_id").distinct().collect()[0][0] == 1
    with pytest.raises(ValueError):
        pieces.split(df, limit=10, overlap=10)


def edited(words: list[str], rng: random.Random, rate: float) -> list[str]:
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, "extra"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return out


def test_leaks_found_and_short_quotes_not(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        filler = [rng.choice(vocabulary) for _ in range(150)]
        i, text = items[d % 20]
        ws = text.split()
        if d % 4 == 0:
            part, hit = edited(ws, rng, 0.12), True
        elif d % 4 == 1:
            part, hit = [w.upper() + "," for w in ws[15:45]], True
        elif d % 4 == 2:
            part, hit = ws[10:24], False
        else:
            part, hit = [], False
        docs.append((d, " ".join([*filler[:70], *part, *filler[70:]]), "a", "b"))
        want |= {(d, i)} if hit else set()
    docs += [(900, None, "a", "b"), (901, "", "a", "b"), (902, "<b>" + "</b> <b>".join(items[3][1].split()) + "</b>", "a", "b"), (902, items[3][1], "a", "b"), (903, "w1 " * 50_000 + items[4][1], "a", "b")]
    want |= {(902, 3), (903, 4)}
    evals = spark.createDataFrame([*items, (50, None), (51, ""), (52, "!!")], "eval_id long, text string")
    got = leaks.leaks(spark.createDataFrame(docs, DOCS), evals)
    assert {(r.doc_id, r.eval_id) for r in got.collect()} == want
    assert got.count() == len(want)
    assert leaks.leaks(spark.createDataFrame([], DOCS), evals).count() == 0
    assert leaks.leaks(spark.createDataFrame(docs, DOCS), evals.where(F.lit(False))).count() == 0


def test_alignment_is_the_dynamic_programme():
    rng = random.Random(1)

    def brute(a, b):
        best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    for _ in range(60):
        a, b = [np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 25))]) for _ in "ab"]
        assert leaks.align(a, b)[1] == brute(a, b)


def test_prototypes_are_those_of_the_public_table(spark):
    spoof = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [(a, b) for text, to in skeleton.LOOK_ALIKES for a, b in zip(text, to)]
    off = [(a, b) for a, b in letters if a != "ӏ" and spoof.getSkeleton(b) not in (spoof.getSkeleton(a), spoof.getSkeleton(unicodedata.normalize("NFKC", a)))]
    assert len(letters) > 120 and not off, off
