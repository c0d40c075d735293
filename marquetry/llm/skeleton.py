"""Problem 4: one form for texts that look alike (confusables skeleton).

A text is decomposed, every character replaced by its prototype from the look-alike table, and
decomposed again; texts with equal skeletons read the same. Accents, case, raised digits and other
letters survive, because they differ to the eye.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marquetry.llm.blocking import TILE_ROWS
from marquetry.llm.tokens import spread
from marquetry.session import Scratch

# Letters of other scripts drawn like a Latin letter, as (letters, prototypes).
LOOK_ALIKES = (
    ("аԁеһіјӏорԛсѕуѵԝх", "adehijlopqcsyvwx"),  # Cyrillic small
    ("АВЕНІЈКМОРЅСТХԌԜУѴ", "ABEHIJKMOPSCTXGWYV"),  # Cyrillic capital
    ("αγινορυϲϳ", "ayivopucj"),  # Greek small
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capital
    ("ոսօհգցք", "nuohqgf"),  # Armenian small
    ("ՍՏՕ", "USO"),  # Armenian capital
    ("ᎠᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏙᏚᏞᏟᏢᏦᏴ", "DTAJEWMHYGZRVSLCPKB"),  # Cherokee
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "HIKMNOPCTYX"),  # Coptic capital
    ("ⲟⲣⲥ", "opc"),  # Coptic small
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɑɡ", "ag"),  # Latin alpha and script g
    ("‐‑﹣－", "----"),  # hyphens
    ("‘’ʼ＇", "''''"),  # apostrophes
)
#: Compatibility forms that keep a visible difference and are therefore not resolved.
KEPT_FORMS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
#: Invisible although Unicode counts them as marks.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class _Prototypes(dict):
    """A str.translate table that works out each character once."""

    def __init__(self) -> None:
        super().__init__({ord(a): b for letters, to in LOOK_ALIKES for a, b in zip(letters, to)})

    def __missing__(self, code: int) -> str:
        char = chr(code)
        category = unicodedata.category(char)
        form = unicodedata.decomposition(char)
        if category == "Cf" or code in INVISIBLE or (category == "Cc" and not char.isspace()):
            out = ""
        elif char.isspace() or category[0] == "Z":
            out = " "
        elif form.startswith("<") and not form.startswith(KEPT_FORMS):
            out = "".join(chr(int(x, 16)) for x in form.split()[1:]).translate(self)
        else:
            out = char
        self[code] = out
        return out


_TABLE = _Prototypes()


def skeleton(text: str | None) -> str | None:
    """The form that all texts share which read like ``text``; null stays null."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(_TABLE).strip()
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE)).strip()


def skeletons(texts: pa.Array) -> pa.Array:
    """``skeleton`` of every text of a batch; plain ASCII never leaves Arrow, other texts are treated once each."""
    ascii_only = pc.string_is_ascii(texts)
    plain = pc.replace_substring_regex(pc.if_else(ascii_only, texts, None), r"[\t-\r\x1c-\x1f]", " ")
    plain = pc.utf8_trim(pc.replace_substring_regex(plain, r"[\x00-\x08\x0e-\x1b\x7f]", ""), " ")
    rest = pc.if_else(ascii_only, None, texts).dictionary_encode()
    formed = pa.array([skeleton(t) for t in rest.dictionary.to_pylist()], texts.type).take(rest.indices)
    return pc.coalesce(plain, formed)


def with_skeletons(df: DataFrame, text: str, out: str, composed: bool = False) -> DataFrame:
    """``df`` with ``out``, the skeleton of ``text`` (``composed``: in its composed form); null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formed = skeletons(batch.column(text))
            if composed:
                formed = pc.utf8_normalize(formed, "NFC")
            yield pa.RecordBatch.from_arrays([*batch.columns, formed], names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def look_alikes(df: DataFrame, key: str, text: str, by: str | None = None) -> DataFrame:
    """Pairs ([by,] key_a, key_b), smaller first, whose texts read the same and differ in characters.

    With ``by`` only rows equal in that column are held together. ``df`` may hold a key with several
    texts, repeated rows, null and empty texts (neither reads like anything: no pair) and any other
    columns. Each text's skeleton is made once. Skeletons with one spelling, however many rows they
    have, leave after a pre-aggregated test; of the rest, rows of one skeleton are cut into groups of
    TILE_ROWS, and every two groups meet in a task of their own.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(by).alias("f") if by else F.lit("").alias("f"), F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    forms = scratch.keep(with_skeletons(spread(rows), "t", "s").where("s <> ''"))
    mixed = forms.groupBy("f", "s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    kept = scratch.keep(forms.join(mixed.select("f", "s", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("g")), ["f", "s"]).distinct().withColumn("spot", F.pmod(F.xxhash64("k"), "g").cast("int")))
    left = kept.select("f", "s", F.col("spot").alias("p"), F.explode(F.sequence("spot", F.col("g") - 1)).alias("q"), F.col("k").alias("k1"), F.col("t").alias("t1"))
    right = kept.select("f", "s", F.explode(F.sequence(F.lit(0), "spot")).alias("p"), F.col("spot").alias("q"), F.col("k").alias("k2"), F.col("t").alias("t2"))
    pairs = left.join(right.hint("shuffle_merge"), ["f", "s", "p", "q"]).where("(p < q or k1 < k2) and k1 <> k2 and t1 <> t2")
    return pairs.select(*([F.col("f").alias(by)] if by else []), F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b")).distinct()
