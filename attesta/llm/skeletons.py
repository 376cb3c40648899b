"""Texts that look the same but differ in their characters.

A text's skeleton is its canonical decomposition with every character replaced by the prototype of the characters that
look like it, decomposed again. Two texts look the same exactly if their skeletons are equal.

Characters that look alike
    Wide forms and ordinary ones, joined letters and separate ones, blanks of any width, Cyrillic and Greek letters
    drawn like Latin ones, and signs encoded twice (ohm, kelvin, angstrom, micro). Characters without a mark of their own
    (zero-width, direction, soft hyphen, variation selectors) vanish. Accents, letter case, raised figures, Greek letters against
    their names, dots and words keep texts apart; so do letters and digits of the ASCII set among themselves.

Defined cases
    NULL stays NULL; a text without a visible character has the skeleton '' and looks like no other text. Texts are
    processed whole. Exact copies are one text. A table without rows gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.durable import durable
from attesta.operators.skew import hot_keys, salted_lookup
from attesta.operators.spread import spread

# Letters of other scripts that are drawn like Latin letters, each followed by its prototype.
LOOK_ALIKE = (
    "аa еe оo рp сc уy хx іi ѕs јj ԁd һh ԛq ԝw ѵv "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԌG ԚQ ԜW ԀD Ӏl "
    "οo νv ϲc ϳj "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "օo սu ոn հh ցg "
    "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
).split()


def _table() -> dict[int, str | None]:
    """Code point to prototype: the listed letters, and what follows from the Unicode properties of a character.

    Wide, narrow and mathematical forms, ligatures and Roman numerals stand for the letters they are made of; raised and
    lowered figures, circled ones and fractions do not look like them.
    """
    out: dict[int, str | None] = {}
    for cp in range(128, sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs" or kind in ("Zl", "Zp"):
            out[cp] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            out[cp] = None
        else:
            d = unicodedata.decomposition(c)
            tag = d.split(" ", 1)[0] if d.startswith("<") else ""
            if tag in ("<wide>", "<narrow>", "<font>") or (tag == "<compat>" and (0xFB00 <= cp <= 0xFB4F or 0x2160 <= cp <= 0x217F)):
                out[cp] = unicodedata.normalize("NFKD", c)
    out |= {ord(x[0]): x[1] for x in LOOK_ALIKE}
    out[0xB5] = "μ"
    for cp in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85):
        out[cp] = " "
    # a prototype has no other prototype
    return {cp: x if x is None else unicodedata.normalize("NFD", x).translate(out) for cp, x in out.items()}


_TABLE: dict[int, str | None] = {}
_ASCII_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def skeleton(text: str) -> str:
    """The form in which exactly the texts that look the same are equal."""
    if text.isascii():
        return text.translate(_ASCII_BLANKS)
    if not _TABLE:
        _TABLE.update(_table())
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def normal_form(text: str) -> str:
    """The skeleton with its accents joined again."""
    return unicodedata.normalize("NFC", skeleton(text))


def _halves(data: str) -> tuple[int, int]:
    h = hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for field, rid, text in zip(pdf["field"], pdf["rid"], pdf["text"]):
            s = skeleton(text)
            if s.strip():
                k = _halves(s)
                rows.append((field, rid, k[0], k[1], _halves(text)[0] if s != text else k[0]))
        yield pd.DataFrame(rows, columns=["field", "rid", "k1", "k2", "exact"]).astype({"rid": "int64", "k1": "int64", "k2": "int64", "exact": "int64"})


def prints(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(field, rid, k1, k2, exact)``: 128 bits of each text's skeleton and 64 of the text itself."""
    cells = spread(df.select(id_col, *[f for f in fields if f != id_col])).select(
        F.col(id_col).cast("bigint").alias("rid"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("c"),
    ).select("c.field", "rid", "c.text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return cells.mapInPandas(_prints, "field string, rid bigint, k1 bigint, k2 bigint, exact bigint")


def _mixed(p: DataFrame) -> DataFrame:
    """The skeletons written in more than one way, one row each."""
    return p.groupBy("field", "k1", "k2").agg(F.min("exact").alias("a"), F.max("exact").alias("b"), F.count("*").alias("n"), F.min("rid").alias("class_id")).where("a <> b")


def classes(p: DataFrame) -> DataFrame:
    """``(field, rid, class_id, exact)``: the rows whose text has another text that looks the same; ``class_id`` is the smallest id."""
    p = p.withColumn("key", F.xxhash64("field", "k1", "k2"))
    mixed = durable(_mixed(p).withColumn("key", F.xxhash64("field", "k1", "k2")))
    m = mixed.select("key", F.col("k2").alias("mk2"), "class_id")
    return salted_lookup(p, m, "key", hot_keys(mixed.select("key", "n"), "key"), "rid").where(F.col("k2") == F.col("mk2")).select("field", "rid", "class_id", "exact")


def pairs(p: DataFrame) -> DataFrame:
    """``(field, first_id, second_id)``: each two rows whose texts look the same and are not the same string.

    The distinct texts of a class meet, and only then the rows of two texts: rows of one text never do, so no pair is made
    that is not a result. The rows of a text that has a large part of all rows are spread over salted parts.
    """
    c = classes(p).select("field", "rid", F.xxhash64("field", "class_id").alias("c"), F.xxhash64("field", "class_id", "exact").alias("t"))
    c = durable(c)
    texts = durable(c.groupBy("c", "t").agg(F.count("*").alias("n")))
    hot = hot_keys(texts, "t")
    met = texts.select("c", "t").join(texts.select("c", F.col("t").alias("t2")), "c").where("t < t2").select("t", "t2")
    one = salted_lookup(c.select("t", "rid", "field"), met, "t", hot, "rid").select("t2", "rid", "field")
    both = salted_lookup(c.select(F.col("t").alias("t2"), F.col("rid").alias("rid2")), one, "t2", hot, "rid2")
    return both.select("field", F.least("rid", "rid2").alias("first_id"), F.greatest("rid", "rid2").alias("second_id"))


def normalised(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(field, rid, form)``: every text in its one form; NULL for NULL."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normal_form(t))

    cells = spread(df.select(id_col, *[f for f in fields if f != id_col])).select(
        F.col(id_col).cast("bigint").alias("rid"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("c"),
    )
    return cells.select("c.field", "rid", form("c.text").alias("form"))
