"""Records that differ only in how their values are written.

Dictionary encoding: every distinct value of a field is canonicalised once and gets an integer identifier; a record
becomes the sorted array of its field-value integers, and equal arrays are copies of one record. Long strings are
shuffled once per distinct value; the records themselves move as integers only.

Defined cases
    NULL, empty and blank values, and values made of marks only, count as absent. A record without any value is no
    copy of anything. Absent agrees with absent. Repeated rows with one id count once. Values of any length are
    treated whole. Other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.durable import durable
from attesta.operators.skew import hot_keys, salted_lookup

_BLANKS = r"[\s\x{85}\x{a0}\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]+"
_DASHES = r"[\x{2010}-\x{2015}\x{2212}\x{fe58}\x{fe63}\x{ff0d}]"


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, _BLANKS, ""), _DASHES, "-"))


def canonical_doi(c: Column) -> Column:
    """The DOI a text names: no blanks, lower case, one kind of dash, nothing before ``10.`` and no marks after the last letter or digit."""
    x = _plain(c)
    doi = F.regexp_extract(x, r"(?:^|[^0-9.])(10\.[0-9]+/.*[0-9a-z])", 1)
    return F.when(doi != "", doi).otherwise(F.regexp_replace(x, r"^[^0-9a-z]+|[^0-9a-z]+$", ""))


def canonical_url(c: Column) -> Column:
    """The address a text names: no blanks, lower case, no marks around it or empty parts at its end, query parts in order."""
    x = F.regexp_replace(_plain(c), r"^[^0-9a-z]+|[^0-9a-z]+$", "")
    cut = F.instr(x, "?")
    query = F.array_join(F.array_sort(F.filter(F.split(F.substr(x, cut + 1), "&"), lambda p: p != "")), "&")
    return F.when(cut > 0, F.concat(F.substr(x, F.lit(1), cut), query)).otherwise(x)


def encode(df: DataFrame, id_col: str, fields: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``(rid, code)`` for each record with at least one value; ``code`` is the sorted array of its field-value integers.

    ``fields`` gives each column's canonical form. Two records have equal codes exactly if all fields agree.
    """
    names = list(fields)
    cells = df.select(
        F.col(id_col).cast("bigint").alias("rid"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).cast("string").alias("raw")) for i, n in enumerate(names)])).alias("cell"),
    ).select("rid", "cell.f", "cell.raw").where(F.col("raw").isNotNull() & (F.trim("raw") != ""))
    # records meet the dictionary on 128 bits of a value, so a long value moves once for each distinct spelling and not once a record
    prints = {"key": F.xxhash64("f", "raw"), "check": F.xxhash64(F.lit(1), "raw", "f")}
    values = cells.groupBy("f", "raw").agg(F.count("*").alias("n")).withColumns(prints)
    form = F.lit(None).cast("string")
    for i, n in enumerate(names):
        form = F.when(F.col("f") == i, fields[n](F.col("raw"))).otherwise(form)
    values = values.withColumn("canon", form).where(F.col("canon") != "")
    ids = durable(values.select("f", "canon").distinct().withColumn("vid", F.monotonically_increasing_id() * len(names) + F.col("f")))
    dictionary = durable(values.join(ids, ["f", "canon"]).select("key", "check", "n", "vid"))
    keyed = cells.withColumns(prints).select("rid", "key", F.col("check").alias("mine"))
    coded = salted_lookup(keyed, dictionary.select("key", "check", "vid"), "key", hot_keys(dictionary, "key"), "rid").where("mine = check")
    return coded.groupBy("rid").agg(F.sort_array(F.collect_set("vid")).alias("code"))


def copies(df: DataFrame, id_col: str, fields: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``(first_id, copy_id)``: one row for each copy other than the one with the smallest id."""
    coded = durable(encode(df, id_col, fields))
    groups = coded.groupBy("code").agg(F.min("rid").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    hot = hot_keys(groups.select("first_id", "n"), "first_id")
    keyed = coded.withColumn("j", F.xxhash64("code"))
    g = groups.withColumn("j", F.xxhash64("code"))
    hot_codes = [r[0] for r in g.where(F.col("first_id").isin(hot)).select("j").collect()] if hot else []
    joined = salted_lookup(keyed, g.select("j", F.col("code").alias("gcode"), "first_id"), "j", hot_codes, "rid")
    return joined.where((F.col("code") == F.col("gcode")) & (F.col("rid") > F.col("first_id"))).select("first_id", F.col("rid").alias("copy_id"))


def collapse(df: DataFrame, id_col: str, fields: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``(first_id, n_copies)``: one row for each distinct record that has a value, with how often it occurs."""
    return encode(df, id_col, fields).groupBy("code").agg(F.min("rid").alias("first_id"), F.count("*").alias("n_copies")).select("first_id", "n_copies")
