"""Several values packed in one field: quote-aware split into ordinal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that stand in for structure while a field is taken apart: two private-use code points.
QUOTE, ESCAPED = "\ue000", "\ue001"
#: What separates values outside quotes; a slash only between blanks.
SEPARATOR = r"[,;|，；、\t\r\n]|(?<=\s)/(?=\s)"
#: A quoted value fills the room between two separators; inside it a doubled quote is an escaped one. Blanks around
#: a separator don't matter, whichever comes first: a tab or line end separates anywhere in a run of blanks.
QUOTED = (
    r"((?:^|(?<=[,;|，；、\t\r\n])|(?<=\s/(?=\s)))\s*+)"
    r'(?:"([^"]*+(?:""[^"]*+)*+)"|“([^”]*+)”)'
    r"(?=\s*[\t\r\n]|\s*+(?:$|[,;|，；、])|\s++/\s)"
)
BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(parts: Column) -> Column:
    """Rows (pos, value) of an array of arrays of (pos, value): each array's ordinals go on where the last one's ended."""
    start = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<struct<pos:int,value:string>>)").alias("rows"))
    add = lambda a, rows: F.struct(
        (a["next"] + F.size(rows)).alias("next"),
        F.concat(a["rows"], F.transform(rows, lambda r: F.struct((a["next"] + r["pos"]).alias("pos"), r["value"].alias("value")))).alias("rows"),
    )
    return F.aggregate(parts, start, add, lambda a: a["rows"])


def packed_rows(column: Column | str) -> Column:
    """The values in a field with their ordinals from 0, as ``array<struct<pos:int,value:string>>``; null gives null.

    The field is cut at the quotes that enclose a value. Odd pieces are literals, even pieces are split on
    ``SEPARATOR``. A fold over the pieces reassembles the values that aren't empty and numbers them; it runs over
    groups of as many pieces as there are groups, so a field of n values costs n to the power 1.5 copies at most.
    """
    field = F.col(column) if isinstance(column, str) else column
    field = F.regexp_replace(F.regexp_replace(field, f"[{QUOTE}{ESCAPED}]", " "), BLANK, "")
    field = F.when(field.startswith("[") & field.endswith("]"), F.regexp_replace(field, r"^\[|\]$", "")).otherwise(field)
    field = F.regexp_replace(field, r'\\"', ESCAPED)
    marked = F.regexp_replace(field, QUOTED, f"$1{QUOTE}$2$3{QUOTE}")

    def values(piece: Column, i: Column) -> Column:
        parts = F.when(i % 2 == 1, F.array(F.replace(piece, F.lit('""'), F.lit('"')))).otherwise(F.split(piece, SEPARATOR))
        plain = F.transform(parts, lambda v: F.replace(F.regexp_replace(v, BLANK, ""), F.lit(ESCAPED), F.lit('"')))
        return F.transform(F.filter(plain, lambda v: v != ""), lambda v, at: F.struct(at.alias("pos"), v.alias("value")))

    def reassembled(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        groups = F.transform(F.sequence(F.lit(1), F.size(pieces), width), lambda at: F.slice(pieces, at, width))
        return _fold(F.transform(groups, _fold))

    return F.when(field.isNotNull(), _bound(F.transform(F.split(marked, QUOTE), values), reassembled))


def packed_values(column: Column | str) -> Column:
    """The values in a field, in order, as ``array<string>``; null gives null."""
    return packed_rows(column)["value"]


def unpack(df: DataFrame, column: str, *, keep: list[str], value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per packed value of ``column`` with its position among the field's non-empty values, from 0.

    Separators outside quotes: comma (also the wide ones), semicolon, bar, tab, line end, and a slash between
    blanks. Quotes ("..." or the curly pair) and one pair of square brackets around the whole field are removed,
    doubled or backslashed quotes inside are unescaped, and nothing inside quotes is split.

    Defined cases: null and empty fields and fields of separators only give no row; values repeated in a field
    stay; a quote that doesn't enclose a whole value is an ordinary character; ``keep`` names the columns carried
    along, so other columns can't clash.
    """
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = df.select(*kept, F.explode(packed_rows(column)).alias("_r"))
    return rows.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), F.col("_r.pos").cast("long").alias(pos), F.col("_r.value").alias(value))


def latest_field(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """One row per ``key``: the latest non-null ``column`` by ``order``, ties by the greater value. Null keys form one group."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.btrim(F.col(key), F.lit(" \t")).alias(key))
        .agg(F.max(F.struct(F.col(order).alias("o"), F.col(column).alias("c"))).getField("c").alias(column))
    )
