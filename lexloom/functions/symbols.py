"""Sentinels of symbol strings. Binary string order puts letters before END before PB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "\U0010fffe"  # end of a chain
PB = "\U0010ffff"  # position break between visible symbols
BOUNDARY = f"[ {PB}{END}]"


def visible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{PB}{END}]", "")


def spelled(c: Column) -> Column:
    """Sentinels in readable form."""
    return F.replace(F.replace(c, F.lit(PB), F.lit("<PB>")), F.lit(END), F.lit("<END>"))


def terminator(phrase: Column) -> Column:
    last = F.right(phrase, F.lit(1))
    return F.when(last == " ", "space").when(last == PB, "pb").otherwise("end")
