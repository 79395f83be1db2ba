"""Phone labels: context names and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quinphone(label: Column, pattern: str) -> list[Column]:
    """The five groups of a label pattern; a label that does not match is an error."""
    ok = F.regexp(label, F.lit(pattern))
    return [F.when(ok, F.regexp_extract(label, pattern, i + 1)).otherwise(F.raise_error(F.concat(F.lit("no quinphone: "), label)).cast("string")) for i in range(5)]


def unit_name(ll: Column, l: Column, c: Column, r: Column, rr: Column) -> Column:  # noqa: E741
    return F.concat_ws("/", ll, l, c, r, rr)


def backoff_names(name: Column) -> list[Column]:
    """[quinphone, triphone, diphone, monophone] of a name ll/l/c/r/rr; the diphone looks to the side that the half in
    c's suffix (_L or _R) borders on."""
    part = F.split(name, "/")
    l, c, r = part[1], part[2], part[3]  # noqa: E741
    di = F.when(F.endswith(c, F.lit("_L")), F.concat_ws("/", l, c)).otherwise(F.concat_ws("/", c, r))
    return [name, F.concat_ws("/", l, c, r), di, c]


def monophone(name: Column) -> Column:
    """The phone of a unit name, without its half."""
    return F.split(F.split(name, "/")[2], "_")[0]


def pauses_unified(phone: Column, replace: list[str], by: str = "pau") -> Column:
    return F.when(phone.isin(replace), F.lit(by)).otherwise(phone)


def phone_labels(states: DataFrame, per_phone: int = 5) -> DataFrame:
    """(utt, phone_ix, start, end, label) from state labels (utt, seq, start, end, label)."""
    ix = F.floor(F.col("seq") / per_phone).cast("int")
    return states.groupBy("utt", ix.alias("phone_ix")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", "seq").alias("label"))
