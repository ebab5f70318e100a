"""Text helpers: key-value comments, readable numbers, run and config names, ids."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_kv(col: Column, sep: str = ";") -> Column:
    """``a=1;b=2`` as a map; parts without ``=`` are dropped, later keys win."""
    parts = F.filter(F.split(col, sep), lambda p: p.contains("="))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.regexp_replace(p, r"^[^=]*=", "").alias("value"),
        ),
    )
    # keep the last pair of every key, so that repeated keys are no error
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))),
            lambda q: q["key"] == p["key"],
        ),
    )
    return F.map_from_entries(last)


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, its exact binary value rounded half to even as C and Python do.

    ``format_string`` rounds the shortest decimal text half up instead.
    """
    v, half = value.cast("double"), 0.5 / 10**digits
    # the formatter takes this one number, where no digit is kept, for a tie; in binary it is above (or below) one
    nudge = 1.5 if Decimal(half) > Decimal(5).scaleb(-digits - 1) else 1.0
    v = F.when(F.abs(v) == half, v * nudge).otherwise(v)
    return F.call_function("format_number", v, F.lit("0." + "0" * digits))


def fmt_bytes(col: Column) -> Column:
    """Readable size: steps of 1024 from B to PB."""
    n = col.cast("double")
    out = F.concat(fixed(n / 1024.0**5, 1), F.lit(" PB"))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        size = n / 1024.0**i
        out = F.when(size < 1024, F.concat(F.bround(size).cast("long").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def fmt_eta(seconds: Column) -> Column:
    """Remaining time: minutes below an hour, else hours with one decimal."""
    return (
        F.when(seconds.isNull(), "–")
        .when(
            seconds < 3600,
            F.concat(F.lit("~"), F.bround(seconds / 60).cast("long").cast("string"), F.lit(" min")),
        )
        .otherwise(F.concat(F.lit("~"), fixed(seconds / 3600, 1), F.lit(" h")))
    )


def fmt_metric(name: Column, value: Column) -> Column:
    """A metric cell: metres with three digits, precision with two, errors with one."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return (
        F.when(bad, "–")
        .when(name.endswith("transl_err_m"), F.concat(fixed(value, 3), F.lit(" m")))
        .when(name.endswith("map"), fixed(value, 2))
        .otherwise(fixed(value, 1))
    )


def config_of(run: Column) -> Column:
    """Config file of a run: number and seed suffix dropped, ``abl`` prefixes spelled out."""
    name = F.regexp_replace(run, r"-[0-9][0-9][0-9]$", "")
    name = F.regexp_replace(name, r"-s[0-9]$", "")
    name = F.regexp_replace(name, r"^abl-", "ablation-")
    name = F.regexp_replace(name, r"^a-abl-", "a-ablation-")
    return F.concat(F.lit("configs/"), F.translate(name, "-", "_"), F.lit(".yaml"))


def next_run_name(runs: DataFrame, experiment: str, name: str = "run") -> DataFrame:
    """The next free ``<experiment>-NNN``."""
    literal = "".join(f"\\{c}" if not c.isalnum() else c for c in experiment)
    number = F.regexp_extract(F.col(name), f"^{literal}-([0-9]{{3}})$", 1).try_cast("int")
    free = F.coalesce(F.max(number) + 1, F.lit(0))
    return runs.agg(F.concat(F.lit(f"{experiment}-"), F.format_string("%03d", free)).alias(name))


def b64url_to_uuid(col: Column) -> Column:
    """UUID text of a base64url id without padding."""
    plain = F.concat(F.translate(col, "-_", "+/"), F.lit("=="))
    h = F.lower(F.hex(F.unbase64(plain)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


# fixed value: short gender codes
GENDERS = {"m": "male", "f": "female", "n": "neutral"}


def gender(col: Column) -> Column:
    """Spelled-out gender of a code; other values pass through."""
    pairs = [F.lit(x) for item in GENDERS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)
