"""Classification of raw cells: blank kinds, booleans, conservative numbers and unambiguous dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsre import WS, let, trim

#: Fixed values.
NULL_LIKE = ["NULL", "null", "Null", "N/A", "NA", "n/a", "None", "-"]
BOOLEANS = ["true", "false", "yes", "no"]
BOOLEAN_COLUMN = ["true", "false", "yes", "no", "y", "n", "t", "f", "0", "1"]
CURRENCY = "$€£¥₹"
VALUE_TYPES = ["integer", "decimal", "boolean", "date", "datetime", "text"]
WHOLE = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)$"
FRACTION = r"^[+-]?([0-9]+\.[0-9]+|\.[0-9]+|[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+|[0-9]{1,3}(,[0-9]{3})+\.[0-9]+)$"
NUMBER = f"{WHOLE}|{FRACTION}"
GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
DATE = r"^([0-9]{4})(-[0-9]{2}-|/[0-9]{2}/)([0-9]{2})$"
DATETIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}):([0-9]{2})(:([0-9]{2})(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def undecorated(trimmed: Column) -> Column:
    """A number less its percent sign and currency symbols; null if it bears neither."""
    bare = F.regexp_replace(trimmed, f"[{WS}]*%$", "")
    stripped = trim(F.regexp_replace(F.translate(bare, CURRENCY, ""), r"^([+-])\s+", "$1"))
    return F.when(trimmed.rlike(f"[{CURRENCY}]"), stripped).when(trimmed.endswith("%"), bare)


def _parsed(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), F.struct(F.replace(c, F.lit(","), F.lit("")).try_cast("double").alias("value"), c.rlike(WHOLE).alias("whole"), c.rlike(GROUPED).alias("formatted")))


def number(trimmed: Column) -> Column:
    """``struct(value double, whole boolean, formatted boolean)``, or null if the value does not read as a number.

    Values without a digit leave first; plain numbers are read once; what is left may be decorated."""

    def decorated(t: Column) -> Column:
        marked = lambda n: F.when(n.isNotNull(), F.struct(n["value"].alias("value"), (n["whole"] & ~t.endswith("%")).alias("whole"), F.lit(True).alias("formatted")))
        return F.when(t.endswith("%") | t.rlike(f"[{CURRENCY}]"), let(let(undecorated(t), _parsed), marked))

    return F.when(trimmed.rlike("[0-9]"), let(trimmed, lambda t: F.coalesce(_parsed(t), decorated(t))))


def instant(trimmed: Column) -> Column:
    """``struct(at timestamp, has_time boolean)`` of an unambiguous date or date-time (no zone: UTC), else null."""

    def day(t: Column) -> Column:
        return let(F.try_to_date(F.replace(t, F.lit("/"), F.lit("-")), "yyyy-MM-dd"), lambda d: F.when(d.isNotNull(), F.struct(d.cast("timestamp").alias("at"), F.lit(False).alias("has_time"))))

    def stamp(t: Column) -> Column:
        def made(p: Column) -> Column:
            part = lambda k: F.nullif(p[k], F.lit(""))
            fits = F.try_to_date(part(0), "yyyy-MM-dd").isNotNull() & (part(1).cast("int") <= 23) & (part(2).cast("int") <= 59) & (F.coalesce(part(3).cast("int"), F.lit(0)) <= 59)
            at = F.concat(part(0), F.lit("T"), part(1), F.lit(":"), part(2), F.lit(":"), F.coalesce(part(3), F.lit("00")), F.coalesce(F.substring(part(4), 1, 7), F.lit("")), F.coalesce(F.regexp_replace(part(5), r"^([+-]\d\d):?(\d\d)$", "$1:$2"), F.lit("Z")))
            return F.when(fits, let(at.try_cast("timestamp"), lambda x: F.when(x.isNotNull(), F.struct(x.alias("at"), F.lit(True).alias("has_time")))))

        return let(F.array(*[F.regexp_extract(t, DATETIME, k) for k in (1, 2, 3, 5, 6, 7)]), made)

    return let(trimmed, lambda t: F.when(t.rlike(DATE), day(t)).when(t.rlike(DATETIME), stamp(t)))


def _class(raw: Column, trimmed: Column, num: Column, at: Column) -> Column:
    value = F.when(F.lower(trimmed).isin(BOOLEANS), "boolean").when(num.isNotNull(), F.when(num["whole"], "integer").otherwise("decimal")).when(at.isNotNull(), F.when(at["has_time"], "datetime").otherwise("date")).otherwise("text")
    return F.when(raw.isNull() | (raw == ""), "empty").when(trimmed == "", "whitespace").when(trimmed.isin(NULL_LIKE), "null-like").otherwise(value)


def populated(trimmed: Column) -> Column:
    """Whether a trimmed cell holds a value: what its class says, without the parsing."""
    return (trimmed != "") & ~trimmed.isin(NULL_LIKE)


def classified(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with ``trimmed``, ``num``, ``at`` and ``class`` of the cell in ``raw``; a null cell is empty.

    A generator of one row makes them: projections would be merged with what follows, and parse a value for every use."""

    def of(t: Column) -> Column:
        parsed = F.struct(F.col(raw).alias("raw"), t.alias("trimmed"), number(t).alias("num"), F.when(t.rlike("^[0-9]{4}[-/]"), instant(t)).alias("at"))
        return let(parsed, lambda x: F.struct(x["trimmed"].alias("trimmed"), x["num"].alias("num"), x["at"].alias("at"), _class(x["raw"], x["trimmed"], x["num"], x["at"]).alias("class")))

    return df.select("*", F.inline(F.array(let(trim(F.coalesce(F.col(raw), F.lit(""))), of))))


def family(kind: Column) -> Column:
    return F.when(kind.isin("integer", "decimal"), "numeric").when(kind.isin("date", "datetime"), "temporal").when(kind.isin("boolean", "text"), kind)
