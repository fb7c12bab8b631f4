"""Text and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers_pl import spell_numbers

#: Whole tokens that carry no words, and spellings that count as one.
FILLER = r"^(?:y{2,}|e{2,}|m{2,}|hm+|mhm+|yhy)$"
CANONICAL = {"okej": "ok"}


def finite_time(x: Column) -> Column:
    """Null, NaN and infinite times become 0, and negative ones too."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), x))


def normalised_tokens(text: Column) -> Column:
    """Lower-cased words of ``text`` without markup in angle or square brackets, punctuation and fillers; numbers in Polish words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "<[^>]*>", " "), r"\[[^\]]*\]", " ")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " ")), " ")
    kept = F.filter(words, lambda t: (t != "") & ~t.rlike(FILLER))
    return spell_numbers(F.transform(kept, lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])[t], t)))


def normalise(text: Column) -> Column:
    return F.array_join(normalised_tokens(text), " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clock(seconds: Column, mark: str = ",") -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(seconds / 3_600_000), F.floor(seconds / 60_000) % 60, F.floor(seconds / 1000) % 60, seconds % 1000)


def clock_to_ms(text: Column) -> Column:
    """HH:MM:SS.cc to milliseconds, null where it is not one."""
    form = r"^(\d+):(\d{2}):(\d{2})\.(\d{1,3})$"
    part = [F.regexp_extract(text, form, i) for i in (1, 2, 3, 4)]
    whole = part[0].try_cast("long") * 3_600_000 + part[1].try_cast("long") * 60_000 + part[2].try_cast("long") * 1000
    return F.when(text.rlike(form), whole + F.rpad(part[3], 3, "0").try_cast("long"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def short_count(n: Column) -> Column:
    """1.23M, 4.56K or the number itself; hundredths are rounded half up."""

    def scaled(unit: int, letter: str) -> Column:
        hundredths = F.floor((n + unit // 200) / (unit // 100))
        return F.format_string(f"%d.%02d{letter}", F.floor(hundredths / 100), hundredths % 100)

    return F.when(n >= 1_000_000, scaled(1_000_000, "M")).when(n >= 1000, scaled(1000, "K")).otherwise(n.cast("string"))
