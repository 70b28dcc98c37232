"""Listing dates as printed by the source, resolved against an explicit run date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from pricelens.functions import vocabulary as vocab
from pricelens.functions.folding import casefold, literal_map
from pricelens.functions.text import SPACE_CLASS, squeeze, strip

# Layouts accepted when no month name decides: ISO forms, then day-first forms.
FALLBACK_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm[:ss][.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS][XXX]", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd",
    "d/M/yyyy[ HH:mm[:ss]]", "d.M.yyyy[ HH:mm[:ss]]", "d-M-yyyy[ HH:mm[:ss]]", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)

# Layouts with a year of two digits: 69 to 99 belong to the last century.
SHORT_YEAR_FORMATS = ("d.M.yy", "d/M/yy", "d-M-yy")


def as_date(run_date: dt.date | str | Column) -> Column:
    return run_date if isinstance(run_date, Column) else F.lit(str(run_date)).cast("date")


def _month_number(name: Column) -> Column:
    return F.try_element_at(literal_map({k: str(v) for k, v in vocab.MONTHS.items()}), name).cast("int")


def _compose(day: Column, month: Column, year: Column) -> Column:
    """Null for impossible days such as 31 February."""
    return F.try_to_timestamp(F.concat_ws("-", year, month.cast("string"), day), F.lit("yyyy-M-d")).cast("date")


def listing_date(text: Column, run_date: dt.date | str | Column) -> Column:
    """Analysis flavour: today/yesterday only as the whole text, then 'd Month yyyy', then plain layouts."""
    trimmed = strip(text)
    folded = casefold(trimmed)
    today = as_date(run_date)
    pattern = rf"([0-9]{{1,2}}){SPACE_CLASS}+([A-Za-zÇĞİÖŞÜçğıöşü]+){SPACE_CLASS}+([0-9]{{4}})"
    part = [F.regexp_extract(trimmed, pattern, i) for i in (1, 2, 3)]
    month = _month_number(casefold(part[1]))
    parsed = lambda formats: F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]).cast("date")
    short = parsed(SHORT_YEAR_FORMATS)
    general = F.coalesce(parsed(FALLBACK_FORMATS), F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short))
    return (
        F.when(trimmed.isNull() | (trimmed == ""), F.lit(None))
        .when(folded.isin("bugün", "bugun"), today)
        .when(folded.isin("dün", "dun"), F.date_sub(today, 1))
        .when(month.isNotNull(), _compose(part[0], month, part[2]))
        .otherwise(general)
    )


def plain_letters(text: Column) -> Column:
    return squeeze(F.translate(casefold(text), "ığüşöç", "igusoc"))


def ingest_date(text: Column, run_date: dt.date | str | Column) -> Column:
    """Ingest flavour: today/yesterday anywhere in the text, then 'd Month yyyy', nothing else."""
    plain = plain_letters(text)
    compact = squeeze(casefold(text))
    today = as_date(run_date)
    pattern = r"([0-9]{1,2}) ([a-zçğıöşü]+) ([0-9]{4})"
    part = [F.regexp_extract(compact, pattern, i) for i in (1, 2, 3)]
    month = F.coalesce(_month_number(part[1]), _month_number(plain_letters(part[1])))
    return (
        F.when(plain.contains("bugun"), today)
        .when(plain.contains("dun"), F.date_sub(today, 1))
        .when(month.isNotNull(), _compose(part[0], month, part[2]))
    )
