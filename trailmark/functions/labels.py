"""Labels for people: date ranges, countries, titles, file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that labels use.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEASON_OF_MONTH = ("Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer", "Autumn", "Autumn", "Autumn", "Winter")
SHORT_NAMES = {
    "US": "United States", "RU": "Russia", "KR": "South Korea", "KP": "North Korea", "IR": "Iran", "VN": "Vietnam", "LA": "Laos",
    "SY": "Syria", "BO": "Bolivia", "VE": "Venezuela", "TZ": "Tanzania", "MD": "Moldova", "CD": "DR Congo",
}
WRITABLE = ("jpg", "jpeg", "png", "webp")
READ_ONLY = ("heic", "heif", "cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2")
WRITE_BACK = ("jpg", "jpeg")


def _pick(names: tuple[str, ...], month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), month)


def date_range_label(start: Column, end: Column) -> Column:
    """The wider the span, the coarser: a day, days of a month, a season or months of a year, years. Empty for a null start."""
    end = F.coalesce(end, start)
    y1, y2, m1, m2, d1, d2 = F.year(start), F.year(end), F.month(start), F.month(end), F.day(start), F.day(end)
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
    first, last, season = _pick(MONTHS, m1), _pick(MONTHS, m2), _pick(SEASON_OF_MONTH, m1)
    same_year = y1 == y2
    return (
        F.when(start.isNull(), "")
        .when(same_year & (m1 == m2) & (d1 == d2), F.format_string("%s %d, %d", first, d1, y1))
        .when(same_year & (m1 == m2), F.format_string("%s %d–%d, %d", first, d1, d2, y1))
        .when(same_year & (m1 == 1) & (m2 == 12) & (days > 300), y1.cast("string"))
        .when(same_year & (season == _pick(SEASON_OF_MONTH, m2)), F.format_string("%s %d", season, y1))
        .when(same_year, F.format_string("%s – %s %d", first, last, y1))
        .when(days > 330 * (y2 - y1), F.format_string("%d–%d", y1, y2))
        .otherwise(F.format_string("%s %d – %s %d", first, y1, last, y2))
    )


def country_name(iso: Column, dataset_name: Column | None = None) -> Column:
    """Short form if there is one, else the boundary data's name, else the code."""
    short = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(short, iso), *([dataset_name] if dataset_name is not None else []), iso)


def file_format(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1), F.lit(""))


def kind_flags(path: Column) -> dict[str, Column]:
    """format, writable (its hash ignores metadata) and write_back (its tags can be written into the file)."""
    kind = file_format(path)
    return {"format": kind, "writable": F.coalesce(kind.isin(*WRITABLE), F.lit(False)), "write_back": F.coalesce(kind.isin(*WRITE_BACK), F.lit(False))}
