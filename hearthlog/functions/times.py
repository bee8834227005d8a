"""Dates out of file names, EXIF strings and questions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values ----
# (pattern, layout of its digits) in the order they are tried; a layout that
# starts with yyMM has a two-digit year
FILE_NAME_DATES = [
    (r"\d{4}-\d{2}-\d{2}[ _]\d{2}-\d{2}-\d{2}", "yyyyMMddHHmmss"),
    (r"_\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}_", "yyyyMMddHHmmss"),
    (r"(?i)(?:REC|VID)\d{14}", "yyyyMMddHHmmss"),
    (r"(?i)(?:PTT|AUD|VID|IMG)[-_]?\d{8}", "yyyyMMdd"),
    (r"_\d{8}-\d{6}", "yyyyMMddHHmmss"),
    (r"[-_]\d{10}(?:\D|$)", "yyMMddHHmm"),
]
FIRST_FILE_YEAR = 2015
FIRST_QUERY_YEAR = 2008
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}
RELATIVE_DAYS = {
    "aaj": 0, "today": 0, "kal": 1, "yesterday": 1, "parso": 2,
    "last week": 7, "pichle hafte": 7, "is hafte": 7, "this week": 7,
    "last month": 31, "pichle mahine": 31, "is mahine": 31, "this month": 31,
    "last year": 365, "pichle saal": 365, "bachpan": 4000, "childhood": 4000,
}
# ---- end of fixed values ----


def timestamp_from_name(name: Column, as_of: Column) -> Column:
    """First file-name layout that gives a real date between 2015 and next year."""
    found = []
    for pattern, digits_layout in FILE_NAME_DATES:
        found_text = F.nullif(F.regexp_extract(name, pattern, 0), F.lit(""))  # NULL costs no parse
        digits = F.regexp_replace(found_text, r"\D", "")
        if digits_layout.startswith("yyMM"):
            digits, digits_layout = F.concat(F.lit("20"), digits), "yy" + digits_layout
        ts = F.try_to_timestamp(digits, F.lit(digits_layout))
        found.append(F.when(F.year(ts).between(FIRST_FILE_YEAR, F.year(as_of) + 1), ts))
    return F.coalesce(*found)


def file_timestamp(name: Column, modified: Column, as_of: Column) -> Column:
    return F.coalesce(timestamp_from_name(name, as_of), modified)


def exif_timestamp(raw: Column) -> Column:
    text = F.left(raw, F.lit(19))
    plausible = F.when(text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$") & ~F.startswith(text, F.lit("0000")), text)
    return F.try_to_timestamp(plausible, F.lit("yyyy:MM:dd HH:mm:ss"))


def photo_date(
    capture: Column, name: Column, modified_exif: Column, mtime: Column, as_of: Column
) -> Column:
    """struct(taken_at, date_source): best date in order of credibility."""
    taken, named, resaved = exif_timestamp(capture), timestamp_from_name(name, as_of), exif_timestamp(modified_exif)
    source = (
        F.when(taken.isNotNull(), "exif")
        .when(named.isNotNull(), "filename")
        .when(resaved.isNotNull(), "exif_modified")
        .when(mtime.isNotNull(), "mtime")
        .otherwise("none")
    )
    return F.struct(F.coalesce(taken, named, resaved, mtime).alias("taken_at"), source.alias("date_source"))


def time_window(question: Column, now: Column) -> Column:
    """struct(lo, hi): half-open window a question asks about; NULL when it names none."""
    text = F.lower(question)
    years = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?U)\b(19[89]\d|20[0-4]\d)\b"), F.lit(1)),
            lambda y: y.cast("int"),
        ),
        lambda y: (y >= FIRST_QUERY_YEAR) & (y <= F.year(now) + 1),
    )
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.element_at(month_of, F.nullif(F.regexp_extract(text, rf"(?U)\b({names})\b", 1), F.lit("")))
    lo, hi = F.array_min(years), F.array_max(years)

    def day(year: Column, month: Column) -> Column:
        return F.make_date(year, month, F.lit(1)).cast("timestamp")

    one_month = F.struct(
        day(lo, month).alias("lo"), day(lo + (month / 12).cast("int"), month % 12 + 1).alias("hi")
    )
    whole_years = F.struct(day(lo, F.lit(1)).alias("lo"), day(hi + 1, F.lit(1)).alias("hi"))
    window = F.when(F.size(years) > 0, F.when((F.size(years) == 1) & month.isNotNull(), one_month).otherwise(whole_years))
    for phrase, days in RELATIVE_DAYS.items():
        if days >= 4000:
            span = F.struct(day(F.lit(FIRST_QUERY_YEAR), F.lit(1)).alias("lo"), day(F.year(now) - 6, F.lit(1)).alias("hi"))
        else:
            span = F.struct(
                (now - F.expr(f"INTERVAL {max(days, 1)} DAYS")).alias("lo"),
                (now + F.expr("INTERVAL 1 DAY")).alias("hi"),
            )
        window = window.when(F.contains(text, F.lit(phrase)), span)
    return window


def iso_week(day: Column) -> Column:
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def in_week_of(ts: Column, anchor: Column) -> Column:
    """Whether a time lies in the Monday-to-Sunday week of `anchor`."""
    start = F.date_trunc("week", anchor)
    return (ts >= start) & (ts < start + F.expr("INTERVAL 7 DAYS"))
