"""Spoken years as column expressions."""
from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, functions as F

# ---- fixed values ----
FIRST_SPOKEN_YEAR = 1990
NUMBER_WORDS = {
    "शून्य": 0, "सिफर": 0, "ਸਿਫ਼ਰ": 0, "zero": 0, "एक": 1, "ਇੱਕ": 1, "ਇਕ": 1, "दो": 2, "ਦੋ": 2,
    "तीन": 3, "ਤਿੰਨ": 3, "चार": 4, "ਚਾਰ": 4, "पांच": 5, "पाँच": 5, "ਪੰਜ": 5, "छह": 6, "छे": 6, "ਛੇ": 6,
    "सात": 7, "ਸੱਤ": 7, "आठ": 8, "ਅੱਠ": 8, "नौ": 9, "ਨੌਂ": 9, "ਨੌ": 9,
    "दस": 10, "ਦਸ": 10, "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16,
    "सत्रह": 17, "सतरह": 17, "ਸਤਾਰਾਂ": 17, "अठारह": 18, "ਅਠਾਰਾਂ": 18, "उन्नीस": 19, "ਉੱਨੀ": 19,
    "बीस": 20, "ਵੀਹ": 20, "इक्कीस": 21, "बाईस": 22, "तेईस": 23, "चौबीस": 24, "पच्चीस": 25, "छब्बीस": 26,
}
SCALE_WORDS = {"सौ": 100, "ਸੌ": 100, "हज़ार": 1000, "हजार": 1000, "ਹਜ਼ਾਰ": 1000, "हज़ार": 1000}
SPOKEN_PUNCTUATION = ",.।?!"
SPANS = (4, 3, 2)
# ---- end of fixed values ----


def _code(token: Column) -> Column:
    """A number word's value, a scale word's value negated, else NULL."""
    known = {**NUMBER_WORDS, **{word: -value for word, value in SCALE_WORDS.items()}}
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    return F.try_element_at(table, F.lower(F.trim(token, F.lit(SPOKEN_PUNCTUATION))))


def _year(codes: Column, last_year: int) -> Column:
    """The year that a run of codes says: digits one by one, or parts with scale words; else NULL."""
    digits = F.array_join(F.transform(codes, lambda x: x.cast("string")), "")
    start = F.struct(F.lit(0).alias("year"), F.lit(0).alias("held"), F.lit(False).alias("scaled"))

    def add(so_far: Column, code: Column) -> Column:
        held = so_far["held"]
        joined = (F.when(held == 0, code).when(so_far["scaled"], held + code)
                  .when(code < 10, held * 100 + code).otherwise(code))
        closed = so_far["year"] - F.when(held == 0, 1).otherwise(held) * code
        return F.when(code < 0, F.struct(closed.alias("year"), F.lit(0).alias("held"), F.lit(True).alias("scaled"))).otherwise(
            F.struct(so_far["year"].alias("year"), joined.alias("held"), so_far["scaled"].alias("scaled")))

    parts = F.aggregate(codes, start, add, lambda done: done["year"] + done["held"])
    year = F.when(F.exists(codes, lambda x: x < 0), parts).when(F.length(digits) == 4, digits.cast("int"))
    return F.when(F.forall(codes, lambda x: x.isNotNull()) & year.between(FIRST_SPOKEN_YEAR, last_year), year)


def recover_years(last_year: int) -> Callable[[Column], Column]:
    """Column function turning spoken years into digits; blanks are squeezed as a side effect.

    At each word the longest run of four to two words that says a year wins;
    the words it covers are gone. Texts without a number word pass unsplit.
    """

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]  # lambdas would evaluate it anew wherever they name it

    def found(words: Column, at: Column, span: int) -> Column:
        run = F.slice(words, at + 1, span)
        year = F.when(F.size(run) == span, _year(F.transform(run, lambda w: w["code"]), last_year))
        return once(year, lambda y: F.when(y.isNotNull(), F.struct(at.alias("at"), (at + span).alias("end"), y.cast("string").alias("year"))))

    def replaced(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i < F.size(words))
        spoken = F.filter(places, lambda i: words[i]["code"].isNotNull())
        years = F.filter(F.transform(spoken, lambda i: F.coalesce(*[found(words, i, span) for span in SPANS])), lambda y: y.isNotNull())
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,end:int,year:string>>").alias("kept"))
        first = F.aggregate(years, start, lambda so_far, y: F.when(y["at"] >= so_far["free"], F.struct(y["end"].alias("free"), F.concat(so_far["kept"], F.array(y)).alias("kept"))).otherwise(so_far), lambda done: done["kept"])

        def written(kept: Column) -> Column:
            left = F.filter(places, lambda i: ~F.exists(kept, lambda k: (i > k["at"]) & (i < k["end"])))
            return F.transform(left, lambda i: F.coalesce(F.get(F.filter(kept, lambda k: k["at"] == i), F.lit(0))["year"], words[i]["token"]))

        return F.array_join(once(first, written), " ")

    def recover(text: Column) -> Column:
        tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
        return once(F.transform(tokens, lambda t: F.struct(t.alias("token"), _code(t).alias("code"))), replaced)

    return recover
