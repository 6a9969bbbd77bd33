"""Reading messy text: trimming, numbers, percentages, currency, dates, tokens."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import col, computed_once

# The characters str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The accepted shapes of numbers and dates, and the recognized currencies.
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
THREE_DECIMALS = r"^-?[0-9]+\.[0-9]{3}$"
GROUPED_NUMBER = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
LOOSE_COMMAS = r"^-?[0-9]+(,[0-9]+)+(\.[0-9]+)?$"
UNCLEAR_DATE = r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$"
CURRENCY = r"[\p{Sc}\x{20C0}]"
KNOWN_CURRENCY = "[$€£¥]"
CURRENCY_CODES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}

# Words ignored in labels and the groups of words that mean the same.
STOPWORDS = ["the", "a", "an", "of", "for", "in", "on"]
SYNONYMS = [
    ["sales", "revenue"],
    ["total", "sum", "amount"],
    ["net"],
    ["gross"],
    ["units", "quantity", "qty", "count"],
    ["price", "cost"],
    ["profit", "margin"],
]

# Shape of a date and the pattern that reads it.
DATE_SHAPES = [
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4}$", "MMMM d, yyyy"),
    (r"^[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}$", "d MMMM yyyy"),
]
MAY_BE_DATE = r"^(?:[0-9]{4}[-/]|[0-9]{1,2}\s|[A-Za-z]+\s)"  # the start of each of them
ISO_TIMESTAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"
)


#: Decimal digits of all scripts, and the same digits in ASCII.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)

# Shapes of months and moments that only a period column may have, and the patterns that read them.
MONTH_SHAPES = [
    (r"^[0-9]{4}-[0-9]{1,2}$", "-1", "yyyy-M-d"),
    (r"^[0-9]{4}/[0-9]{1,2}$", "/1", "yyyy/M/d"),
]
NAMED_MONTH = r"^[A-Za-z]+\s+[0-9]{4}$"
DASHED_DAY = r"^[0-9]{1,2}-[A-Za-z]+-[0-9]{4}$"
MAY_BE_MOMENT = r"^(?:[0-9]{4}[-/]|[0-9]{1,2}(?:-|\s+)[A-Za-z]|[A-Za-z]+\s+[0-9])"  # the start of each of them
ZONE = r"\s?(Z|[+-][0-9]{2}:?[0-9]{2})$"


def beyond_ascii(t: Column) -> Column:
    """Whether a text has characters outside ASCII, told by its lengths alone."""
    return F.octet_length(t) != F.char_length(t)


def ascii_digits(c: Column | str) -> Column:
    """The text with every decimal digit written in ASCII, so that `[0-9]` means any digit."""
    t = col(c)
    return F.when(beyond_ascii(t) & t.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(t, DIGITS, ASCII_DIGITS)).otherwise(t)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def parse_date(c: Column | str) -> Column:
    """Date of a text in one of the four accepted shapes, else NULL.

    The cheap shape test comes first, so free text never reaches the date parser.
    """
    s = col(c)
    branches = None
    for shape, pattern in DATE_SHAPES:
        words = F.regexp_replace(s, r"\s+", " ") if "MMMM" in pattern else s
        value = F.try_to_date(words, pattern)
        test = s.rlike(shape)
        branches = F.when(test, value) if branches is None else branches.when(test, value)
    return F.when(s.rlike(MAY_BE_DATE), branches)


def parse_timestamp(c: Column | str) -> Column:
    """Timestamp without zone of a text, as a period column may be written.

    The four date shapes, an ISO date and time (a zone is dropped, the written time stays), a
    month as `2024-01`, `2024/01`, `Jan 2024`, or a day as `15-Jan-2024`.
    """
    return moment_of(ascii_digits(strip(c)))


def moment_of(s: Column) -> Column:
    """As `parse_timestamp`, for a column already trimmed and in ASCII digits: it is read many times over."""
    plain = F.regexp_replace(s, ZONE, "")
    iso = F.when(plain.rlike(ISO_TIMESTAMP), plain.try_cast("timestamp_ntz"))
    months = [F.when(s.rlike(shape), F.try_to_date(F.concat(s, F.lit(end)), pattern)) for shape, end, pattern in MONTH_SHAPES]
    named = F.when(s.rlike(NAMED_MONTH), F.concat(F.lit("1 "), F.initcap(F.regexp_replace(s, r"\s+", " "))))
    dashed = F.when(s.rlike(DASHED_DAY), F.initcap(F.replace(s, F.lit("-"), F.lit(" "))))
    written = [F.try_to_date(words, f"d {name} yyyy") for words in (named, dashed) for name in ("MMMM", "MMM")]
    days = [d.cast("timestamp_ntz") for d in (parse_date(s), *months, *written)]
    return F.when(s.rlike(MAY_BE_MOMENT), F.coalesce(days[0], iso, *days[1:]))


def read_cells(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds for each text column a struct of what its cells hold.

    `columns` maps a text column to the name of the new column, a
    `struct<num, text, type, was_changed, is_ambiguous, warning>`.  Exactly one of `num`
    and `text` is set for a non-null cell.  A cell that cannot be read with certainty
    keeps its raw text and says why in `warning`.

    The rules are applied in steps, each a projection over the one before, so every
    pattern is evaluated once per cell and the generated code stays small.
    """
    made = {out: f"__{i}_" for i, out in enumerate(columns.values())}
    steps = [_bare, _trimmed, _marked, _body, _code, _values]
    names = {step: {out: p + step.__name__ for out, p in made.items()} for step in steps}

    for step in steps:
        df = df.withColumns(
            {
                names[step][out]: step(
                    F.col(raw), *[F.col(names[done][out]) for done in steps[: steps.index(step)]]
                )
                for raw, out in columns.items()
            }
        )
    kept = [c for c in df.columns if not any(c in by_out.values() for by_out in names.values())]
    findings = {
        out: _finding(F.col(raw), *[F.col(names[step][out]) for step in steps])
        for raw, out in columns.items()
    }
    return computed_once(df, kept, **findings)


def _bare(raw: Column) -> Column:
    return strip(raw)


def _trimmed(raw: Column, bare: Column) -> Column:
    return ascii_digits(bare)


def _marked(raw: Column, bare: Column, s: Column) -> Column:
    """`%`, `$` or nothing for the kind of number to look for, `!...` for a misplaced sign."""
    return (
        F.when(
            s.contains("%"),
            F.when(s.rlike("^[^%]*%$"), "%").otherwise("!invalid_percentage_format"),
        )
        .when(
            s.contains("$") | (beyond_ascii(s) & s.rlike(CURRENCY)),
            F.when(F.regexp_count(s, F.lit(CURRENCY)) > 1, "!multiple_currency_symbols")
            .when(~s.rlike(rf"^{CURRENCY}|{CURRENCY}$"), "!unsupported_currency_symbol_position")
            .when(~s.rlike(KNOWN_CURRENCY), "!unrecognized_currency_symbol")
            .otherwise("$"),
        )
        .otherwise("")
    )


def _body(raw: Column, bare: Column, s: Column, mark: Column) -> Column:
    """The text that should be a number; NULL where none is expected."""
    return (
        F.when(mark == "%", strip(F.replace(s, F.lit("%"), F.lit(""))))
        .when(mark == "$", strip(F.translate(s, "".join(CURRENCY_CODES), "")))
        .when((mark == "") & s.rlike("^-?[0-9]"), s)
    )


def _code(raw: Column, bare: Column, s: Column, mark: Column, body: Column) -> Column:
    """The type of a number, `!...` for a warning, NULL for neither."""
    return (
        F.when(body.isNull(), F.when(mark.startswith("!"), mark))
        .when(body.rlike(THREE_DECIMALS), "!ambiguous_decimal_or_thousands")
        .when(
            body.rlike(PLAIN_NUMBER) | body.rlike(GROUPED_NUMBER),
            F.when(mark == "%", "percentage").when(mark == "$", "currency").otherwise("numeric"),
        )
        .when(body.rlike(LOOSE_COMMAS), "!ambiguous_thousands_separator")
        .when(mark == "%", "!invalid_percentage_format")
        .when(mark == "$", "!invalid_currency_format")
    )


def _values(raw: Column, bare: Column, s: Column, mark: Column, body: Column, code: Column) -> Column:
    """`struct<num, day>`: the number, or the ISO day of a date."""
    number = F.replace(body, F.lit(","), F.lit("")).try_cast("double")
    return F.struct(
        F.when(code == "percentage", number / F.lit(100.0))
        .when(code.isin("numeric", "currency"), number)
        .alias("num"),
        F.when(code.isNull() & (mark == ""), parse_date(s).cast("string")).alias("day"),
    )


def _finding(raw: Column, bare: Column, s: Column, mark: Column, body: Column, code: Column, values: Column) -> Column:
    num, day = values["num"], values["day"]
    unclear_date = code.isNull() & (mark == "") & day.isNull() & s.rlike(UNCLEAR_DATE)
    warning = F.when(code.startswith("!"), F.regexp_replace(code, "^!", "")).when(
        unclear_date, "ambiguous_date_format"
    )
    return F.struct(
        num.alias("num"),
        F.when(num.isNull(), F.coalesce(day, raw)).alias("text"),
        F.when(num.isNotNull(), code).when(day.isNotNull(), "date").alias("type"),
        (num.isNotNull() | F.coalesce(day != raw, F.lit(False))).alias("was_changed"),
        warning.isNotNull().alias("is_ambiguous"),
        warning.alias("warning"),
    )


def label_tokens(c: Column | str) -> Column:
    """Distinct lower-case words of a label without stopwords."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def synonym_map() -> Column:
    """token -> the words of its group, as a literal map."""
    entries: list[Column] = []
    for group in SYNONYMS:
        for word in group:
            entries += [F.lit(word), F.array(*[F.lit(w) for w in group])]
    return F.create_map(*entries)


def expand_synonyms(tokens: Column) -> Column:
    """`tokens` together with the words that mean the same as one of them."""
    groups = F.transform(
        tokens,
        lambda t: F.coalesce(F.element_at(synonym_map(), t), F.array().cast("array<string>")),
    )
    return F.array_union(tokens, F.flatten(groups))


def double_text(c: Column | str) -> Column:
    """A double written the way the answers write it: `460000.0`, `1e+16`, `1e-05`.

    The cast to text may carry one digit too many; sixteen digits replace seventeen where
    they still name the same number.
    """
    d = col(c).cast("double")
    s = d.cast("string")
    sixteen = F.format_string("%.15e", d)
    too_long = F.length(F.regexp_replace(s, "[-.]|E.*", "")) >= 17
    best = F.when(too_long & (sixteen.try_cast("double") == d), sixteen).otherwise(s)
    digits = best.try_cast("decimal(38,21)").cast("string")
    plain = F.regexp_replace(digits, r"(\.0|\.[0-9]*[1-9])0*$", "$1")
    short = F.regexp_replace(best, r"\.0E", "E")
    padded = F.regexp_replace(short, "E(-?)([0-9])$", "E$10$2")
    exponent = F.replace(F.regexp_replace(padded, "E([0-9])", "e+$1"), F.lit("E"), F.lit("e"))
    return (
        F.when(~s.contains("E") & ~too_long, s)
        .when((F.abs(d) >= 1e16) | (F.abs(d) < 1e-4), exponent)
        .otherwise(plain)
    )
