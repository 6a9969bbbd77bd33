"""Facts inside JSON payloads and numbers inside prose, without leaving the JVM.

A payload is flattened by text patterns.  Escapes are neutralised first; after that a
string cannot contain a quote and one linear scan finds keys, strings and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwise.functions.basics import bound, col
from sumwise.functions.text import ascii_digits


# Date labels that are not quantities, and the three shapes of a number.
DATE_LABEL = (
    r"\b[0-9]{4}-[0-9]{2}(?:-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)?)?\b"
)
NUMBER = r"-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+\.[0-9]+|-?[0-9]+"
SMALL_INTEGER = 10

_JSON_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def parsed_json(c: Column | str) -> Column:
    """The value of a JSON text, NULL unless the whole text is one value.

    The parser stops after the first value.  What follows it shows when the text is put into
    a list, which then has more than one value or none, and into an object, which then is cut off.
    Only a text with `]` can end the list before its own end.  A text from `{` to the only `}` needs neither.
    """
    t = col(c)
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
    only = bound(listed, lambda v: F.when(F.size(v) == 1, F.when(~t.contains("]") | named.isNotNull(), v[0])))
    plain = t.startswith("{") & (F.instr(t, "}") == F.length(t))
    return F.when(plain, F.try_parse_json(t)).otherwise(only)


def truncate(c: Column) -> Column:
    """Toward zero, staying a double so that no size overflows."""
    return c - c % F.lit(1.0)


def _meaningful(numbers: Column) -> Column:
    """Distinct numbers without small integers, rounded to six digits."""
    kept = F.filter(
        numbers,
        lambda n: n.isNotNull() & ~((n == F.rint(n)) & (F.abs(n) < SMALL_INTEGER)),
    )
    return F.array_distinct(F.transform(kept, lambda n: F.bround(n, 6)))


def _without_escapes(json: Column) -> Column:
    r"""`\\` and `\"` as unicode escapes, so that every quote left delimits a string."""
    doubled = F.replace(json, F.lit("\\\\"), F.lit("\\u005c"))
    return F.replace(doubled, F.lit('\\"'), F.lit("\\u0022"))


def json_numbers(json: Column | str) -> Column:
    """The meaningful number leaves of a JSON text, at any depth; booleans do not count."""
    bare = F.regexp_replace(_without_escapes(col(json)), '"[^"]*"', "")
    found = F.regexp_extract_all(bare, F.lit(_JSON_NUMBER), F.lit(0))
    return _meaningful(F.transform(found, lambda s: s.try_cast("double")))


def json_strings(json: Column | str) -> Column:
    """The string leaves of a JSON text, at any depth; object keys do not count."""
    found = F.regexp_extract_all(_without_escapes(col(json)), F.lit(r'"[^"]*"(\s*:)?'), F.lit(0))
    values = F.filter(found, lambda s: s.endswith('"'))
    listed = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
    return F.from_json(listed, "array<string>")


def json_labels(json: Column | str) -> Column:
    """String leaves that mix letters and digits, such as `Budget_2024`."""
    return F.array_distinct(
        F.filter(json_strings(json), lambda s: s.rlike(r"\p{L}") & s.rlike(r"\p{Nd}"))
    )


def _mask(text: Column, labels: Column) -> Column:
    longest_first = F.array_sort(
        labels, lambda a, b: F.length(b) - F.length(a)
    )
    return F.aggregate(longest_first, text, lambda t, label: F.replace(t, label, F.lit(" ")))


def text_numbers(text: Column | str, labels: Column | None = None) -> Column:
    """The meaningful numbers a text cites, outside known labels and date labels."""
    t = col(text)
    if labels is not None:
        t = bound(labels, lambda known: F.when(F.size(known) > 0, _mask(col(text), known)).otherwise(col(text)))
    t = F.regexp_replace(bound(t, ascii_digits), DATE_LABEL, " ")
    found = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))
    return _meaningful(
        F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    )


def unsupported_numbers(cited: Column, known: Column) -> Column:
    """The cited numbers that no known number backs, exactly or after truncation."""
    return bound(
        known,
        lambda numbers: F.filter(
            cited,
            lambda n: ~F.exists(
                numbers,
                lambda k: (F.abs(n - k) < 1e-6) | (truncate(n) == truncate(k)),
            ),
        ),
    )
