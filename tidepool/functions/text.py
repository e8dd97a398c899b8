"""Text expressions: stripping, tokens, keyword tests, rounding."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.schema import TF_BUCKETS

#: The white space at the end begins where no white space is before it, so that inner runs are passed over once.
_EDGES = r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$"


def strip(text: Column) -> Column:
    """Null as empty, Unicode white space and the four separators taken off both ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _EDGES, "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bucket(token: Column, buckets: int = TF_BUCKETS) -> Column:
    """A token's place in a hashed term vector."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def buckets_of(text: Column, buckets: int = TF_BUCKETS) -> Column:
    """The places of all tokens of a text, repeats included: a term-frequency vector in sparse form."""
    return F.transform(tokens(text), lambda t: bucket(t, buckets))


def contains_any(text: Column, words: Iterable[str] | Column) -> Column:
    """One of the words is a substring, both lower-cased; listed words become plain tests that compile with the rest."""
    if isinstance(words, Column):
        return F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w)))
    return functools.reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w.lower())) for w in words))


def coverage(query: Column, text: Column, most: int | None = None) -> Column:
    """The share of the query's distinct tokens that the text has; of at most so many tokens of both together, the query's first."""
    asked, there = tokens(query), tokens(text)
    if most is not None:
        asked = F.slice(asked, 1, most)
        there = F.slice(there, F.lit(1), F.lit(most) - F.size(asked))
    own = F.array_distinct(asked)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, there)) / F.size(own))


def one_line(text: Column, most: int) -> Column:
    """The first characters, line breaks shown as ' / '."""
    return F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" / "))


def host_of(url: Column) -> Column:
    """The host of a URL; what has none or is none counts as local."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("localhost"))


def half_even(value: Column, places: int) -> Column:
    """The nearest decimal to the binary value, to even on its exact ties."""
    return F.replace(F.format_number(value, places), F.lit(",")).cast("double")
