"""Column expressions for text: stripping, letter tests, case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Punctuation stripped from token edges, and the white space of a split.
EDGE = ",.?!;:'\""
SPACE = " \t\n\x0b\f\r"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_edges(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(EDGE))


def is_alpha(c: Column | str) -> Column:
    return col(c).rlike(r"^\p{L}+$")


def capitalised(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.lower(F.substr(col(c), F.lit(2))))


def is_title(c: Column | str) -> Column:
    """Title case of a single word with or without edge punctuation."""
    return col(c).rlike(r"^\P{L}*\p{Lu}[\p{Ll}]*\P{L}*$")


def is_upper(c: Column | str) -> Column:
    return (F.upper(col(c)) == col(c)) & (F.lower(col(c)) != col(c))


def with_case_of(word: Column, like: Column) -> Column:
    """The word in title case or capitals if `like` is written so."""
    return F.when(is_title(like), capitalised(word)).when(is_upper(like), F.upper(word)).otherwise(word)


def split_sentences(c: Column | str) -> Column:
    """Text -> sentences: cut after . ! ? before white space, trimmed, none empty."""
    parts = F.split(col(c), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(SPACE))), lambda s: s != "")


def split_tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


def words(tokens: Column | str) -> Column:
    """Lower-case alphabetic tokens."""
    return F.filter(F.transform(col(tokens), F.lower), is_alpha)


def grams(seq: Column, n: int, start: str, end: str | None) -> Column:
    """All n-grams of a sequence padded with n - 1 `start` and one `end`, as structs w1 ... wn. No shuffle: a row's own array.
    The padded sequence is bound once, so an n-gram costs the same in rows of any length."""

    def items(p: Column) -> Column:
        last = F.size(p) - n
        return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(*(F.get(p, i + j).alias(f"w{j + 1}") for j in range(n))))

    return F.transform(F.array(padded(seq, n - 1, start, end)), items)[0]


def padded(seq: Column, starts: int, start: str, end: str | None) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.array_repeat(F.lit(start), starts) if starts else none, seq, F.array(F.lit(end)) if end else none)


def gram_rows(rows: DataFrame, seq: Column, n: int, start: str, end: str | None, starts: int | None = None) -> DataFrame:
    """(w1 ... wn) of all n-grams of the rows' sequences, padded with `starts` (n - 1 unless given) `start`: shifted slices of one array, zipped."""
    names = [f"w{j + 1}" for j in range(n)]
    p = rows.select(padded(seq, n - 1 if starts is None else starts, start, end).alias("p")).where(F.size("p") >= n)
    return p.select(*(F.slice("p", j + 1, F.size("p") - (n - 1)).alias(w) for j, w in enumerate(names))).select(F.inline(F.arrays_zip(*names)))
