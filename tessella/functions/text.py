"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; Spark's plain \s is ASCII only.
SPACE = r"(?U)\s+"
#: Fixed value: signs of a generation that repeats the chat prompt.
LEAK = r"<\|im_start\|>|(?:^|\n)\s*(?:system|user|assistant)\s*\n"
END = "<|im_end|>"
STRIP = r"^(?U)\s+|(?U)\s+$"


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column) -> Column:
    return F.lower(collapse(text))


def packed(text: Column) -> Column:
    """Lower-cased, without any white space."""
    return F.regexp_replace(F.lower(text), SPACE, "")


def _grams(chars: Column, n: int, made) -> Column:
    """``made`` of each of the n-grams' first places; the one gram of a text of n characters or fewer; none of an empty one."""
    return F.when(F.size(chars) == 0, F.array()).when(F.size(chars) <= n, F.array(F.array_join(chars, ""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(chars) - n), made))


def char_grams(text: Column, n: int = 4) -> Column:
    """All n-grams of the packed text with repeats; a shorter text is one gram; none of an empty one."""
    # The characters are bound once by the outer transform; a lambda's body is evaluated anew for each element.
    chars = F.array(F.filter(F.split(packed(text), ""), lambda c: c != ""))
    return F.element_at(F.transform(chars, lambda c: _grams(c, n, lambda i: F.concat(*(F.get(c, i + k) for k in range(n))))), 1)


def char_gram_counts(text: Column, n: int = 4) -> Column:
    """struct<n_grams, n_distinct> of :func:`char_grams`; null texts have none. Different grams are told apart by a 64-bit hash, so none is built."""
    chars = F.array(F.filter(F.split(packed(F.coalesce(text, F.lit(""))), ""), lambda c: c != ""))
    grams = F.transform(
        chars,
        lambda c: F.when(F.size(c) == 0, F.array().cast("array<bigint>"))
        .when(F.size(c) <= n, F.array(F.lit(0).cast("bigint")))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(n))))),
    )
    sizes = F.transform(grams, lambda g: F.struct(F.size(g).cast("long").alias("n_grams"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct")))
    return F.element_at(sizes, 1)


def prompt_leaked(raw: Column) -> Column:
    return F.coalesce(F.regexp_replace(raw, STRIP, "").rlike(LEAK), F.lit(False))


def cleanly_terminated(raw: Column, terminators: tuple[str, ...] = (END,)) -> Column:
    """Ends with a terminator and repeats no prompt; empty and null: false."""
    text = F.regexp_replace(raw, STRIP, "")
    ends = F.lit(False)
    for t in terminators:
        ends = ends | text.endswith(t)
    return F.coalesce(ends & ~text.rlike(LEAK), F.lit(False))


def assistant_segments(rendered: Column) -> Column:
    """The assistant turns of a rendered chat."""
    return F.regexp_extract_all(rendered, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"), 1)


def with_thinking(thinking: Column, solution: Column) -> Column:
    return F.when(F.coalesce(thinking, F.lit("")) != "", F.concat(F.lit("<think>\n"), thinking, F.lit("\n</think>\n\n"), solution)).otherwise(solution)


def shifted_date(date: Column, days: int) -> Column:
    """An ISO date some days later, as text."""
    return F.date_format(F.date_add(F.to_date(date), days), "yyyy-MM-dd")
