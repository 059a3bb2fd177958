"""Text cleaning for scoring and for contamination queries."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation and four quote marks (fixed values).
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~‘’´`"""
#: White space as Python's str.split has it, but for the four information separators.
SPACE = r"(?U)\s+"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_answer(text: Column) -> Column:
    """Lower case, punctuation as blanks, no articles, single blanks."""
    plain = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    return squeezed(F.regexp_replace(plain, r"(?<![\p{L}\p{M}\p{N}_])(?:a|an|the)(?![\p{L}\p{M}\p{N}_])", " "))


def number_aware(text: str) -> str:
    """Per token (at blanks and hyphens): lower case; numbers as floats, else no ASCII punctuation; no articles."""
    out = []
    for token in text.lower().replace("-", " ").split(" "):
        value = as_number(token)
        if value is None:
            token = "".join(c for c in token if c not in PUNCTUATION[:32])
            value = as_number(token)
        words = [w for w in (token if value is None else str(value)).split() if w not in ("a", "an", "the")]
        out.extend(words)
    return " ".join(out)


def as_number(token: str) -> float | None:
    try:
        return float(token)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normal_answer_numbers(text: pd.Series) -> pd.Series:
    """number_aware as a column function; float formats are Python's."""
    return text.map(lambda t: None if t is None else number_aware(t))


def register(spark: SparkSession) -> None:
    """Makes the functions that SQL can't express callable from SQL by name."""
    spark.udf.register("number_aware", normal_answer_numbers)
    spark.udf.register("word_difference", word_difference)


def bracket_free(text: Column) -> Column:
    """Without bracketed marks: `` [title]`` becomes ``. ``, other brackets go, double blanks halve; null is a blank."""
    cut = F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", "")
    return F.coalesce(F.replace(cut, F.lit("  "), F.lit(" ")), F.lit(" "))


def cut_question(text: Column) -> Column:
    """Up to the last ASCII letter, unless only a question mark follows it."""
    upto = F.regexp_extract(text, r"(?s)^(.*[a-zA-Z])", 1)
    rest = F.trim(F.substring(text, F.length(upto) + 1, F.length(text)))
    return F.when(rest == "?", text).otherwise(upto)


def inner_lines(text: Column, head: int = 1, tail: int = 3) -> Column:
    """Without the first and the last lines."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.slice(lines, F.lit(head + 1), F.greatest(F.size(lines) - head - tail, F.lit(0))), "\n")


def last_word(text: Column) -> Column:
    return F.element_at(F.split(squeezed(text), " "), -1)


def before_last_word(text: Column) -> Column:
    words = F.split(squeezed(text), " ")
    return F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")


def with_periods(answers: Column) -> Column:
    """Trimmed, non-blank answers that end in a full stop."""
    trimmed = F.filter(F.transform(answers, F.trim), lambda a: F.length(a) > 0)
    return F.transform(trimmed, lambda a: F.when(a.endswith("."), a).otherwise(F.concat(a, F.lit("."))))


def filled(template: str, **fields: Column) -> Column:
    """The template with ``{name}`` replaced by each field; null fields are empty. Braces of other names stay."""
    out, at = [], 0
    for found in re.finditer(r"\{(\w+)\}", template):
        if found[1] in fields:
            out += [F.lit(template[at : found.start()]), F.coalesce(fields[found[1]].cast("string"), F.lit(""))]
            at = found.end()
    return F.concat(*out, F.lit(template[at:]))


def choice_array(*choices: Column) -> Column:
    """The choices that there are, trimmed, in order."""
    return F.filter(F.array(*[F.trim(c) for c in choices]), lambda c: c.isNotNull() & (c != ""))


def literal_list(text: Column) -> Column:
    """The strings of a list written as ``['a', "b"]``; null where it can't be read."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def last_literal(text: Column) -> Column:
    return F.try_element_at(literal_list(text), F.lit(-1))


def joined_turns(turns: Column) -> Column:
    """Turns on lines of their own; null ones are left out."""
    return F.array_join(turns, "\n")


def letter(i: Column) -> Column:
    return F.char(i + F.lit(65))


def listed_choices(choices: Column) -> Column:
    """``A. x`` and so on, each with a line feed."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), c, F.lit("\n"))), "")


def right_letters(labels: Column) -> Column:
    """Letters of the choices whose label is 1, joined by commas."""
    marked = F.transform(labels, lambda x, i: F.when(x == 1, letter(i)))
    return F.array_join(F.filter(marked, lambda m: m.isNotNull()), ", ")


def choice_text(texts: Column, labels: Column, key: Column) -> Column:
    """The text whose label is the key; null without one."""
    at = F.array_position(labels, key)
    return F.when(at > 0, F.get(texts, (at - 1).cast("int")))


def shuffled_choices(right: Column, wrong: Column, key: Column, seed: int = 0) -> Column:
    """(choices, answer): the right and wrong answers in a hash order, and the right one's letter."""
    keyed = F.transform(F.concat(F.array(right), wrong), lambda c, i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed))).cast("binary")).alias("h"), c.alias("c"), i.alias("i")))
    order = F.array_sort(keyed)
    return F.struct(F.transform(order, lambda x: x["c"]).alias("choices"), letter(F.array_position(F.transform(order, lambda x: x["i"]), 0).cast("int") - 1).alias("answer"))


def match_at(text: Column, pattern: str, group: int = 1, which: int = -1, fallback: str = "[invalid]") -> Column:
    """A regex match's group: the last one for -1, the first for 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, which if which < 0 else which + 1))).otherwise(F.lit(fallback))


def exactly_matches(answer: Column, gold: Column, ignore_case: bool = False, ignore_punctuation: bool = False, ignore: tuple[str, ...] = ()) -> Column:
    """Whether both are equal once what is to be ignored is gone."""

    def plain(x: Column) -> Column:
        for pattern in ignore:
            x = F.regexp_replace(x, pattern, "")
        x = F.lower(x) if ignore_case else x
        return F.translate(x, PUNCTUATION[:32], "") if ignore_punctuation else x

    return plain(answer) == plain(gold)


def stopped(text: Column, terms: tuple[str, ...]) -> Column:
    """Up to the first occurrence of any non-empty term."""
    for term in filter(None, terms):
        text = F.substring_index(text, term, 1)
    return text


def split_context(context: Column, continuation: Column) -> Column:
    """(context, continuation) with the context's trailing white space moved to the continuation."""
    tail = F.regexp_extract(context, r"(?U)(\s*)$", 1)
    return F.struct(F.substring(context, F.lit(1), F.length(context) - F.length(tail)).alias("context"), F.concat(tail, continuation).alias("continuation"))


def compound_extension(path: Column) -> Column:
    """All extensions of a path's last part, like ``.json.gz``."""
    return F.regexp_extract(path, r"[^./]((?:\.[^./]+)+)$", 1)


@F.pandas_udf(T.StringType())
def word_difference(first: pd.Series, second: pd.Series) -> pd.Series:
    """The words both share, with ``_`` for every run in which they differ."""

    def masked(a: str, b: str) -> str:
        x, y = a.split(), b.split()
        ops = difflib.SequenceMatcher(None, x, y).get_opcodes()
        return " ".join(w for kind, lo, hi, _, _ in ops for w in (x[lo:hi] if kind == "equal" else ["_"]))

    return pd.Series([None if a is None or b is None else masked(a, b) for a, b in zip(first, second, strict=True)])
