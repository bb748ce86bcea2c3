"""Text normalisation and tokens, as Column expressions that stay in the JVM.

A preset is a list of steps; the order is part of its meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def replace(pattern: str, replacement: str) -> Step:
    return lambda text: F.regexp_replace(text, pattern, replacement)


# Patterns and replacement words of the two normalisation variants.
NEWLINE = r"\n"
NEWLINE_OR_FORM_FEED = r"[\n\f]"
NUMBER = "[0-9]*[.]?[0-9]+"
EMAIL = "[0-9a-z]+@[0-9a-z]+"
TAG = "<[^<>]+>"
PLUS_MINUS = "[+][/][-]"
SYMBOLS = "[()@$#.:&<>/*+=-^]"
PUNCTUATION = r"\p{Punct}+"
WHITE_SPACE = r"[ \t\n\x0B\f\r]+"

#: Words for numbers, percentages and e-mail addresses; tags and symbols become spaces.
TAGGED: tuple[Step, ...] = (
    F.lower,
    replace(NEWLINE, " "),
    replace(NUMBER, "anynumber"),
    replace(EMAIL, "emailadd"),
    replace("anynumber%", "percentage"),
    replace("anynumberanynumber", "anynumber"),
    replace(TAG, " "),
    replace(PLUS_MINUS, "plusminus"),
    replace(SYMBOLS, " "),
    replace(PUNCTUATION, ""),
)
#: Numbers become spaces, punctuation is dropped.
PLAIN: tuple[Step, ...] = (
    F.lower,
    replace(NEWLINE_OR_FORM_FEED, " "),
    replace(NUMBER, " "),
    replace(PUNCTUATION, ""),
)
PRESETS = {"tagged": TAGGED, "plain": PLAIN}


def collapse_white_space(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, " ")


def clean_text(text: Column, preset: str = "plain", line_ends: bool = False) -> Column:
    """All steps up to stop words and stemming.

    ``line_ends`` leaves line ends in: no later step tells them from spaces, so a text that is
    split on white space next needs one pass less.
    """
    lower, newline, *rest = PRESETS[preset]
    for step in (lower, *rest) if line_ends else (lower, newline, *rest):
        text = step(text)
    return text


def words(text: Column) -> Column:
    """Words of a cleaned text; white space at an end leaves an empty word there."""
    return F.split(text, WHITE_SPACE)


def drop_stop_words(word_array: Column, stop_words: Sequence[str]) -> Column:
    """Punctuation is gone by now, so ``don't`` arrives as ``dont`` and stays."""
    return F.filter(word_array, lambda word: ~word.isin(list(stop_words)))


def normalize_text(
    text: Column,
    preset: str = "plain",
    stop_words: Sequence[str] | None = None,
    stem: bool = False,
) -> Column:
    """Normalised text: white space runs are one space, ends are kept as in the input.

    With ``stop_words`` or ``stem`` the text is rebuilt from its words.
    """
    if not stop_words and not stem:
        return collapse_white_space(clean_text(text, preset))
    found = word_list(clean_text(text, preset, line_ends=True), stop_words, stem)
    return F.array_join(F.filter(found, lambda word: word != ""), " ")


def word_list(text: Column, stop_words: Sequence[str] | None = None, stem: bool = False) -> Column:
    found = words(text)
    if stop_words:
        found = drop_stop_words(found, stop_words)
    if stem:
        from litsieve.functions.stemming import stem_words

        found = stem_words(found)
    return found


def tokens(
    text: Column,
    preset: str = "plain",
    stop_words: Sequence[str] | None = None,
    stem: bool = False,
    min_length: int = 3,
) -> Column:
    """Words of ``min_length`` or more characters of the normalised text."""
    found = word_list(clean_text(text, preset, line_ends=True), stop_words, stem)
    return F.filter(found, lambda word: F.length(word) >= min_length)
