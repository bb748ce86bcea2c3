"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980).

Spark has no stemmer. Whole token arrays go to Python in Arrow batches; each batch is
dictionary-encoded first, so Python code runs once per distinct word of a batch.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsieve.session import ship_package

_CONSONANT = "[^aeiou]"
_VOWEL = "[aeiouy]"
_C = _CONSONANT + "[^aeiouy]*"
_V = _VOWEL + "[aeiou]*"
_MEASURE_OVER_0 = re.compile(f"^(?:{_C})?{_V}{_C}")
_MEASURE_IS_1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_MEASURE_OVER_1 = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(f"^(?:{_C})?{_VOWEL}")
_ENDS_CVC = re.compile(f"^{_C}{_VOWEL}[^aeiouwxy]$")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")

# Suffix tables of steps 2, 3 and 4 of the paper.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@functools.lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of one lower-case word; words of one or two letters are kept."""
    if len(word) < 3:
        return word
    initial_y = word[0] == "y"
    if initial_y:
        word = "Y" + word[1:]
    # step 1a: plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # step 1b: past tense and gerund
    if word.endswith("eed"):
        if _MEASURE_OVER_0.match(word[:-3]):
            word = word[:-1]
    else:
        ending = _longest(word, ("ed", "ing"))
        if ending and _HAS_VOWEL.match(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _DOUBLE.search(word):
                word = word[:-1]
            elif _ENDS_CVC.match(word):
                word += "e"
    # step 1c
    if word.endswith("y") and _HAS_VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    # steps 2 and 3: derivational suffixes
    for table in (_STEP_2, _STEP_3):
        ending = _longest(word, table)
        if ending and _MEASURE_OVER_0.match(word[: -len(ending)]):
            word = word[: -len(ending)] + table[ending]
    # step 4: bare suffixes of long stems
    ending = _longest(word, _STEP_4)
    if ending:
        stem = word[: -len(ending)]
        if _MEASURE_OVER_1.match(stem) and (ending != "ion" or stem.endswith(("s", "t"))):
            word = stem
    # step 5: final e and double l
    if word.endswith("e"):
        stem = word[:-1]
        if _MEASURE_OVER_1.match(stem) or (_MEASURE_IS_1.match(stem) and not _ENDS_CVC.match(stem)):
            word = stem
    if word.endswith("ll") and _MEASURE_OVER_1.match(word):
        word = word[:-1]
    return "y" + word[1:] if initial_y else word


def _stem_values(values: pa.Array) -> pa.Array:
    encoded = pc.dictionary_encode(values)
    stems = pa.array([None if w is None else porter(w) for w in encoded.dictionary.to_pylist()], pa.string())
    return stems.take(encoded.indices)


@F.arrow_udf(T.StringType())
def _stem_word(batch: pa.Array) -> pa.Array:
    return _stem_values(batch)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_word_lists(batch: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    ends = lengths.cumsum()
    offsets = pa.array([0, *ends.tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, _stem_values(batch.flatten()), mask=batch.is_null())


def stem_word(word: Column) -> Column:
    ship_package()
    return _stem_word(word)


def stem_words(word_array: Column) -> Column:
    ship_package()
    return _stem_word_lists(word_array)
