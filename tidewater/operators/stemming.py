"""Suffix stripping (X4) after Porter (1980), as column expressions over the distinct tokens of a corpus.

A word is read as vowels and consonants; y is a vowel after a consonant. The measure of a stem is how
often a vowel is followed by a consonant in it. Each step looks for the longest of its suffixes
that the word ends in and replaces it if the rest meets the step's condition. The vocabulary is stemmed once
and joined back to the tokens. Words of two letters or fewer and words with other letters than a to z stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V = r"(?:[aeiou]|(?<=[^aeiou])y)"
_C = r"(?:[^aeiouy]|(?<![^aeiou])y)"
MEASURE_1 = f"^{_C}*{_V}+{_C}"
MEASURE_2 = f"^{_C}*{_V}+{_C}+{_V}+{_C}"
HAS_VOWEL = _V
DOUBLE = r"([^aeiou])\1$"
SHORT_END = f"{_C}{_V}[^aeiouwxy]$"

# The published rules of steps 2 to 4, a suffix and what takes its place.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
          "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
          "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _rest(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _longest(w: Column, rules: dict[str, str], condition: str, extra: dict[str, Column] | None = None) -> Column:
    """The word after the rule of its longest suffix."""
    out = None
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        rest = _rest(w, suffix)
        good = rest.rlike(condition)
        if extra and suffix in extra:
            good = good & extra[suffix]
        new = F.when(good, F.concat(rest, F.lit(rules[suffix]))).otherwise(w)
        out = F.when(w.endswith(suffix), new) if out is None else out.when(w.endswith(suffix), new)
    return out.otherwise(w)


def _tidy(w: Column) -> Column:
    """What follows where step 1b took a suffix away."""
    return (F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
            .when(w.rlike(DOUBLE) & ~w.rlike("[lsz]$"), _rest(w, "x"))
            .when(w.rlike(MEASURE_1) & ~w.rlike(MEASURE_2) & w.rlike(SHORT_END), F.concat(w, F.lit("e"))).otherwise(w))


def stem_table(words: DataFrame, token: str = "token") -> DataFrame:
    """(token, lemma) of distinct lower-case words; each step is a projection of the one before."""
    def step(df: DataFrame, make) -> DataFrame:
        return df.select("token", make(F.col("w")).alias("w"))

    df = words.select(F.col(token).alias("token")).distinct().select("token", F.col("token").alias("w"))
    whole = F.col("token").rlike("^[a-z]{3,}$")
    df = step(df, lambda w: F.when(w.endswith("sses") | w.endswith("ies"), _rest(w, "es")).when(w.endswith("ss"), w).when(w.endswith("s"), _rest(w, "s")).otherwise(w))
    df = step(df, lambda w: F.when(w.endswith("eed"), F.when(_rest(w, "eed").rlike(MEASURE_1), _rest(w, "d")).otherwise(w))
              .when(w.endswith("ed") & _rest(w, "ed").rlike(HAS_VOWEL), _tidy(_rest(w, "ed")))
              .when(w.endswith("ing") & _rest(w, "ing").rlike(HAS_VOWEL), _tidy(_rest(w, "ing"))).otherwise(w))
    df = step(df, lambda w: F.when(w.endswith("y") & _rest(w, "y").rlike(HAS_VOWEL), F.concat(_rest(w, "y"), F.lit("i"))).otherwise(w))
    df = step(df, lambda w: _longest(w, STEP_2, MEASURE_1))
    df = step(df, lambda w: _longest(w, STEP_3, MEASURE_1))
    df = step(df, lambda w: _longest(w, dict.fromkeys(STEP_4, ""), MEASURE_2, {"ion": _rest(w, "ion").rlike("[st]$")}))
    rest = _rest(F.col("w"), "e")
    df = step(df, lambda w: F.when(w.endswith("e") & (rest.rlike(MEASURE_2) | (rest.rlike(MEASURE_1) & ~rest.rlike(SHORT_END))), rest).otherwise(w))
    df = step(df, lambda w: F.when(w.endswith("ll") & w.rlike(MEASURE_2), _rest(w, "l")).otherwise(w))
    return df.select("token", F.when(whole, F.col("w")).otherwise(F.col("token")).alias("lemma"))


def stemmed(docs: DataFrame, tokens: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """The documents with every token replaced by its stem, in order."""
    from tidewater.operators.text import exploded, normalize_tokens
    return normalize_tokens(docs, stem_table(docs.select(F.explode(exploded(tokens)).alias("token"))), id_col)
