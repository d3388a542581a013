"""Column functions on text: word split, CJK isolation, clean-up, folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The end-of-word and unknown tokens.
EOW, UNK = "<|w|>", "<|unk|>"
#: Fixed value: words are parted by ASCII white space only.
WORD = r"([^ \t\n\r\f\x0B]+)"
#: Fixed value: scripts whose characters stand alone.
CJK = r"\p{IsHan}\p{IsKatakana}\p{IsHiragana}\p{IsHangul}"
#: All of these lie here; asked first, since a character's script is looked up slowly.
FAR = r"\x{1100}-\x{10FFFF}"
#: Marks around a token inside a string of tokens, and what stands for them and for the escape in a text.
ESCAPE, OPEN, CLOSE = "\x01", "\x02", "\x03"
ESCAPES = ((ESCAPE, ESCAPE + "a"), (OPEN, ESCAPE + "b"), (CLOSE, ESCAPE + "c"))


def isolate_cjk(text: Column) -> Column:
    """Put a space on each side of every CJK character."""
    return F.regexp_replace(text, f"([{FAR}&&[{CJK}]])", " $1 ")


def split_words(text: Column) -> Column:
    """Words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), 1)


def join_cjk(text: Column) -> Column:
    """Delete white space before and after CJK characters."""
    before = F.regexp_replace(text, rf"\s+([{CJK}])", "$1")
    return F.regexp_replace(before, rf"([{CJK}])\s+", "$1")


def escaped(token: str) -> str:
    """A token in which the marks can't occur; escaping character by character or all at once is the same."""
    for plain_, safe in ESCAPES:
        token = token.replace(plain_, safe)
    return token


def plain(token: str) -> str:
    """The token that was escaped."""
    for plain_, safe in reversed(ESCAPES):
        token = token.replace(safe, plain_)
    return token


def escape(token: Column) -> Column:
    for plain_, safe in ESCAPES:
        token = F.replace(token, F.lit(plain_), F.lit(safe))
    return token


def unescape(token: Column) -> Column:
    for plain_, safe in reversed(ESCAPES):
        token = F.replace(token, F.lit(safe), F.lit(plain_))
    return token


def wrap(tokens: Column) -> Column:
    """An array of tokens as one string in which literal replacement merges pairs."""
    marked = F.array_join(tokens, "").rlike("[\x01-\x03]")
    safe = F.when(marked, F.transform(tokens, escape)).otherwise(tokens)
    return F.concat(F.lit(OPEN), F.array_join(safe, CLOSE + OPEN), F.lit(CLOSE))


def unwrap(tokens: Column) -> Column:
    """The array again."""
    safe = F.filter(F.split(F.translate(tokens, OPEN, ""), CLOSE), lambda t: t != "")
    return F.when(F.contains(tokens, F.lit(ESCAPE)), F.transform(safe, unescape)).otherwise(safe)


def characters(word: Column) -> Column:
    """Code points of a word and the end-of-word token."""
    return F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit(EOW)))


def byte_tokens(word: Column) -> Column:
    """UTF-8 bytes of a word in hexadecimal, and the end-of-word token."""
    raw = F.hex(F.encode(word, "UTF-8"))
    return F.concat(F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(raw, i * 2 - 1, 2)), F.array(F.lit(EOW)))


def fold_lines(text: Column) -> Column:
    """Line breaks and runs of spaces as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(\r?\n)+", " "), " +", " "))


def summary(text: Column, limit: int = 180) -> Column:
    """A folded text cut to ``limit`` characters, the dots included."""
    folded = fold_lines(text)
    return F.when(F.length(folded) > limit, F.concat(F.left(folded, F.lit(limit - 3)), F.lit("..."))).otherwise(folded)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def sentence(text: Column) -> Column:
    """A unigram model's sentence: NFKC, one mark in place of white space, and one in front; empty stays empty."""
    folded = F.trim(F.regexp_replace(nfkc(text), r"[\s\x0B]+", " "))
    return F.when(folded != "", F.concat(F.lit("▁"), F.translate(folded, " ", "▁"))).otherwise("")
