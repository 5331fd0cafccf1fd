"""Khmer text normalisation as column expressions.

Rewrites with a computed replacement run in Python, in Arrow batches and all passes
of a text at once: expressions over matches are interpreted inside ``transform`` and
took longer (figures in the README).  Everything else stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, number words, months and words of currency and dates.
KHMER_DIGITS = "០១២៣៤៥៦៧៨៩"
DIGIT_WORDS = ["សូន្យ", "មួយ", "ពីរ", "បី", "បួន", "ប្រាំ", "ប្រាំមួយ", "ប្រាំពីរ", "ប្រាំបី", "ប្រាំបួន"]
TENS_WORDS = ["", "ដប់", "ម្ភៃ", "សាមសិប", "សែសិប", "ហាសិប", "ហុកសិប", "ចិតសិប", "ប៉ែតសិប", "កៅសិប"]
UNIT_WORDS = ["សែន", "ម៉ឺន", "ពាន់", "រយ"]
_SILENT = ["", *DIGIT_WORDS[1:]]
#: Words by digit for each of six places.
_BELOW_MILLION = [[w and w + unit for w in _SILENT] for unit in UNIT_WORDS] + [TENS_WORDS, _SILENT]
#: Words by number of the two halves of six places, and by digit.
_THOUSANDS, _ONES = ([a[i // 100] + b[i // 10 % 10] + c[i % 10] for i in range(1000)] for a, b, c in (_BELOW_MILLION[:3], _BELOW_MILLION[3:]))
_DIGITS = {ord(str(i)): w for i, w in enumerate(DIGIT_WORDS)}
MILLION, MINUS, POINT = "លាន", "ដក", "ក្បៀស"
DOLLAR, RIEL = "ដុល្លារ", "រៀល"
MONTHS = ["មករា", "កុម្ភៈ", "មីនា", "មេសា", "ឧសភា", "មិថុនា", "កក្កដា", "សីហា", "កញ្ញា", "តុលា", "វិច្ឆិកា", "ធ្នូ"]
DAY, MONTH, YEAR = "ថ្ងៃទី", "ខែ", "ឆ្នាំ"

# What counts as white space, digit and the patterns rewritten, in their order.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
DIGIT = r"\p{Nd}"
LONG_DATE = rf"{DAY}{SPACE}?({DIGIT}{{1,2}}){SPACE}?{MONTH}({'|'.join(MONTHS)}){SPACE}?{YEAR}{SPACE}?({DIGIT}{{3,4}})"
# (a digit first and then what stands before it: searches skip to digits)
NUMERIC_DATE = rf"({DIGIT}(?<!{DIGIT}{DIGIT}){DIGIT}?)[/-]({DIGIT}{{1,2}})[/-]({DIGIT}{{4}})(?!{DIGIT})"
AMOUNT = rf"({DIGIT}[{DIGIT},]*)(?:\.({DIGIT}+))?"
DOLLARS = rf"\${SPACE}?{AMOUNT}"
RIEL_SIGN = rf"៛{SPACE}?{AMOUNT}"
RIEL_WORD = rf"{AMOUNT}{SPACE}?{RIEL}"
NUMBER = rf"({DIGIT}(?<!{NOT_SPACE}{DIGIT}){DIGIT}*)(?:\.({DIGIT}+))?(?!{NOT_SPACE}*[a-zA-Z])"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression in which ``value`` is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def khmer_digits_to_ascii(text: Column) -> Column:
    return F.translate(text, KHMER_DIGITS, "0123456789")


def _word(words: list[str], digit: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), digit.cast("int"))


def digits_read_out(digits: Column) -> Column:
    """Each digit by its own word."""
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: _word(DIGIT_WORDS, d)), "")


def below_million(six: Column) -> Column:
    """Words of six digits with leading zeros; zero has none."""
    return F.concat(*(_word(t, F.substring(six, i + 1, 1)) for i, t in enumerate(_BELOW_MILLION)))


def number_words(digits: Column) -> Column:
    """Words of a digit string of any length; groups of six are joined by the word for a million."""

    def words(bare: Column) -> Column:
        width = F.ceil(F.length(bare) / 6) * 6
        groups = F.regexp_extract_all(F.lpad(bare, width.cast("int"), F.lit("0")), F.lit("[0-9]{6}"), F.lit(0))
        return F.when(bare == "", F.lit(DIGIT_WORDS[0])).otherwise(F.array_join(F.transform(groups, below_million), MILLION))

    return let(F.regexp_replace(digits, "^0+", ""), words)


def integer_words(number: Column) -> Column:
    """Words of an integer column, or of its decimal text, with a word for minus."""
    text = number.cast("string")
    return F.when(text.startswith("-"), F.concat(F.lit(MINUS), number_words(F.substring(text, 2, 1 << 30)))).otherwise(number_words(text))


def decimal_words(whole: Column, fraction: Column) -> Column:
    """A whole part by its words and a fraction digit by digit; an empty fraction is left out."""
    return F.concat(number_words(whole), F.when(F.coalesce(fraction, F.lit("")) == "", "").otherwise(F.concat(F.lit(POINT), digits_read_out(fraction))))


def _plain(digits: str) -> str:
    return digits if digits.isascii() else "".join(str(unicodedata.digit(c)) for c in digits)


def _spelled(digits: str) -> str:
    """``number_words`` of one string."""
    bare = _plain(digits).lstrip("0")
    if not bare:
        return DIGIT_WORDS[0]
    bare = bare.zfill(-(-len(bare) // 6) * 6)
    return MILLION.join(_THOUSANDS[int(bare[i : i + 3])] + _ONES[int(bare[i + 3 : i + 6])] for i in range(0, len(bare), 6))


def _read_out(fraction: str | None) -> str:
    return POINT + _plain(fraction).translate(_DIGITS) if fraction else ""


def _dated(day: str, month: str, year: str) -> str:
    return f"{DAY}{_spelled(day)} {MONTH}{month} {YEAR}{_spelled(year)}"


def _numeric_date(m: re.Match) -> str:
    month = int(m[2])
    return _dated(m[1], MONTHS[month - 1], m[3]) if 1 <= month <= 12 else m[0]


def _amount(unit: str) -> Callable[[re.Match], str]:
    return lambda m: _spelled(m[1].replace(",", "")) + unit + _read_out(m[2])


#: A pattern, what a text with a match has one of, and the words of a match.
_Pass = tuple[str, tuple[str, ...], Callable[[re.Match], str]]
_DATES: list[_Pass] = [(LONG_DATE, (DAY,), lambda m: _dated(*m.groups())), (NUMERIC_DATE, ("/", "-"), _numeric_date)]
_CURRENCY: list[_Pass] = [(DOLLARS, ("$",), _amount(DOLLAR)), (RIEL_SIGN, ("៛",), _amount(RIEL)), (RIEL_WORD, (RIEL,), _amount(RIEL))]
_NUMBERS: list[_Pass] = [(NUMBER, ("",), lambda m: _spelled(m[1]) + _read_out(m[2]))]


def _rewritten(text: Column, passes: list[_Pass]) -> Column:
    """Every match of the patterns, one after another, replaced by its words."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        ready = [(re.compile(pattern.replace(DIGIT, r"\d")).sub, marks, words) for pattern, marks, words in passes]
        out = texts.to_pylist()
        for i, t in enumerate(out):
            if t is not None:
                for sub, marks, words in ready:
                    if any(mark in t for mark in marks):
                        t = sub(words, t)
                out[i] = t
        return pa.array(out, pa.string())

    return run(text)


def dates(text: Column) -> Column:
    """Long dates, then D/M/Y with either separator; a month outside 1-12 leaves the text as it is."""
    return _rewritten(text, _DATES)


def currency(text: Column) -> Column:
    """Dollars, the riel sign, then amounts before the word for riel."""
    return _rewritten(text, _CURRENCY)


def plain_numbers(text: Column) -> Column:
    """Numbers that start a token without letters."""
    return _rewritten(text, _NUMBERS)


def clean_space(text: Column) -> Column:
    """Runs of spaces and tabs become one space; white space at the ends goes, inner newlines stay."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), rf"^{SPACE}+|{SPACE}+\z", "")


def normalize(text: Column) -> Column:
    """Digits, dates, currency, plain numbers, white space: in that order. Texts without a digit take the short way."""
    ready = F.when(text.rlike(DIGIT), khmer_digits_to_ascii(text))
    return F.coalesce(clean_space(_rewritten(ready, _DATES + _CURRENCY + _NUMBERS)), clean_space(text))


def patched(line: Column, pattern: str, replacement: str) -> Column:
    """A line with every match of a pattern replaced; ``$1`` names a group."""
    return F.regexp_replace(line, pattern, replacement)


def conditional_normalize(text: Column, is_normalized: bool) -> Column:
    """Texts that are declared normal already pass unchanged."""
    return text if is_normalized else normalize(text)
