"""Text normalisation against hand-derived cases and a scanner that walks texts character by character."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X

W = X.DIGIT_WORDS
#: Each expectation is put together here from the word tables, by the rules of the survey.
EXACT = [
    ("តម្លៃ $37", f"តម្លៃ {X.TENS_WORDS[3]}{W[7]}{X.DOLLAR}"),
    ("$4.05 x", f"{W[4]}{X.DOLLAR}{X.POINT}{W[0]}{W[5]} x"),
    ("៛ 812", f"{W[8]}{X.UNIT_WORDS[3]}{X.TENS_WORDS[1]}{W[2]}{X.RIEL}"),
    (f"640,000{X.RIEL}", f"{W[6]}{X.UNIT_WORDS[0]}{W[4]}{X.UNIT_WORDS[1]}{X.RIEL}"),
    ("28-11/1975", f"{X.DAY}{X.TENS_WORDS[2]}{W[8]} {X.MONTH}{X.MONTHS[10]} {X.YEAR}{W[1]}{X.UNIT_WORDS[2]}{W[9]}{X.UNIT_WORDS[3]}{X.TENS_WORDS[7]}{W[5]}"),
    (f"{X.DAY}17{X.MONTH}{X.MONTHS[7]}{X.YEAR}931", f"{X.DAY}{X.TENS_WORDS[1]}{W[7]} {X.MONTH}{X.MONTHS[7]} {X.YEAR}{W[9]}{X.UNIT_WORDS[3]}{X.TENS_WORDS[3]}{W[1]}"),
    ("31/14/1999", f"{X.TENS_WORDS[3]}{W[1]}/14/1999"),
    ("ab7 44 2.71, 15cm 008 -3 6,500 12%", f"ab7 {X.TENS_WORDS[4]}{W[4]} {W[2]}{X.POINT}{W[7]}{W[1]}, 15cm {W[8]} -3 {W[6]},500 {X.TENS_WORDS[1]}{W[2]}%"),
    ("\v q \t\t r\n s ", "q r\n s"),
    ("៤៥", f"{X.TENS_WORDS[4]}{W[5]}"),
    ("2000008", f"{W[2]}{X.MILLION}{W[8]}"),
    ("3000000000004", f"{W[3]}{X.MILLION}{X.MILLION}{W[4]}"),
    (None, None),
    ("", ""),
]


@pytest.fixture(scope="module")
def normalized(spark):
    def run(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.n for r in rows.select("i", X.normalize(F.col("t")).alias("n")).orderBy("i").collect()]

    return run


def test_derived_cases(normalized):
    assert normalized([t for t, _ in EXACT]) == [n for _, n in EXACT]


def words(digits):
    """Number words by splitting off six digits at a time from the right."""
    digits = digits.lstrip("0")
    if not digits:
        return W[0]
    groups = []
    while digits:
        digits, six = digits[:-6], digits[-6:].rjust(6, "0")
        high = "".join(W[int(d)] + u for d, u in zip(six, X.UNIT_WORDS) if d != "0")
        groups.append(high + X.TENS_WORDS[int(six[4])] + ("" if six[5] == "0" else W[int(six[5])]))
    return X.MILLION.join(reversed(groups))


def test_number_words(spark):
    r = random.Random(1)
    numbers = [*range(130), *(r.randint(0, 10 ** r.randint(1, 18)) for _ in range(600)), -5, -(10**6), 10**12, 10**12 + 7]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    assert [x.w for x in rows.select(X.integer_words(F.col("n")).alias("w")).collect()] == [(X.MINUS if n < 0 else "") + words(str(abs(n))) for n in numbers]
    digits = ["", "0000", "007", "1" * 25, "9" * 31]
    rows = spark.createDataFrame([(d,) for d in digits], "d string")
    assert [x.w for x in rows.select(X.number_words(F.col("d")).alias("w")).collect()] == [words(d) for d in digits]


class Scanner:
    """A cursor over a text; every reading method gives what it has read, or None and stays."""

    def __init__(self, text, at=0):
        self.text, self.at = text, at

    def literal(self, s):
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return s
        return None

    def run(self, accept, least, most=1 << 30):
        end = self.at
        while end < len(self.text) and end - self.at < most and accept(self.text[end]):
            end += 1
        if end - self.at < least:
            return None
        got, self.at = self.text[self.at : end], end
        return got

    def space(self):
        return self.run(str.isspace, 0, 1)

    def fraction(self):
        at = self.at
        got = self.run(is_digit, 1) if self.literal(".") else None
        if got is None:
            self.at = at
        return got


def is_digit(c):
    return unicodedata.category(c) == "Nd"


def plain(digits):
    return "".join(str(unicodedata.digit(c)) for c in digits)


def replaced(text, read):
    """The text with what ``read`` makes of each place, from left to right without overlap."""
    out, at = "", 0
    while at < len(text):
        end, new = read(text, at) or (at + 1, text[at])
        out, at = out + new, end
    return out


def dated(day, month, year):
    return f"{X.DAY}{words(plain(day))} {X.MONTH}{month} {X.YEAR}{words(plain(year))}"


def long_date(text, at):
    s = Scanner(text, at)
    if s.literal(X.DAY) is None:
        return None
    s.space()
    day = s.run(is_digit, 1, 2)
    s.space()
    if day is None or s.literal(X.MONTH) is None:
        return None
    month = next((m for m in X.MONTHS if s.literal(m)), None)
    s.space()
    if month is None or s.literal(X.YEAR) is None:
        return None
    s.space()
    year = s.run(is_digit, 3, 4)
    return (s.at, dated(day, month, year)) if year else None


def numeric_date(text, at):
    if at and is_digit(text[at - 1]):
        return None
    s, parts = Scanner(text, at), []
    for most in (2, 2):
        parts.append(s.run(is_digit, 1, most))
        if parts[-1] is None or not (s.literal("/") or s.literal("-")):
            return None
    year = s.run(is_digit, 4)
    if year is None or len(year) != 4:
        return None
    month = int(plain(parts[1]))
    return s.at, dated(parts[0], X.MONTHS[month - 1], year) if 1 <= month <= 12 else text[at : s.at]


def amount(s):
    whole = s.run(lambda c: is_digit(c) or c == ",", 1)
    if whole is None or whole[0] == ",":
        return None
    return whole, s.fraction()


def spoken(found, unit):
    whole, fraction = found
    return words(plain(whole.replace(",", ""))) + unit + (X.POINT + "".join(W[int(d)] for d in plain(fraction)) if fraction else "")


def signed(sign, unit):
    def read(text, at):
        s = Scanner(text, at)
        if s.literal(sign) is None:
            return None
        s.space()
        found = amount(s)
        return (s.at, spoken(found, unit)) if found else None

    return read


def riel_word(text, at):
    s = Scanner(text, at)
    found = amount(s)
    if found is None:
        return None
    s.space()
    return (s.at, spoken(found, X.RIEL)) if s.literal(X.RIEL) else None


def plain_number(text, at):
    if at and not text[at - 1].isspace():
        return None
    s = Scanner(text, at)
    whole = s.run(is_digit, 1)
    if whole is None:
        return None
    fraction, end = s.fraction(), at
    while end < len(text) and not text[end].isspace():
        end += 1
    if any("a" <= c.lower() <= "z" and c.isascii() for c in text[s.at : end]):
        return None
    return s.at, words(plain(whole)) + (X.POINT + "".join(W[int(d)] for d in plain(fraction)) if fraction else "")


def model(text):
    text = "".join(str(X.KHMER_DIGITS.index(c)) if c in X.KHMER_DIGITS else c for c in text)
    for read in (long_date, numeric_date, signed("$", X.DOLLAR), signed("៛", X.RIEL), riel_word, plain_number):
        text = replaced(text, read)
    out = ""
    for c in text:
        if c not in " \t":
            out += c
        elif not out.endswith(" "):
            out += " "
    return out.strip()


def test_scanner_agrees_on_drawn_texts(normalized):
    r = random.Random(2)
    bits = ["9", "61", "013", "1987", "4,200", "8.25", ".", ",", "/", "-", "30/06/1987", "$", "៛", X.RIEL, " ", " ", "\t", "\n", "\xa0", "\x1c", X.DAY, X.MONTH + X.MONTHS[5], X.YEAR, "q", "kg", "៣", "٧", "។", "%"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    assert normalized(texts) == [model(t) for t in texts]


def test_digits_beyond_two_bytes(normalized):
    texts = ["𝟘", "x 𝟙𝟚.𝟛", "$𝟙𝟚", "𝟙/𝟚/𝟙𝟡𝟠𝟟", "𝟜𝟝q"]
    assert normalized(texts) == [model(t) for t in texts]


def test_nothing_is_interpreted_by_match(spark):
    """Lambdas over matches are interpreted; a text's rewrites are one call in an Arrow batch."""
    rows = spark.createDataFrame([("5",)], "t string").select(X.normalize(F.col("t")).alias("n"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("run(") == 1


def test_conditional(spark):
    rows = spark.createDataFrame([("6 y",)], "t string")
    (row,) = rows.select(X.conditional_normalize(F.col("t"), True).alias("a"), X.conditional_normalize(F.col("t"), False).alias("b")).collect()
    assert row.a == "6 y" and row.b == f"{W[6]} y"
