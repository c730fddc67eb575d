import random
import re

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("(a]", "(a)"), ("(a", "a"), ("b)", "b"), ("don't", "dont"), ('say "hi"', "say hi"), ("(don't)", "don't'"), ("", ""), ("「a）", "「a」")],
)
def test_bracket_repair(spark, given, want):
    assert one(spark, T.bracket_repair(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("abab", "ab"), ("aaaa", "a"), ("abaab" , "abaab"), ("", ""), ("x", "x")])
def test_repeat_unit(spark, given, want):
    assert one(spark, T.repeat_unit(F.col("t")), t=given) == want


def test_repeat_shrink(spark):
    assert one(spark, T.repeat_shrink(F.col("s"), F.col("d")), s="HELLO there you", d="hahahaha") == "HAHAHahahahaha"[:14]


@pytest.mark.parametrize(
    ("given", "want"),
    [("a  b", "a b"), ("text.text", "text. text"), ("wait ! ! . .", "wait!!.."), ("hello .", "hello."), ("well ... then", "well... then")],
)
def test_output_clean(spark, given, want):
    assert one(spark, T.output_clean(F.col("t")), t=given) == want


def test_tag_normalize(spark):
    assert one(spark, T.tag_normalize(F.col("t")), t="< |l0 |> a <|  O2|> b") == "<|10|> a <|02|> b"


@pytest.mark.parametrize(
    ("given", "times", "want"),
    [("aaaaa", 5, "char"), ("no no no no no", 5, "segment"), ("one two three", 5, None), ("", 5, None), ("a b c a b d a b e f g", 5, "phrase"), ("a b c d e f g h i j k", 5, None)],
)
def test_repetition_kind(spark, given, times, want):
    assert one(spark, T.repetition_kind(F.col("t"), times), t=given) == want


def test_pattern_repeat(spark):
    assert one(spark, T.pattern_repeat(F.col("t"), 20), t="x" + "ab" * 20) == 2
    assert one(spark, T.pattern_repeat(F.col("t"), 20), t="abc") is None
    assert one(spark, T.pattern_squeeze(F.col("t"), 20), t="x" + "ab" * 25 + "y") == "xaby"


def test_java_replacement(spark):
    assert T.java_replacement("$1") == r"\$1"
    assert one(spark, T.dict_apply(F.col("t"), [(r"(a)(b)", r"\2\1")]), t="xaby") == re.sub("(a)(b)", r"\2\1", "xaby")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("hello there", ["HELLO", "THERE"]),
        ("I am here", ["I AM", "HERE"]),
        ("stop.now then", ["STOP.", "NOW", "THEN"]),
        ("one", ["ONE"]),
        ("elephants a rose", ["ELEPHANTS", "A ROSE"]),
        ("cats to elephants", ["CATS TO", "ELEPHANTS"]),
    ],
)
def test_word_segments(spark, given, want):
    assert one(spark, T.word_segments(F.col("t")), t=given) == want


def test_period_and_repeated_size_by_loops():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choices("ab", k=rnd.randrange(9))) * rnd.randrange(1, 9) + rnd.choice(["", "a", "ba"])
        if text:
            assert T.period(text) == next(k for k in range(1, len(text) + 1) if text[k:] == text[: len(text) - k])
        for times in (2, 3, 5):
            want = next((k for k in range(1, len(text) // times + 1) for i in range(len(text) - times * k + 1) if text[i : i + times * k] == text[i : i + k] * times), None)
            assert T.repeated_size(text, times) == want
    assert T.period("") == 0 and T.repeated_size("é😀" * 20 + "x", 20) == 2
