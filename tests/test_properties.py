"""Property tests: the Spark expressions agree with Python's own rules on generated text.

Each property evaluates one batch of generated strings in a single Spark job
(the examples are collected by hypothesis, then checked together).
Exclusions: digit-group underscores ("1_000") and non-ASCII digits, which
Python's int()/float() accept and the parsers here treat as invalid.
"""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from domus.functions.parse import to_double, to_int_strict
from domus.functions.text import title_case

ASCII_TEXT = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=24)
NUMBERISH = st.one_of(
    st.integers(-10**12, 10**12).map(str),
    st.floats(allow_nan=False, allow_infinity=False, width=64).map(repr),
    st.from_regex(r"\A *[+-]?[0-9]{1,6}(\.[0-9]{0,4})? *\Z"),
    st.sampled_from(["", " ", "abc", "3.0", "1e5", "-0", "+7", "nan", "1.2.3", "--1"]),
)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def evaluate(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(expr("v")).orderBy("i").collect()] if values else []


def python_int(s):
    try:
        return int(s) if s not in (None, "") and "_" not in s else None
    except ValueError:
        return None


def python_float(s):
    try:
        v = float(s) if s not in (None, "") and "_" not in s else None
    except ValueError:
        return None
    return None if v is None or math.isnan(v) else v


@SETTINGS
@given(st.lists(ASCII_TEXT, max_size=300))
def test_title_case_equals_python_title(spark, words):
    got = evaluate(spark, words, lambda c: title_case(c))
    assert got == [w.strip().title() for w in words]


@SETTINGS
@given(st.lists(NUMBERISH, max_size=300))
def test_int_parse_equals_python_int(spark, texts):
    got = evaluate(spark, texts, lambda c: to_int_strict(c))
    want = [python_int(t) for t in texts]
    # Python ints are unbounded, the column is a 32-bit int: out-of-range -> NULL here
    want = [w if w is None or -2**31 <= w < 2**31 else None for w in want]
    assert got == want


@SETTINGS
@given(st.lists(NUMBERISH, max_size=300))
def test_double_parse_equals_python_float(spark, texts):
    got = evaluate(spark, texts, lambda c: to_double(c))
    assert got == [python_float(t) for t in texts]
