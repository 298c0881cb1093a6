import pytest

from weft.functions.expr import Compiler, ExpressionError, parse, variables
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(7, 2, "marko", [1, 2], None)], "a long, b long, s string, xs array<long>, n long")


def value(df, text):
    c = Compiler(df, lambda tag, prop: F.col(prop or tag))
    return df.select(c.projection(text).alias("v")).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("@a + @b * 2", 11), ("(@a + @b) * 2", 18), ("@a / @b", 3), ("-@a / @b", -3), ("@a % 4", 3), ("@a / 2.0", 3.5), ("@a / 0", None),
    ("@b ^^ 3", 8), ("@b ^^ -1", 0.5), ("@a & 3 + 1", 4), ("@a | 8", 15), ("@a ^ 1", 6), ("1 << 4", 16), ("@a >> 1", 3),
    ("@a within [7, 8]", True), ("@a without [7, 8]", False), ("@xs within [1, 2, 3]", True), ("@xs within [1]", False), ("@a within @xs", False),
    ('@s startswith "ma"', True), ('@s endswith "x"', False), ("@a > 3 && !(@b == 2)", False), ("@a > 30 || @b == 2", True), ("@n + 1", None),
    ("[@a, @b]", [7, 2]), ("{@a, @b}", {"a": 7, "b": 2}), ("9007199254740993 / 1", 9007199254740993), ("true", True),
])
def test_values(df, text, expected):
    assert value(df, text) == expected


@pytest.mark.parametrize("text, kept", [("@n", 0), ("@a", 1), ("!(@n > 1)", 0), ("@n > 1 || @a == 7", 1), ("@n > 1 && @a == 7", 0)])
def test_predicates(df, text, kept):
    assert df.where(Compiler(df, lambda tag, prop: F.col(prop or tag)).predicate(text)).count() == kept


@pytest.mark.parametrize("text", ["", "@a = 3", "(@a", "@a @b", "1 +", "[1, 2"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_variables():
    assert variables(parse("@a.x + @.y > @b.~len && @c")) == {("a", "x"), (None, "y"), ("b", "~len"), ("c", None)}
