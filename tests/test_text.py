import pytest
from pyspark.sql import functions as F

from matchloom.functions import text


def apply(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


NAMES = ["  ACME, Inc.  ", "Foo-Bar  GmbH", "a:b;c.d,e", None, "", ",.;:", " Nb sp ", "É-À  ü", "tab\tnl\n x", "--", "\x1csep\x1f"]


def test_clean_equals_its_python_form(spark):
    assert apply(spark, text.clean, NAMES) == [text.tier_value("clean", v) for v in NAMES]
    assert apply(spark, text.clean, NAMES)[:3] == ["acme inc", "foo bar gmbh", "abcde"]


ALIASES, STOP = {"airlines ag": "airlines", "st": "street $9", "a.b": "x"}, ["inc", "the"]


def test_normalized(spark):
    values = ["Swiss Airlines AG", "The Best Inc", "Main St", "Stay st, ST", "a.b axb", None, "the inc", "\\Q x \\E"]
    got = apply(spark, lambda c: text.normalized(c, ALIASES, STOP), values)
    assert got == [text.tier_value("normalized", v, ALIASES, STOP) for v in values]
    assert got[:3] == ["swiss airlines", "best", "main street $9"]


def test_tiers_by_name(spark):
    assert apply(spark, lambda c: text.tier("raw", c), ["A, b"]) == ["A, b"]
    with pytest.raises(ValueError, match="unknown tier"):
        text.tier("other", F.lit(""))
    with pytest.raises(ValueError, match="unknown tier"):
        text.tier_value("other", "")


def test_prefixes_and_tie_keys(spark):
    assert apply(spark, lambda c: text.strip_prefix(c, "alpha"), ["S100", "100", "AB"]) == ["100", "100", ""]
    assert apply(spark, lambda c: text.strip_prefix(c, "^S0*"), ["S007", "XS007"]) == ["7", "XS007"]
    assert apply(spark, lambda c: text.tie_key(c, "alpha"), ["S1000", "S 5 ", "UNKNOWN", None]) == [1000, 5, text.UNPARSED, text.UNPARSED]
    assert apply(spark, lambda c: text.tie_key(c, ""), ["b", None]) == ["b", None]


def test_numbers(spark):
    assert apply(spark, text.as_number, ["2.50", "1d", "1e3", "-3", ".5", "", "9-1"]) == [2.5, None, 1000.0, -3.0, 0.5, None, None]


def test_tokens(spark):
    assert apply(spark, text.tokens, ["a  b-c ", "", None]) == [["a", "b-c"], [], None]
    assert apply(spark, lambda c: text.tokens(c, "clean"), ["A, B-c."]) == [["a", "b-c"]]


def test_nfkc(spark):
    assert apply(spark, text.nfkc, ["ﬁ", "é", None]) == ["fi", "é", None]
