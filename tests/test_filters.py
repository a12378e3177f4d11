import datetime as dt

import pytest

from matchloom.operators import filters

ROWS = [(1, "Apple", "x"), (2, "apple pie", None), (3, None, "y"), (4, "", "x"), (5, "Banana", "true")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, `na.me` string, flag string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


F = "na.me"


@pytest.mark.parametrize(
    ("conds", "want"),
    [
        ([], [1, 2, 3, 4, 5]), ([{"field": F, "op": "eq", "value": "Apple"}], [1]), ([{"field": F, "op": "neq", "value": "Apple"}], [2, 4, 5]),
        ([{"field": F, "op": "starts_with", "value": "apple", "ignore_case": True}], [1, 2]), ([{"field": F, "op": "not_starts_with", "value": "A"}], [2, 4, 5]),
        ([{"field": F, "op": "contains", "value": "an"}], [5]), ([{"field": F, "op": "contains_any", "values": ["pie", "Ban"]}], [2, 5]), ([{"field": F, "op": "contains_any", "values": []}], []),
        ([{"field": F, "op": "is_null"}], [3]), ([{"field": F, "op": "is_not_null"}], [1, 2, 4, 5]), ([{"field": "flag", "op": "eq", "value": True}], [5]), ([{"field": "id", "op": "eq", "value": 3}], [3]),
        ([{"field": F, "op": "is_null"}, {"field": "flag", "op": "eq", "value": "x", "join": "or"}], [1, 3, 4]), ([{"field": F, "op": "is_null"}, {"join": "or"}, {"field": "id", "op": "eq", "value": 1}], [1, 3]),
    ],
)
def test_operators(df, conds, want):
    assert ids(df.where(filters.condition(conds))) == want


def test_unknown_operator():
    with pytest.raises(ValueError, match="unknown filter"):
        filters.condition([{"field": "x", "op": "like"}])


def test_populations(df):
    specs = {
        "a": {"source": "s", "filter": [{"field": F, "op": "contains", "value": "pple"}]}, "junk": {"source": "s", "action": "exclude", "filter": [{"field": "id", "op": "eq", "value": 5}]},
        "rest": {"source": "s"}, "p": {"source": "_previous_matched"},
    }
    got = filters.populations(specs, {"s": df})
    assert ids(got["rest"]) == [4], "a null is in neither"
    assert "p" not in got and ids(filters.populations(specs, {"s": df}, df.limit(0))["p"]) == []


AS_OF = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize(
    ("dates", "want"),
    [
        (["05/01/2024 10:00:00", "05/01/2020 10:00:00", None, "x"], [0]), (["5/1/2024", "2024-05-01"], [0]), (["2024-05-01 01:02:03.5", "2020-01-01 00:00:00"], [0]), (["2024-05-01", "2019-01-01"], [0]),
        (["2024.05.01", "2019.01.01"], [0]), (["2022-06-02", "2022-06-01"], [0]),
    ],
)
def test_date_gate(spark, dates, want):
    df = spark.createDataFrame(list(enumerate(dates)), "id int, d string")
    assert ids(filters.date_gate(df, "d", 2, AS_OF)) == want


def test_old_gate_becomes_a_filter():
    assert filters.step_filters({"date_gate": {"field": "d", "max_age_years": 3}}) == [{"field": "d", "op": "max_age_years", "value": 3, "applies_to": "destination"}]


def test_exclusions(df, tmp_path):
    (tmp_path / "ids.csv").write_text("1\n 2 \n\n")
    assert filters.excluded_values({"values": [5], "file": "ids.csv"}, tmp_path) == ["1", "2", "5"]
    assert ids(filters.exclude(df, "id", ["1", "2", "5"])) == [3, 4]
    assert ids(filters.exclude(df, F, ["Apple"])) == [2, 4, 5], "rows without the field go too"
    assert ids(filters.exclude(df, F, [f"n{i}" for i in range(2000)])) == [1, 2, 4, 5]
    assert ids(filters.exclude(df, "absent", ["1"])) == [1, 2, 3, 4, 5]


def test_exclusion_files(tmp_path):
    (tmp_path / "e.csv").write_text("﻿step,vnd_id,note\nA,1,x\nA,2,\nB, 3 ,\n,4,\n")
    assert filters.read_exclusions("e.csv", tmp_path) == {"A": ["1", "2"], "B": ["3"]}
    (tmp_path / "f.csv").write_text("step,a,b\nA,1,2\n")
    assert filters.read_exclusions({"file": "f.csv", "id_column": "b"}, tmp_path) == {"A": ["2"]}
    with pytest.raises(ValueError, match="name the id column"):
        filters.read_exclusions("f.csv", tmp_path)
    with pytest.raises(ValueError, match="no column c"):
        filters.read_exclusions({"file": "f.csv", "id_column": "c"}, tmp_path)
