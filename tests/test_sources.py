"""CSV with inferred types: as pandas infers them, whatever rows come first."""

import pandas as pd
import pytest

from patronlens.sources.tables import infer_types, read_csv_inferred

KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
AWKWARD = {
    "whole": ["1", "-2", "+3", "0"],
    "holes": ["1", "", "3", "NA"],
    "decimal": ["1", "2.5", "-.5", "1e3"],
    "late": ["1", "2", "3", "x"],
    "empty": ["", "", "NaN", "null"],
    "truth": ["True", "FALSE", "true", "False"],
    "truth_holes": ["True", "", "False", "True"],
    "marks": ["n/a", "N/A", "#N/A", "4"],
    "huge": ["9223372036854775807", "-9223372036854775808", "0", "1"],
    "too_huge": ["9.3e18", "1", "2", "3"],
    "quoted": ["a,b", 'say ""x""', "plain", "é"],
    "zeros": ["007", "08", "1", "2"],
    "mixed": ["True", "1", "0", "x"],
    "infinite": ["inf", "-inf", "1", "2"],
    "spaced": [" 1", "2 ", "3", "4"],
}


def written(tmp_path, columns, name="t.csv"):
    path = tmp_path / name
    rows = zip(*columns.values())
    lines = [",".join(columns), *(",".join(f'"{v}"' if "," in v or '"' in v else v for v in row) for row in rows)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_types_are_those_of_pandas(spark, tmp_path):
    path = written(tmp_path, AWKWARD)
    expected = pd.read_csv(path)
    found = read_csv_inferred(spark, path)
    assert dict(found.dtypes) == {c: KINDS[str(t)] for c, t in expected.dtypes.items()}
    rows = found.collect()
    for c in AWKWARD:
        values = [None if pd.isna(v) else str(v) for v in expected[c]] if KINDS[str(expected[c].dtype)] == "string" else list(expected[c])
        got = [r[c] for r in rows]
        assert [g is None or g != g for g in got] == [bool(pd.isna(v)) for v in values]
        assert all(g == v for g, v in zip(got, values) if not pd.isna(v)), c


def test_the_last_of_many_rows_decides(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(6):
        written(folder, {"a": [str(x) for x in range(500)] + (["2.5"] if i == 5 else ["7"]), "b": ["1"] * 501}, f"p{i}.csv")
    found = read_csv_inferred(spark, str(folder))
    assert found.dtypes == [("a", "double"), ("b", "bigint")] and found.count() == 6 * 501


def test_dates(spark, tmp_path):
    path = written(tmp_path, {"day": ["2024-02-29", "", "1999-01-01"], "no_day": ["2024-02-30", "2024-01-01", "2024-01-02"]})
    assert read_csv_inferred(spark, path).dtypes == [("day", "date"), ("no_day", "string")]
    assert read_csv_inferred(spark, path, dates=False).dtypes == [("day", "string"), ("no_day", "string")]


def test_line_breaks_in_values(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,one\n')
    rows = read_csv_inferred(spark, str(path), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, "one")]


def test_no_rows(spark, tmp_path):
    assert read_csv_inferred(spark, written(tmp_path, {"a": [], "b": []})).dtypes == [("a", "double"), ("b", "double")]


def test_names_that_need_quoting(spark):
    df = spark.createDataFrame([("1", "x")], ["a.b", "c d"])
    assert infer_types(df) == {"a.b": "bigint", "c d": "string"}


@pytest.mark.parametrize("kind", ["ClvModel", "SegmentModel"])
def test_out_of_fold(spark, training, customers, kind):
    """Every row is predicted once, by a model that has not seen its fold."""
    from conftest import SMALL

    from checks.queries import staged_features
    from patronlens.operators import models
    from patronlens.operators.models import SegmentModel
    from patronlens.operators.split import mark_folds

    table = staged_features(spark, "/root/testdata/sf0.001")
    model = getattr(models, kind)(**SMALL["segments" if kind == "SegmentModel" else "clv"])
    found = model.out_of_fold(table, folds=3)
    assert found.count() == table.count() == found.select("customer_id").distinct().count()
    folds = {r["customer_id"]: r["fold"] for r in mark_folds(table, 3).select("customer_id", "fold").collect()}
    assert {r["customer_id"]: r["fold"] for r in found.collect()} == folds
    if not isinstance(model, SegmentModel):
        rest = mark_folds(table, 3)
        alone = type(model)(**model.params).fit(rest.where("fold <> 1")).transform(rest.where("fold = 1"))
        expected = {r["customer_id"]: r["predicted_clv"] for r in alone.collect()}
        assert {r["customer_id"]: r["predicted_clv"] for r in found.where("fold = 1").collect()} == pytest.approx(expected)
