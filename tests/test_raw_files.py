"""The CSV path end to end, and exact quantiles."""
import random

import numpy as np
import pytest

from quillon.operators import clean as C
from quillon.operators import quantiles as Q
from quillon.operators import raw_files as RF

HEADER = "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION"
LINES = ["2020-01-01,,p1,e2,c1,first", "2020-01-01,,p1,e1,c1,duplicate", "2020-01-02,,p2", "2020-01-02,,p2,e3,c2,long,extra",
         ',,p3,e4,c3,"no, start"', "1850-01-01,,p4,e5,c4,early", "soon,,p5,e6,c5,no date", '2021-05-06,2021-06-01,p6,e7,c6,"a, b"']


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "conditions.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    return tmp_path


def test_csv_round_trip(spark, folder):
    path = f"file:{folder}"
    (report,) = RF.validate_all(spark, path, {"conditions": C.REQUIRED_RAW["conditions"]})
    size = (folder / "csv" / "conditions.csv").stat().st_size
    assert (report.table, report.rows, report.malformed, report.bytes) == ("conditions", 8, 2, size)
    raw = RF.read_raw(spark, f"{path}/csv/conditions.csv")
    assert {f.dataType.simpleString() for f in raw.schema} == {"string"}
    (row,) = RF.clean_folder(spark, path, f"{path}/out", {"conditions": C.REQUIRED_RAW["conditions"]}).collect()
    assert row.asDict() == {"table_name": "conditions", "raw_rows": 8, "clean_rows": 2, "dropped_malformed": 2, "dropped_null": 1,
                            "dropped_empty": 0, "dropped_floor": 2, "dropped_duplicate": 1}
    out = spark.read.parquet(f"{path}/out/conditions").orderBy("patient_id").collect()
    assert [(r.patient_id, r.encounter_id, str(r.start_date), str(r.stop_date), r.description) for r in out] == [
        ("p1", "e1", "2020-01-01", "None", "duplicate"), ("p6", "e7", "2021-05-06", "2021-06-01", "a, b")]


def test_invalid_files_raise(spark, tmp_path):
    check = lambda text: ((tmp_path / "t.csv").write_text(text), RF.validate_file(spark, f"file:{tmp_path}/t.csv", "t", ("A", "B")))[1]
    with pytest.raises(FileNotFoundError):
        RF.validate_file(spark, f"file:{tmp_path}/none.csv", "t", ("A",))
    with pytest.raises(FileNotFoundError):
        RF.validate_all(spark, f"file:{tmp_path}/nowhere", {"t": ("A",)})
    for text, message in (("", "empty file"), ("A,C\n1,2\n", "missing required columns B"), ("A,B\n", "without data rows")):
        with pytest.raises(ValueError, match=message):
            check(text)
    assert check("A,B\n1,2\n").rows == 1


def test_second_timestamp_format(spark):
    spec = C.TableSpec("t", (C.Col("a", "a", "timestamp"), C.Col("b", "b", "date_from_ts")))
    rows = [("2020-01-02T03:04:05Z", "2020-01-02T03:04:05Z"), ("2020-01-02 03:04:05", "2020-01-02 03:04:05"), ("2020-01-02", "2020-01-02"), ("x", "")]
    got = C.clean(spark.createDataFrame(rows, "a string, b string"), spec).collect()
    assert [str(r.a) for r in got] == ["2020-01-02 03:04:05", "2020-01-02 03:04:05", "2020-01-02 00:00:00", "None"]
    assert [str(r.b) for r in got] == ["2020-01-02"] * 3 + ["None"]


def test_gate_and_loads(spark, tmp_path):
    with pytest.raises(ValueError):
        RF.require_rows(spark.range(0), "t")
    target = spark.createDataFrame([], "id string, n int").schema
    path = f"file:{tmp_path}/t"
    assert RF.replace_table(spark.range(3).selectExpr("id", "id * 2 as n", "1 as other"), target, path).columns == ["id", "n"]
    assert RF.append_table(spark.range(3, 5).selectExpr("id", "id * 2 as n"), target, path).count() == 5
    assert sorted(map(tuple, RF.replace_table(spark.range(1).selectExpr("id", "7L as n"), target, path).collect())) == [("0", 7)]


@pytest.mark.parametrize("few", [1, 50, 10_000])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "ties", "one", "wide"])
def test_exact_quantiles(spark, kind, few, monkeypatch):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "RANGES", 8)
    rnd = random.Random(3)
    make = {"uniform": lambda: rnd.random(), "skewed": lambda: rnd.random() ** 40, "ties": lambda: float(rnd.choice([1, 1, 1, 2, 5])),
            "one": lambda: 3.5, "wide": lambda: rnd.choice([-1e300, 1e-300, 1.0, 1e300])}[kind]
    values = [make() for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    fractions = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    assert Q.exact_quantiles(df, "x", fractions) == pytest.approx([float(np.quantile(values, f)) for f in fractions], rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert Q.exact_quantiles(spark.createDataFrame([], "x double"), "x", (0.5,)) == [None]
