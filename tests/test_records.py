from pathlib import Path

import numpy as np
import pytest

from tonelake.sources import records

ROWS = [(i, [i + j / 4 for j in range(6)], "x") for i in range(-40, 200)] + [(2**63 - 1, [float("nan"), float("inf"), -0.0, 1e-30, 10.0, 10.5], "y"), (10, [0.0] * 6, "again")]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, grid array<double>, key string").repartition(3)


def plain(rows):
    return sorted((k, [repr(x) for x in v]) for k, v in rows)


def test_round_trip_in_byte_ranges(spark, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(table(spark, ROWS), path, "id", "grid", (2, 3))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "700")  # several ranges in each file
    try:
        got = records.read_records(spark, path, (2, 3))
        assert got.rdd.getNumPartitions() > 6
        assert plain((r["key"], r["values"]) for r in got.collect()) == plain((i, [float(np.float32(x)) for x in v]) for i, v, _ in ROWS)
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    with pytest.raises(Exception, match="already exists"):
        records.write_records(table(spark, ROWS), path, "id", "grid", (2, 3))


def test_refuses_another_shape_and_torn_files(spark, tmp_path):
    path = tmp_path / "r"
    records.write_records(table(spark, ROWS), str(path), "id", "grid", (2, 3))
    assert records.described(spark, str(path), (2, 3)) == len(ROWS)
    with pytest.raises(ValueError, match="shape"):
        records.read_records(spark, str(path), (3, 2))
    part = next(Path(path / "records").glob("part-*"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-5])
    Path(path / "records" / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        records.read_records(spark, str(path), (2, 3))
    part.write_bytes(whole[: -records.record_bytes((2, 3))])  # whole records, but one too few
    with pytest.raises(ValueError, match="incomplete"):
        records.read_records(spark, str(path), (2, 3))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_records(spark, str(tmp_path / "none"), (2, 3))


@pytest.mark.parametrize("row", [(None, [0.0] * 6, "x"), (1, None, "x"), (1, [0.0] * 5, "x"), (1, [0.0] * 5 + [None], "x")])
def test_refuses_rows_that_do_not_fit(spark, tmp_path, row):
    path = tmp_path / "r"
    with pytest.raises(ValueError, match="1 of 243 rows"):
        records.write_records(table(spark, [*ROWS, row]), str(path), "id", "grid", (2, 3))
    assert not path.exists()


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(table(spark, ROWS).limit(0), path, "id", "grid", (2, 3))
    assert records.read_records(spark, path, (2, 3)).count() == 0
