import pytest

from marlstone.errors import EngineError
from marlstone.sources import files


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, v string")
    files.write(df, f"{tmp_path}/x", kind)
    back = files.read(spark, f"{tmp_path}/x", kind, "id long, v string")
    assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None)]


def test_refusals(spark, tmp_path):
    with pytest.raises(EngineError):
        files.read(spark, "x", "exotic")
    with pytest.raises(EngineError):
        files.read(spark, "x", "csv")
    with pytest.raises(EngineError):
        files.write(spark.range(1), f"{tmp_path}/y", "exotic")
