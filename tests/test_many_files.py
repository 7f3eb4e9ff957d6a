"""Streams over tables that are folders of part files."""

import os

import pytest

from cutline.catalog import queries
from cutline.sources.star import Star

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The small tables again, three files each."""
    path = str(tmp_path_factory.mktemp("many"))
    for file in os.listdir(SF_DIR):
        spark.read.parquet(f"{SF_DIR}/{file}").repartition(3).write.parquet(f"{path}/{file}")
    return path


@pytest.mark.parametrize("name", ["stream_arrivals", "stream_staleness"])
def test_streams_read_every_file(spark, many, name):
    query = queries.queries()[name]
    assert sorted(map(tuple, query(spark, many).collect()), key=repr) == sorted(map(tuple, query(spark, SF_DIR).collect()), key=repr)


def test_stream_of_many_files_has_all_rows(spark, many, tmp_path):
    stream = Star(spark, many).stream("lineitem")
    out = str(tmp_path / "out")
    job = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    job.awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        Star(spark, str(tmp_path)).stream("lineitem")
