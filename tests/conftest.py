import pytest

from lexgrove.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", cores=4, shuffle_partitions=4, memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
