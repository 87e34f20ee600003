import pytest

from pairworks.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("pairworks-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
