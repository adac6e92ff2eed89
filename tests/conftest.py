import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import build_session

    settings = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = build_session("local[4]", "tests", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
