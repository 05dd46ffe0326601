import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tabulario.session import build_session

    session = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false",
                            spark_driver_memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
