import pytest

from claimgrid.session import build_session, prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="claimgrid-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)
