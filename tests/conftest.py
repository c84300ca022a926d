import pytest

from tidemark.plans.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)
