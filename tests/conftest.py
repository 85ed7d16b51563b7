import pytest
from quarry.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield made
    made.stop()
