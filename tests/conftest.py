import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])  # for Python workers
DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from boolsieve.session import session

    own = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(own / "warehouse"), "spark.checkpoint.dir": str(own / "checkpoints"),
        "spark.sql.autoBroadcastJoinThreshold": "1m", "spark.ui.showConsoleProgress": "false",
    }
    s = session("local[8]", 8, **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return str(DATA / "sf0.001")
