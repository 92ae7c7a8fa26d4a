import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from latchgraph.session import build

    session = build(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": "/tmp/latchgraph-test-checkpoints", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
