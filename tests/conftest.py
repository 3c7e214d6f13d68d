import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from longview.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (builder("tests", "local[4]").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
