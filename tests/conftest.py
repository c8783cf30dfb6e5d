import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from talkweave.session import build_session, ship
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_index(spark):
    from talkweave.sources import corpus, index_store
    chunks = corpus.read_directory(spark, str(ROOT / "tests/fixtures/corpus"))
    return index_store.load_or_build(spark, chunks, "fixture", tempfile.mkdtemp(prefix="run-"))
