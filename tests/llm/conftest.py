import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table."""
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no tables here")
    return spark.read.parquet(str(path / "documents.parquet")).cache()
