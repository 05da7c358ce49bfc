import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from treeline.session import get_spark

    s = get_spark("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
