import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from markspark.session import get_session
    s = get_session("local[4]", app="markspark-tests", shuffle_partitions=8,
                    extra={"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
