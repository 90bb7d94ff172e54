import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from credence.session import checkpoint_dir, local_session

    s = local_session(cores="*", shuffle_partitions=8, app="credence-tests")
    checkpoint_dir(s)  # tests run without a cluster-provided folder: set our own
    yield s
    s.stop()
