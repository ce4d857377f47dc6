import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from treesnap.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="treesnap-tests")
    yield s


@pytest.fixture
def project_files(spark):
    """The reference's four-file toy project."""
    rows = [("proj", "src/cli.py", b"import os\nprint('hello')\n"),
            ("proj", "src/utils.py", b"def helper(): pass\n"),
            ("proj", "tests/test_main.py", b"from src import main\n"),
            ("proj", "README.md", b"# Project\n")]
    return spark.createDataFrame(rows, "project string, path string, content binary")
