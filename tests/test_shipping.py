"""Workers have to find the package wherever the driver was started."""

import os
import subprocess
import sys

import pytest

from tabulith.session import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from tabulith.session import local_session
print("ROWS", entry.queries()["quoted_records"](local_session(2, "elsewhere", "2g"), sys.argv[1]).count())
"""


def test_started_from_another_folder(tmp_path, data):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, data], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in done.stdout, done.stderr[-2000:]


def test_no_substitute_for_the_shared_folder():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        shared_folder(Bare)
