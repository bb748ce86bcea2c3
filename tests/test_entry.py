"""The entry module must import in a fresh process: no session, no archives, any folder layout."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_import_needs_no_session_and_no_jar():
    code = (
        "import zipfile\n"
        "def refuse(*a, **k): raise RuntimeError('archive opened')\n"
        "zipfile.ZipFile = refuse\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())\n"
        "assert SparkSession.getActiveSession() is None\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
