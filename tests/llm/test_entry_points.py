"""The queries of the subpackage stand in the catalog, whatever optional library a machine lacks."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent.parent


def test_queries_are_listed_without_optional_libraries():
    code = "import sys; [sys.modules.__setitem__(m, None) for m in ('ahocorasick', 'sentencepiece', 'tiktoken')]; import __spark_entry__ as e; q = e.queries(); assert 'local_counts' in q and 'pipeline' in q and sum(n.startswith('op') for n in q) == 13"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(REPO)}, timeout=120)
