import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rampstat.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples, sorted (order-free comparisons)."""
    if cols:
        df = df.select(*cols)
    return sorted(tuple(r) for r in df.collect())
