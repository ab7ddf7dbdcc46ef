import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from boxloom.session import build

    s = build("local[8]", "boxloom-tests", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SMALL
