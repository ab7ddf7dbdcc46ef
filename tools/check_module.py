"""Check the queries of some modules: python tools/check_module.py sf module..."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import check  # noqa: E402

from boxloom.plans import catalog  # noqa: E402

names = [n for m in sys.argv[2:] for n, f in catalog.QUERIES.items() if f.__module__ == f"boxloom.plans.{m}"]
sys.exit(1 if check.main(sys.argv[1], "^(" + "|".join(names) + ")$") else 0)
