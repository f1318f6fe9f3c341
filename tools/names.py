"""Print the query names of a catalog module, for check_oracles.py."""
import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
print(*importlib.import_module(f"coursemine.catalog.{sys.argv[1]}").QUERIES)
