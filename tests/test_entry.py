import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
TEST = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "scriptorium.llm" or name.startswith("scriptorium.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name="scriptorium.llm" if name != "corpus_pipeline" else name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert q and not any(n.startswith("op") and n[2].isdigit() for n in q) and "pipeline" not in q
assert set(e.oracle_sql()) <= set(q)
"""


def test_entry_without_the_optional_folders():
    subprocess.run([sys.executable, "-c", TEST], cwd=ROOT, check=True)


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "conjunctive_search" in e.queries()
