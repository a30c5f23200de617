import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_queries_without_the_optional_subpackage_or_what_it_needs():
    for gone in ("public_tokenizers", "parallax.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len([n for n in e.queries() if not n.startswith('op') and n != 'pipeline']), set(e.oracle_sql()) <= set(e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
        from parallax.plans import program_queries, queries, table_queries

        assert program_queries and table_queries and out.stdout.split() == [str(len(queries.QUERIES)), "True"] and "left out" in out.stderr


def test_core_imports_no_optional_module():
    for path in (ROOT / "parallax").rglob("*.py"):
        if "llm" not in path.parts:
            assert "parallax.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
