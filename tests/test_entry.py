import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def run(code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=200)


def test_names_are_there_without_a_session():
    done = run("import __spark_entry__ as e; assert len(e.queries()) > 140 and set(e.oracle_sql()) <= set(e.queries())")
    assert done.returncode == 0, done.stderr


def test_the_corpus_operators_can_be_taken_out():
    hide = "import sys; sys.modules['folio.llm'] = None; sys.modules['corpus_pipeline'] = None; "
    done = run(hide + "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)")
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
