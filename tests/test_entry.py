import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), set(e.oracle_sql()) <= set(q), any(k.startswith('op') for k in q))"


def run(folder):
    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": folder})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_queries_are_listed_without_a_session():
    n, sql, inside, _ = run(HERE)
    assert int(n) > 50 and int(sql) > 45 and inside == "True"


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert run(str(copy))[3] == "False"


def test_a_missing_library_costs_only_its_operators(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('blocked')\n")
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{HERE}"})
    assert out.returncode == 0, out.stderr
    n, _, inside, _ = out.stdout.split()
    assert int(n) > 70 and inside == "True"


def test_the_rest_passes_without_the_training_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or (n == "llm" and os.path.basename(d) in ("scanweave", "tests"))])
    n, _, inside, _ = run(str(copy))
    assert int(n) > 70 and inside == "True"
    tests = ["test_messages.py", "test_config_noise.py"]
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", *[f"tests/{t}" for t in tests]], cwd=copy, capture_output=True, text=True, timeout=600, env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stdout[-2000:]


def test_flagship(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
