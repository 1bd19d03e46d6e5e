"""The library without its optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as driver
print(len(driver.queries()), any(n.startswith("op") for n in driver.queries()), "pipeline" in driver.queries())
"""


def entry_without(*gone):
    done = subprocess.run([sys.executable, "-c", WITHOUT.format(gone=gone)], cwd=ROOT,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_works_without_the_subpackage():
    count, operators, pipeline = entry_without("changetrail.llm", "corpus_pipeline")
    assert int(count) >= 55 and (operators, pipeline) == ("False", "False")
    assert entry_without("changetrail.llm")[1:] == ["False", "False"]


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "changetrail")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "llm" not in file.read(), name
