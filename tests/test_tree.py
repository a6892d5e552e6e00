"""The tree itself: every test module collects, and parts that can be taken away are not needed by the rest."""

import ast
import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_module_names_are_unique():
    """Test folders are no packages, so two modules of one name would hide each other."""
    names = [p.stem for p in (ROOT / "tests").rglob("test_*.py")]
    assert len(names) == len(set(names))


def imported(path: pathlib.Path) -> set[str]:
    """Modules that a file imports, at any depth of its code."""
    found = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found |= {node.module} | {f"{node.module}.{a.name}" for a in node.names}
    return found


def test_nothing_else_imports_the_training_data_operators():
    removable = {"corpus_pipeline.py", "__spark_entry__.py"}
    for path in ROOT.rglob("*.py"):
        parts = path.relative_to(ROOT).parts
        if "llm" not in parts and parts[-1] not in removable:
            assert not any(m == "casegraph.llm" or m.startswith("casegraph.llm.") or m == "corpus_pipeline" for m in imported(path)), path
