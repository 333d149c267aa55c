"""No name is defined twice in a module, and no import is unused."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(p for p in [*ROOT.glob("*.py"), *ROOT.glob("kinweave/**/*.py")])


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_module(path):
    tree = ast.parse(path.read_text())
    for scope in (n for n in ast.walk(tree) if isinstance(n, ast.Module | ast.ClassDef)):
        names = [n.name for n in scope.body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names))
    imported = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom) and getattr(node, "module", "") != "__future__":
            for alias in node.names:
                name = (alias.asname or alias.name).split(".")[0]
                assert imported.setdefault(name, alias.name) == alias.name
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.value.id for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    text = path.read_text()
    assert not [n for n in imported if n not in used and text.count(n) < 2]
