import re
from pathlib import Path

import foliant


def test_nothing_else_imports_the_corpus_operators():
    root = Path(foliant.__file__).parent
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if re.search(r"\bllm\b", p.read_text(encoding="utf-8"))]
