"""Per-file helper: the declarations and calls visible in one source text.

Returns flat facts (line, kind, name, owner) in reading order. What they mean
for the graph is decided by DataFrame operators, not here.

kinds: import; class/function/struct/enum/trait/impl/type (a definition);
inherits (owner -> name); method (owner -> name); call.
"""

from __future__ import annotations

import ast
import re

Fact = tuple[int, str, str, str | None]


def _span(lines: list[bytes], node: ast.AST) -> str:
    first, last = node.lineno - 1, node.end_lineno - 1
    if first == last:
        return lines[first][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
    parts = [lines[first][node.col_offset :], *lines[first + 1 : last], lines[last][: node.end_col_offset]]
    return b"".join(parts).decode("utf-8", "replace")


def python_facts(source: str) -> list[Fact]:
    lines = source.encode("utf-8").splitlines(keepends=True)
    found: list[tuple[tuple[int, int, int], Fact]] = []

    def add(node: ast.AST, kind: str, name: str, owner: str | None = None) -> None:
        found.append(((node.lineno, node.col_offset, len(found)), (node.lineno, kind, name, owner)))

    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            for alias in node.names:
                add(node, "import", alias.name)
        elif isinstance(node, ast.ImportFrom) and node.module:
            add(node, "import", node.module)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node, "function", node.name)
        elif isinstance(node, ast.Call):
            add(node, "call", _span(lines, node.func).split("(")[0].strip())
        elif isinstance(node, ast.ClassDef):
            add(node, "class", node.name)
            for base in sorted([*node.bases, *node.keywords], key=lambda b: (b.lineno, b.col_offset)):
                for name in _names_below(lines, base):
                    add(node, "inherits", name, node.name)
    found.sort(key=lambda f: f[0])
    return [fact for _, fact in found]


def _names_below(lines: list[bytes], node: ast.AST) -> list[str]:
    """Every identifier and dotted name under a base-class expression, outermost first."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        return [_span(lines, node).split("(")[0].strip(), *_names_below(lines, node.value), node.attr]
    names = [node.arg] if isinstance(node, ast.keyword) and node.arg else []
    for child in ast.iter_child_nodes(node):
        names += _names_below(lines, child)
    return names


# One pattern per construct; group 1 is the name, group 2 the owner or base.
_CALL = r"(?<![\w$.#!:])((?:[A-Za-z_$][\w$]*\s*(?:\.|\?\.|::)\s*)*[A-Za-z_$][\w$]*)\s*\("
_JS = [
    ("import", r"^[ \t]*import\b[^;'\"]*['\"]([^'\"\n]+)['\"]"),
    ("class", r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?(?:\s+extends\s+([A-Za-z_$][\w$.]*))?"),
    ("function", r"\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\("),
    ("function", r"^[ \t]*(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+|\*\s*)*"
                 r"(?!(?:if|for|while|switch|catch|function|return|with|do|else|new|await|typeof)\b)"
                 r"([A-Za-z_$#][\w$]*)\s*\([^;{}]*\)\s*(?::[^{;=]+)?\{"),
    ("call", _CALL),
]
RULES = {
    "javascript": _JS,
    "typescript": _JS,
    "go": [
        ("import", r"^import\s+(?:[\w.]+\s+)?[\"`]([^\"`\n]+)[\"`]"),
        ("import_block", r"^import\s*\(([^)]*)\)"),
        ("type", r"^\s*type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?!=)\S"),
        ("function", r"^func\s+(?:\(\s*([^)]*?)\s*\)\s*)?([A-Za-z_]\w*)\s*[\[(]"),
        ("call", _CALL),
    ],
    "rust": [
        ("import", r"\buse\s+([^;]+);"),
        ("struct", r"\bstruct\s+([A-Za-z_]\w*)"),
        ("enum", r"\benum\s+([A-Za-z_]\w*)"),
        ("trait", r"\btrait\s+([A-Za-z_]\w*)(?:<[^>{]*>)?(?:\s*:\s*([^{;]+?))?\s*(?:where\b[^{]*)?\{"),
        ("impl", r"\bimpl(?:\s*<[^{]*?>)?\s+(?:([\w:<>, ']+?)\s+for\s+)?([A-Za-z_][\w:]*(?:<[^{]*>)?)\s*(?:where\b[^{]*)?\{"),
        ("type", r"\btype\s+([A-Za-z_]\w*)(?:<[^>]*>)?\s*="),
        ("function", r"\bfn\s+([A-Za-z_]\w*)\s*(?:<[^({]*>)?\([^;{}]*\{"),
        ("call", _CALL),
    ],
}
_NOT_CALLED = {
    "javascript": "if for while switch catch function return typeof await new super import".split(),
    "typescript": "if for while switch catch function return typeof await new super import".split(),
    "go": "if for switch select func return go defer range import type var const".split(),
    "rust": "if for while match fn return let mut pub in loop impl use".split(),
}
_COMMENTS = re.compile(
    r"//[^\n]*|/\*.*?\*/|(\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')", re.DOTALL
)
_BEFORE_CALL = re.compile(r"(?:\bfunction\b\s*\*?|\bfn|\bfunc(?:\s*\([^)]*\))?|\bnew)\s*$")


def _blank(m: re.Match, keep_strings: bool) -> str:
    if m.group(1) and keep_strings:
        return m.group(0)
    return re.sub(r"[^\n]", " ", m.group(0))


def pattern_facts(source: str, language: str) -> list[Fact]:
    """Facts of a language without a parser at hand, from patterns over code without comments."""
    with_strings = _COMMENTS.sub(lambda m: _blank(m, True), source)
    # a lone quote is a lifetime in Rust, not a string
    bare = with_strings if language == "rust" else _COMMENTS.sub(lambda m: _blank(m, False), source)
    starts = [m.end() for m in re.finditer(r"\n", source)]
    found: list[tuple[int, int, Fact]] = []
    declared: set[int] = set()

    def line_of(at: int) -> int:
        lo, hi = 0, len(starts)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if starts[mid] <= at else (lo, mid)
        return lo + 1

    def add(at: int, kind: str, name: str, owner: str | None = None) -> None:
        found.append((at, len(found), (line_of(at), kind, name, owner)))

    for kind, pattern in RULES[language]:
        hay = with_strings if kind.startswith("import") else bare
        for m in re.finditer(pattern, hay, re.MULTILINE):
            at = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
            if kind == "import_block":
                for spec in re.findall(r"[\"`]([^\"`\n]+)[\"`]", m.group(1)):
                    add(at, "import", spec)
            elif kind == "import":
                add(at, kind, m.group(1).strip())
            elif kind == "function" and language == "go":
                declared.add(m.start(2))
                add(at, kind, m.group(2))
                if m.group(1):
                    add(at, "method", m.group(2), m.group(1).split(" ")[-1])
            elif kind == "impl":
                add(at, kind, m.group(2).strip())
                if m.group(1):
                    add(at, "inherits", m.group(1).strip(), m.group(2).strip())
            elif kind == "trait":
                add(at, kind, m.group(1))
                for bound in re.findall(r"[A-Za-z_]\w*", m.group(2) or ""):
                    add(at, "inherits", bound, m.group(1))
            elif kind == "call":
                name = re.sub(r"\s+", "", m.group(1))
                head = re.split(r"\.|::|\?", name)[0]
                if m.start(1) in declared or head in _NOT_CALLED[language] or _BEFORE_CALL.search(bare, max(0, m.start(1) - 80), m.start(1)):
                    continue
                add(m.start(1), kind, name)
            else:
                declared.add(m.start(1))
                add(at, kind, m.group(1))
                if m.re.groups > 1 and m.group(2):
                    add(at, "inherits", m.group(2), m.group(1))
    found.sort(key=lambda f: f[:2])
    return [fact for _, _, fact in found]


def source_facts(source: str, language: str) -> list[Fact]:
    return python_facts(source) if language == "python" else pattern_facts(source, language)
