"""Parsing of source files: Python by its own grammar, other languages (and Python files with an error) by their defining and calling forms.

One row a file goes in and one comes out, with arrays of symbols, references, imports and
inheritance; Arrow batches, no state between files.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "struct<name:string,kind:string,line:long,col:long,end_line:long,scope:string,signature:string,doc_comment:string>"
REFERENCE = "struct<name:string,kind:string,line:long,col:long,context:string,caller_name:string>"
EDGE = "struct<child:string,parent:string,relationship:string>"
PARSED = f"path string, language string, hash string, line_count long, symbols array<{SYMBOL}>, refs array<{REFERENCE}>, imports array<string>, edges array<{EDGE}>"

_CUT = 200


def doc(text: str | None) -> str | None:
    """A comment on one line, cut at a word to 200 characters."""
    if not text:
        return None
    text = " ".join(x.strip() for x in text.splitlines() if x.strip())
    if len(text) <= _CUT:
        return text or None
    head = text[:_CUT]
    return (head[: head.rfind(" ")].rstrip() if " " in head else head) + "..."


def signature(lines: list[str], line: int) -> str:
    """Text before the first brace of a definition, or its first line."""
    first = lines[line - 1].strip()
    return first.split("{", 1)[0].strip() if "{" in first else first


class _Python(ast.NodeVisitor):
    def __init__(self, lines: list[str]):
        self.lines, self.scope, self.caller = lines, None, None
        self.symbols, self.refs, self.imports, self.edges = [], [], [], []

    def _context(self, node) -> str:
        return self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""

    def _symbol(self, node, name: str, kind: str) -> None:
        has = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        self.symbols.append((name, kind, node.lineno, node.col_offset, node.end_lineno, self.scope, signature(self.lines, node.lineno).rstrip(":"), doc(ast.get_docstring(node)) if has else None))

    def _ref(self, node, name: str, kind: str) -> None:
        self.refs.append((name, kind, node.lineno, node.col_offset, self._context(node), self.caller if kind == "call" else None))

    def _function(self, node) -> None:
        self._symbol(node, node.name, "method" if self.scope else "function")
        for note in [node.returns, *[a.annotation for a in [*node.args.args, *node.args.kwonlyargs]]]:
            for x in ast.walk(note) if note else ():
                if isinstance(x, ast.Name):
                    self._ref(x, x.id, "type")
        before, self.caller, scope, self.scope = self.caller, node.name, self.scope, None
        for child in [*node.decorator_list, *node.body]:
            self.visit(child)
        self.caller, self.scope = before, scope

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        self._symbol(node, node.name, "class")
        for base in node.bases:
            self.edges.append((node.name, ast.unparse(base), "extends"))
        before, self.scope = self.scope, node.name
        for child in node.body:
            self.visit(child)
        self.scope = before

    def visit_Assign(self, node) -> None:
        if self.caller is None and self.scope is None:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self._symbol(node, t.id, "constant" if t.id.isupper() else "variable")
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self._ref(node, name, "call")
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.imports.append(a.name)
            self._ref(node, a.name, "import")

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        self.imports.append(module)
        for a in node.names:
            self._ref(node, a.name, "import")


#: Definition forms by language: (pattern with the name as group 1, kind).
_FORMS = {
    "rust": [(r"\bfn\s+(\w+)", "function"), (r"\bstruct\s+(\w+)", "struct"), (r"\benum\s+(\w+)", "enum"), (r"\btrait\s+(\w+)", "trait"), (r"\btype\s+(\w+)\s*=", "type_alias"), (r"\bconst\s+(\w+)\s*:", "constant"), (r"\bstatic\s+(?:mut\s+)?(\w+)\s*:", "variable"), (r"\bmod\s+(\w+)", "module"), (r"^\s*impl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", "module")],
    "javascript": [(r"\bfunction\s*\*?\s*(\w+)", "function"), (r"\bclass\s+(\w+)", "class"), (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "function"), (r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]*)\s*=", "constant"), (r"^\s+(?:async\s+|static\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^;]*\)\s*\{", "method")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"^type\s+(\w+)\s+struct\b", "struct"), (r"^type\s+(\w+)\s+interface\b", "interface"), (r"^type\s+(\w+)\s+(?!struct\b|interface\b)", "type_alias"), (r"^const\s+(\w+)", "constant"), (r"^var\s+(\w+)", "variable")],
    "java": [(r"\bclass\s+(\w+)", "class"), (r"\binterface\s+(\w+)", "interface"), (r"\benum\s+(\w+)", "enum"), (r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], .]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\{", "method")],
    "c": [(r"^\w[\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{", "function"), (r"\bstruct\s+(\w+)\s*\{", "struct"), (r"\benum\s+(\w+)\s*\{", "enum"), (r"^#define\s+(\w+)", "constant"), (r"^typedef\b.*\b(\w+)\s*;", "type_alias")],
    "ruby": [(r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "function"), (r"^\s*class\s+(\w+)", "class"), (r"^\s*module\s+(\w+)", "module"), (r"^\s*([A-Z][A-Z0-9_]*)\s*=", "constant")],
    "php": [(r"\bfunction\s+(\w+)", "function"), (r"\bclass\s+(\w+)", "class"), (r"\binterface\s+(\w+)", "interface"), (r"\btrait\s+(\w+)", "trait"), (r"\bconst\s+(\w+)\s*=", "constant")],
}
_FORMS["typescript"] = [*_FORMS["javascript"], (r"\binterface\s+(\w+)", "interface"), (r"\benum\s+(\w+)", "enum"), (r"^\s*(?:export\s+)?type\s+(\w+)[^=]*=", "type_alias")]
_FORMS["cpp"] = [*_FORMS["c"], (r"\bclass\s+(\w+)[^;]*\{", "class"), (r"\bnamespace\s+(\w+)", "module")]
#: For files that the grammar refuses.
_FORMS["python"] = [(r"^\s*(?:async\s+)?def\s+(\w+)", "function"), (r"^\s*class\s+(\w+)", "class"), (r"^([A-Z][A-Z0-9_]*)\s*=", "constant")]
_FORMS["csharp"] = [*_FORMS["java"], (r"\bstruct\s+(\w+)", "struct"), (r"\bnamespace\s+([\w.]+)", "module"), (r"\bdelegate\s+\w+\s+(\w+)", "type_alias")]

_IMPORT = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))",
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);", "javascript": r"""(?:import\b[^'"]*|require\s*\(\s*)['"]([^'"]+)""", "typescript": r"""(?:import\b[^'"]*|require\s*\(\s*)['"]([^'"]+)""",
    "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$""", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "c": r"""^\s*#include\s*[<"]([^>"]+)""", "cpp": r"""^\s*#include\s*[<"]([^>"]+)""",
    "ruby": r"""^\s*require(?:_relative)?\s*\(?['"]([^'"]+)""", "php": r"""^\s*(?:use\s+([\w\\]+)|(?:include|require)(?:_once)?\s*\(?['"]([^'"]+))""", "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
}
_INHERIT = {
    "python": [(r"^\s*class\s+(?P<child>\w+)\s*\((?P<parents>[^)]*)\)", "extends")],
    "rust": [(r"^\s*impl\b(?:\s*<[^>]*>)?\s+(?P<parents>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<child>\w+)", "implements")],
    "javascript": [(r"\bclass\s+(?P<child>\w+)\s+extends\s+(?P<parents>[\w.]+)", "extends")],
    "typescript": [(r"\bclass\s+(?P<child>\w+)[^{]*?\bextends\s+(?P<parents>[\w.]+)", "extends"), (r"\bclass\s+(?P<child>\w+)[^{]*?\bimplements\s+(?P<parents>[\w., ]+)", "implements"), (r"\binterface\s+(?P<child>\w+)\s+extends\s+(?P<parents>[\w., ]+)", "extends")],
    "java": [(r"\bclass\s+(?P<child>\w+)[^{]*?\bextends\s+(?P<parents>[\w.]+)", "extends"), (r"\bclass\s+(?P<child>\w+)[^{]*?\bimplements\s+(?P<parents>[\w., ]+)", "implements"), (r"\binterface\s+(?P<child>\w+)\s+extends\s+(?P<parents>[\w., ]+)", "extends")],
    "cpp": [(r"\b(?:class|struct)\s+(?P<child>\w+)\s*(?:final\s*)?:\s*(?P<parents>[\w:, ]+)\{", "extends")],
    "ruby": [(r"^\s*class\s+(?P<child>\w+)\s*<\s*(?P<parents>[\w:]+)", "extends")],
    "php": [(r"\bclass\s+(?P<child>\w+)[^{]*?\bextends\s+(?P<parents>[\w\\]+)", "extends"), (r"\bclass\s+(?P<child>\w+)[^{]*?\bimplements\s+(?P<parents>[\w\\, ]+)", "implements")],
    "csharp": [(r"\b(?P<kind>class|struct|interface)\s+(?P<child>\w+)\s*:\s*(?P<parents>[\w., ]+)", "base")],
}
_CALL = re.compile(r"(?:([\w.]+)\s*\.\s*)?\b(\w+)!?\s*\(")
_NOT_CALLS = frozenset("if for while switch match return catch fn def func function class struct sizeof typeof new in and or not elsif unless loop with assert".split())


class _Blocks:
    """Ends of all blocks of a file, found in one pass."""

    def __init__(self, lines: list[str], language: str):
        self.lines, self.language = lines, language
        self.indent = [len(x) - len(x.lstrip()) for x in lines]
        if language == "ruby":
            self.ends: dict[int, list[int]] = {}
            for n, x in enumerate(lines, 1):
                if x.strip() == "end":
                    self.ends.setdefault(self.indent[n - 1], []).append(n)
        elif language == "python":
            self.close, open_, last = {}, [], 0
            for n, x in enumerate(lines, 1):
                if not x.strip():
                    continue
                while open_ and self.indent[n - 1] <= self.indent[open_[-1] - 1]:
                    self.close[open_.pop()] = last
                open_.append(n)
                last = n
            self.close |= dict.fromkeys(open_, last)
        else:
            self.marks = [(n, m.start(), m[0]) for n, x in enumerate(lines, 1) for m in re.finditer(r"[{}();]", x)]
            self.close, open_ = {}, []
            for k, (n, _, c) in enumerate(self.marks):
                if c == "{":
                    open_.append(k)
                elif c == "}" and open_:
                    self.close[open_.pop()] = n
            self.close |= dict.fromkeys(open_, len(lines))  # a block that nothing closes goes on to the end

    def end(self, line: int, col: int) -> int:
        """Last line of the block of a definition at a place; its own line where it has none."""
        if self.language == "ruby":
            after = (self.ends[i][k] for i in self.ends if i <= self.indent[line - 1] and (k := bisect_right(self.ends[i], line)) < len(self.ends[i]))
            return min(after, default=line)
        if self.language == "python":
            return self.close.get(line, line)
        depth, upto = 0, line + 2  # a block opens on one of the next lines, or behind parentheses that are still open
        for k in range(bisect_left(self.marks, (line, col)), len(self.marks)):
            n, _, c = self.marks[k]
            if n > upto and depth <= 0:
                break
            depth += (c == "(") - (c == ")")
            if depth <= 0:
                upto = max(upto, n + 2) if c == ")" else upto
                if c == "{":
                    return self.close[k]
                if c in ";}":
                    return n if c == ";" else line
        return line


def _innermost(spans: list[tuple], kinds: tuple[str, ...]):
    """A function of ascending lines: name of the last span of some kinds that is open there."""
    left, open_ = sorted((s for s in spans if s[3] in kinds), key=lambda s: s[1], reverse=True), []

    def at(line: int) -> str | None:
        while left and left[-1][1] <= line:
            open_.append(left.pop())
        while open_ and open_[-1][2] < line:
            open_.pop()
        return next((s[0] for s in reversed(open_) if s[2] >= line), None)

    return at


def _by_forms(lines: list[str], language: str) -> tuple[list, list, list, list]:
    symbols, refs, imports, edges, spans, seen = [], [], [], [], [], set()
    forms = [(re.compile(p), kind) for p, kind in _FORMS.get(language, ())]
    owners = ("class", "struct", "enum", "trait", "interface") + (("module",) if language in ("rust", "ruby") else ())
    blocks, open_, comment = _Blocks(lines, language), [], []
    for n, line in enumerate(lines, 1):
        while open_ and open_[-1][2] < n:
            open_.pop()
        if re.match(r"\s*(///|/\*\*|\* |#[^!\[i]|//)", line):
            comment.append(re.sub(r"^\s*(///?|/\*\*|\*|#)\s?|\*/\s*$", "", line))
            continue
        for form, kind in forms:
            if (m := form.search(line)) and (m[1], n) not in seen:
                seen.add((m[1], n))
                end = blocks.end(n, m.start(1))
                scope = next((s[0] for s in reversed(open_) if s[3] in owners and s[2] >= n), None)
                kind = "method" if kind == "function" and scope else kind
                symbols.append((m[1], kind, n, m.start(1), end, scope, signature(lines, n).rstrip(":"), doc("\n".join(comment))))
                spans.append((m[1], n, end, kind))
                open_.append(spans[-1])
        if line.strip() and not line.lstrip().startswith(("#[", "@")):
            comment = []
        if (p := _IMPORT.get(language)) and (m := re.search(p, line)):
            imports.append(next(g for g in m.groups() if g))
            refs.append((imports[-1], "import", n, m.start(), line.strip(), None))
        for p, relation in _INHERIT.get(language, ()):
            if m := re.search(p, line):
                parents = [re.sub(r"\b(public|private|protected|virtual)\b", "", x).strip() for x in m["parents"].split(",")]
                for k, parent in enumerate(x for x in parents if x and "=" not in x):
                    how = relation if relation != "base" else "extends" if k == 0 or m["kind"] == "interface" else "implements"
                    edges.append((m["child"], parent, how))
    caller = _innermost(spans, ("function", "method"))
    for n, line in enumerate(lines, 1):
        inside = caller(n)
        for m in _CALL.finditer(line):
            if m[2] not in _NOT_CALLS and (m[2], n) not in seen:
                refs.append((f"{m[1]}.{m[2]}" if m[1] and language in ("java", "ruby") else m[2], "call", n, m.start(2), line.strip(), inside))
    return symbols, refs, imports, edges


def parse(text: str, language: str) -> tuple[list, list, list, list]:
    """Symbols, references, imports and inheritance of one file."""
    lines = text.split("\n")
    if language == "python":
        try:
            visitor = _Python(lines)
            visitor.visit(ast.parse(text))
            return visitor.symbols, visitor.refs, visitor.imports, visitor.edges
        except (SyntaxError, ValueError, RecursionError):
            pass  # a file with an error still has definitions and calls
    return _by_forms(lines, language)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    names = [re.findall(r"(\w+):", x) for x in (SYMBOL, REFERENCE, EDGE)]
    for pdf in batches:
        out = []
        for path, content, language in zip(pdf["path"], pdf["content"], pdf["language"]):
            text = content or ""
            symbols, refs, imports, edges = parse(text, language)
            tables = [[dict(zip(n, row)) for row in rows] for n, rows in zip(names, (symbols, refs, edges))]
            out.append((path, language, hashlib.md5(text.encode()).hexdigest(), len(text.splitlines()), tables[0], tables[1], imports, tables[2]))
        yield pd.DataFrame(out, columns=["path", "language", "hash", "line_count", "symbols", "refs", "imports", "edges"])


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (path, content, language) parsed: a row a file."""
    return files.select("path", "content", "language").filter(F.col("language").isNotNull()).mapInPandas(_rows, PARSED)
