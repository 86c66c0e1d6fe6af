"""Predicates and scalar functions on paths, lines and names: Column expressions, and plain Python for parameters."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Extension -> language.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rb": "ruby", "php": "php", "cs": "csharp",
}
#: Path parts and names that mark tests, for ranking, for lookup order and for source display.
TEST_PARTS = ("test", "tests", "__tests__", "docs", "doc", "examples", "example", "fixtures", "benchmarks", "bench")
TEST_WITHIN = ("/test", "/tests/", "/bench", "/benches/", "/spec/", "/specs/", "_test.", ".test.", "_spec.", ".spec.", "/mock", "/examples/")
TEST_BEGIN = ("test", "bench", "examples/")
TEST_WORDS = ("test", "spec", "bench", "example")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_ascii(c) -> Column:
    """Lower case of A to Z alone, as the index's text matching folds it."""
    return F.translate(col(c), _UPPER, _LOWER)


def contains_ci(c, text: str) -> Column:
    """Literal substring, ASCII case folded."""
    return lower_ascii(c).contains(text.translate(str.maketrans(_UPPER, _LOWER)))


def ends_ci(c, text: str) -> Column:
    return lower_ascii(c).endswith(text.translate(str.maketrans(_UPPER, _LOWER)))


def like_ci(c, pattern: str) -> Column:
    """LIKE with its wildcards, ASCII case folded."""
    return F.like(lower_ascii(c), F.lit(pattern.translate(str.maketrans(_UPPER, _LOWER))))


def language(path) -> Column:
    """Language of a path's extension, null for others."""
    ext = F.regexp_extract(col(path), r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, ext)


def is_test(path) -> Column:
    """Ranking's test rule: a part, a stem ending in _test, or .test./.spec. in the file name. Case counts."""
    return col(path).rlike(rf"(^|/)({'|'.join(TEST_PARTS)})(/|$)|_test(\.[^./]*)?$|\.(test|spec)\.[^/]*$")


def is_test_lookup(path) -> Column:
    """The looser rule that orders symbol lookups."""
    low, out = lower_ascii(path), F.lit(False)
    for s in TEST_WITHIN:
        out = out | low.contains(s)
    for s in TEST_BEGIN:
        out = out | low.startswith(s)
    return out


def is_test_shown(path) -> Column:
    """The rule that orders displayed sources."""
    return lower_ascii(path).rlike("|".join(TEST_WORDS))


def is_import_line(line) -> Column:
    return col(line).rlike(r"""^\s*(use\s|import\s|from\s|#include\s*[<"]|require\s*[('"])""")


def is_comment_line(line) -> Column:
    return col(line).rlike(r"^\s*(//|/\*|\* |\*/|#(?!include))")


def stem(path) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def import_stem(path) -> Column:
    """Last part of an import, split at / and :, without its extension."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/:]*)[/:]*$", 1), r"(?<=.)\.[^.]*$", "")


def normal_path(path: str) -> str:
    """No leading ./ and no trailing /; nothing is the root."""
    return re.sub(r"^(\./)+|/+$", "", path) or "."


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(file, line, content) of text files; a text ends at its first NUL, a last empty line is none."""
    text = F.substring_index(F.col(content), "\0", 1)
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    exploded = files.select(F.col(path).alias("file"), F.posexplode(parts).alias("p", "content"))
    return exploded.select("file", (F.col("p") + 1).cast("long").alias("line"), F.regexp_replace("content", r"[\r\n]+$", "").alias("content"))


def grep(text: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Lines that hold a literal or match a regular expression: (file, line, col, content)."""
    if regex:
        hit = F.col("content").rlike(f"(?i){pattern}" if ignore_case else pattern)
    else:
        hit = F.lower("content").contains(pattern.lower()) if ignore_case else F.col("content").contains(pattern)
    return text.filter(hit).select("file", "line", F.lit(1).cast("long").alias("col"), "content")


def line_range(content, start: int, end: int) -> Column:
    """Lines start to end, 1-based and inclusive."""
    return F.array_join(F.slice(F.split(col(content), "\n"), start, max(0, end - start + 1)), "\n")


def tokens(text) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(col(text)) / 4).cast("long")


def phrase_tokens(text) -> Column:
    """Lower-case runs of letters and digits, as a full-text tokenizer splits names."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def has_phrase(text, phrase: str) -> Column:
    """Whether the phrase's tokens stand next to each other in the text's."""
    want = [t for t in re.split(r"[\W_]+", phrase.lower()) if t]
    if not want:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(phrase_tokens(text), " "), F.lit(" ")).contains(f" {' '.join(want)} ")


# --- parameters -------------------------------------------------------------


def confidence(value: float | None) -> float:
    """Nothing, NaN and infinities are 0; else held in 0..1."""
    return 0.0 if value is None or not math.isfinite(value) else min(1.0, max(0.0, value))


def looks_like_regex(pattern: str) -> bool:
    """A class escape, a bracket expression, or an alternation inside the pattern."""
    return bool(re.search(r"\\[wWdDsSbB.]|\[.*\]|.(?<!\\)\|.", pattern, re.S))


def looks_like_path(text: str) -> bool:
    return "/" in text or text.rpartition(".")[2] in LANGUAGES and "." in text


@dataclass(frozen=True)
class Qualified:
    name: str
    file_hint: str | None = None
    scope_hint: str | None = None


def snake(name: str) -> str:
    """CamelCase to snake_case; a run of capitals is one word."""
    return re.sub(r"(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def _module_hint(prefix: str) -> str:
    return "/".join(snake(s) if s[:1].isupper() and "/" not in s else s for s in prefix.split("::"))


def split_qualified(text: str) -> Qualified:
    """``a::B`` has a module hint, ``Class.m`` a scope, ``a.b.c`` both, ``mod::Class.m`` both."""
    module, colons, rest = text.rpartition("::")
    if colons and not rest:
        return Qualified(text)
    owner, dot, last = rest.rpartition(".")
    if colons:
        if dot and last:
            return Qualified(last, _module_hint(module), owner)
        return Qualified(rest, _module_hint(module))
    if not dot or not last:
        return Qualified(text)
    before, more, scope = owner.rpartition(".")
    if more:
        return Qualified(last, before.replace(".", "/"), scope)
    return Qualified(last, None if owner[:1].isupper() else owner, owner)


def glob_to_regex(pattern: str) -> str:
    """One line of an ignore file as a regular expression over relative paths."""
    anchored = "/" in pattern.rstrip("/")
    body, out = pattern.strip("/"), ""
    for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^]]*\])", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[:1] == "[" else re.escape(part))
    return ("^" if anchored else "(^|/)") + out + ("/" if pattern.endswith("/") else "(/|$)")


def ignored(path, patterns: list[str]) -> Column:
    """Whether the last pattern that applies ignores a path; ``!`` takes back, blank lines and # are skipped."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            out = F.when(col(path).rlike(glob_to_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def duration(seconds: int) -> str:
    """Two largest units of a time span."""
    parts = [(seconds // 86400, "d"), (seconds // 3600 % 24, "h"), (seconds // 60 % 60, "m"), (seconds % 60, "s")]
    while len(parts) > 1 and not parts[0][0]:
        parts.pop(0)
    return " ".join(f"{n}{u}" for n, u in parts[:2])
