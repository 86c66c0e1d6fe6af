"""Result rows as text: a line by the kind of result, one JSON object a line, rows under one header, or one line a file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of each kind of result. A part in [ ] stays away where one of its columns is null or missing.
LINES = {
    "search": "{file}:{line}:{content}[  {annotation}]",
    "symbol": "{file}:{line}:  {kind} {name}[ in {scope}][: {signature}]",
    "reference": "{file}:{line}:  {context}[ (in {caller_name})]",
    "signature": "{file}:{line}:  {signature}",
    "dep": "[{source_file} -> ]{import_path}",
    "semantic": "{file}:{line}:  {kind} {name} [score %.4f {score}]",
    "cluster": "[cluster {cluster}: ]{file}:  {name} [distance %.4f {distance}]",
    "impact": "{changed} -> {file}:{line}:  {kind} {name} [score %.4f {score}]",
    "caller": "{file}:{line}:  {caller_name} calls into {target_file} [depth {depth}, ][confidence %.2f {confidence}]",
    "callee": "{file}:{line}:  {callee_name} called from {source_file} [depth {depth}, ][confidence %.2f {confidence}]",
    "path": "{hop}. {kind} {name}[ ({file}:{line})]",
    "flow": "{entry} #{step}: {kind} {name}[ ({file}:{line})]",
    "blast": "{severity}: {file}:{line}:  {kind} {name} [depth {depth}]",
    "change": "{change}: {file}:{line}:  {kind} {name}",
    "context": "{file}:{line}:  {kind} {name}[ callers: {callers}][ callees: {callees}]",
    "summary": "{path}: {files} files, {lines} lines[, {symbols} symbols][, {deps} dependencies]",
}


def _filled(template: str, columns: list[str]):
    """A template's text with {column}s put in; ``%.2f {column}`` formats a number."""

    def part(text: str):
        out = [F.lit("")]
        for literal, form, name in re.findall(r"([^{]*?)(?:(%\.\df) )?\{(\w+)\}|(?:[^{]+$)", text):
            out.append(F.lit(literal))
            if name:
                out.append((F.format_string(form, name) if form else F.col(name).cast("string")) if name in columns else F.lit(None).cast("string"))
        tail = re.search(r"[^{}]*$", text)[0]
        return F.concat(*out, F.lit(tail))

    out = []
    for optional, plain in re.findall(r"\[([^\]]*)\]|([^\[]+)", template):
        out.append(F.coalesce(part(optional), F.lit("")) if optional else part(plain))
    return F.concat(*out)


def grep_lines(rows: DataFrame, kind: str = "search") -> DataFrame:
    """A line of text for each row, by the kind of result."""
    plain = rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes))
    return plain.select(_filled(LINES[kind], plain.columns).alias("value"))


def compact_lines(rows: DataFrame, name: str = "rows") -> DataFrame:
    """A header with the columns' names, then a line of values each: (n, value), the header being 0. For results of a page."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string") if not t.startswith(("array", "struct", "map")) else F.to_json(c), r"[\r\n,]", " "), F.lit("")) for c, t in rows.dtypes]
    lines = rows.select(F.monotonically_increasing_id().alias("at"), F.concat(F.lit("  "), F.concat_ws(",", *cells)).alias("value"))
    head = lines.agg(F.concat(F.lit(f"{name}["), F.count("*"), F.lit("]{" + ",".join(rows.columns) + "}:")).alias("value")).select(F.lit(-1).cast("long").alias("at"), "value")
    return head.unionByName(lines).withColumn("n", F.row_number().over(Window.orderBy("at")) - 1).select("n", "value").orderBy("n")


def one_line_a_file(rows: DataFrame, order: list, kind: str = "search") -> DataFrame:
    """(n, value): lines of consecutive rows of one file joined by `` ; ``, as piped output has them. For results of a page."""
    w = Window.orderBy(*order)
    text = F.array_join(F.filter(F.split(_filled(LINES[kind], rows.columns), "\n"), lambda x: x != ""), " ; ")
    placed = rows.withColumn("__at", F.row_number().over(w)).withColumn("__new", F.coalesce(F.lag("file").over(w) != F.col("file"), F.lit(True)).cast("int")).withColumn("__text", text)
    runs = placed.withColumn("n", F.sum("__new").over(Window.orderBy("__at")))
    return runs.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__text"))), lambda x: x["__text"]), " ; ").alias("value")).orderBy("n")


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def highlighted(content, pattern: str):
    """Matches between the terminal's bold red and reset."""
    return F.regexp_replace(content, f"({pattern})", "\x1b[1;31m$1\x1b[0m")
