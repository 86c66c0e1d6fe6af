"""Token budgets: an ordered fold that takes what still fits and keeps going."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.frames import numbered

#: Tokens of a page for tools and for piped output.
TOOL_PAGE, PIPE_PAGE = 4000, 2000


def _fold(limit: int, skip: int):
    """Over (position, tokens) in order: which rows an earlier page has, and which fit this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, used = skip, 0
        for batch in batches:
            taken, skipped = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for k, n in enumerate(batch["tokens"].to_pylist()):
                if left > 0:
                    skipped[k], left = True, left - n if n <= left else 0
                elif used + n <= limit:
                    taken[k], used = True, used + n
            yield pa.RecordBatch.from_arrays([batch["position"], pa.array(taken), pa.array(skipped)], ["position", "taken", "skipped"])

    return run


def within(rows: DataFrame, limit: int, order: list, page: int = 1, text: str | None = None) -> DataFrame:
    """``rows`` with ``tokens``, ``position``, ``skipped`` (on an earlier page) and ``taken``.

    In order: the first (page-1)*limit tokens are passed over, the row that crosses that mark with them; then a
    row is taken if it fits what is left. It is no prefix: a small row after a large one may be taken. The fold
    is sequential by nature: positions and sizes, 16 bytes a row, stream through one task in constant memory, and
    rows are matched back by position. ``order`` must be total."""
    size = X.tokens(text) if text else X.tokens(F.to_json(F.struct(*rows.columns)))
    placed = numbered(rows.withColumn("tokens", size), *order)
    folded = placed.select("position", "tokens").repartition(1).sortWithinPartitions("position").mapInArrow(_fold(limit, (page - 1) * limit), "position long, taken boolean, skipped boolean")
    return placed.join(folded, "position")


def page_info(budgeted: DataFrame, skipped_count: bool = False) -> DataFrame:
    """Counts of a page: shown, tokens, truncated (rows of earlier pages only where ``skipped_count``) and whether more follow."""
    cut = ~F.col("taken") if skipped_count else ~F.col("taken") & ~F.col("skipped")
    out = budgeted.agg(F.count_if("taken").alias("shown"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("tokens"))), F.lit(0)).alias("used"), F.count_if(cut).alias("truncated"))
    return out.withColumn("has_more", F.col("truncated") > 0)


def answer(rows: DataFrame, order: list, limit: int, page: int = 1, skipped_count: bool = False) -> DataFrame:
    """One row: ``results`` (JSON, in order; what fits ``limit`` tokens), ``page``, ``shown``, ``total``, ``has_more`` and ``hint``."""
    budgeted = within(rows, limit, order, page)
    one = F.struct("position", F.to_json(F.struct(*rows.columns)).alias("json"))
    results = budgeted.filter("taken").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["json"]).alias("results"))
    facts = page_info(budgeted, skipped_count).withColumn("page", F.lit(page)).withColumn("total", F.col("shown") + F.col("truncated"))
    facts = facts.crossJoin(budgeted.agg(F.count("*").alias("matches")))  # one row each
    more = F.when(F.col("has_more"), F.format_string(" Use page=%d for more.", F.col("page") + 1)).otherwise(" No more pages.")
    hint = F.concat(F.format_string("Page %d. Showing %d of %d matches.", "page", "shown", "matches"), more)
    return facts.withColumn("hint", hint).crossJoin(results).select("results", "page", "shown", F.col("matches").alias("total"), "has_more", "hint")


def body_limit(remaining_chars: int, average_line: int) -> int:
    """Lines of a body that still fit, between 20 and 80."""
    return max(20, min(80, remaining_chars // max(1, average_line)))


def cut_body(body, most: int = 80):
    """A body's first lines and a line that says how many are missing."""
    rows = F.split(X.col(body), "\n")
    left = F.size(rows) - F.lit(max(20, most))
    return F.when(left > 0, F.concat(F.array_join(F.slice(rows, 1, max(20, most)), "\n"), F.format_string("\n... (%d more lines)", left))).otherwise(X.col(body))
