"""The catalogue of queries over the driver's tables, each with its SQL form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, changes, context, graph, lookup, ranking, summary, vectors
from ..sources import resolve
from ..streaming import events
from . import oracle as O
from . import projection as P
from .frames import first_per
from .service import Service

def seed(ix) -> str:
    """The most referenced name: a parameter, one row."""
    return ix.refs.groupBy("name").count().orderBy(F.desc("count"), "name").first()[0]


def _with(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A query on (index, seed)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = P.index(spark, sf_dir)
        return f(ix, seed(ix))

    return run


def _on(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A query on the index alone."""
    return lambda spark, sf_dir: f(P.index(spark, sf_dir))


def _hub(ix) -> str:
    return graph.dep_edges(ix).groupBy("dst").count().orderBy(F.desc("count"), "dst").first()[0]


def _top(ix, n: int = 10) -> DataFrame:
    """The most referenced names."""
    return ix.refs.groupBy("name").count().orderBy(F.desc("count"), "name").limit(n).select("name")


_TOP_SQL = "SELECT name FROM refs GROUP BY name ORDER BY count(*) DESC, name LIMIT 10"


def _importer(ix) -> str:
    """The file under src/ that imports most."""
    return ix.imports.filter("source_file <> 'src/main.rs'").groupBy("source_file").count().orderBy(F.desc("count"), "source_file").first()[0]


def _far(ix, name: str) -> str:
    """Least name among the seed's furthest callers within three steps: the start of a call path."""
    far = graph.callers(ix, name, 3).filter(F.col("caller_kind") != "module")
    return far.orderBy(F.desc("depth"), "caller_name").first()["caller_name"]


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return P.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _new_symbols(ix) -> DataFrame:
    """A later snapshot: every seventh symbol gone, every fifth with another signature, every thirteenth new."""
    s = ix.symbols
    kept = s.filter("id % 7 <> 0").withColumn("signature", F.when(F.col("id") % 5 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature")))
    return kept.unionByName(s.filter("id % 13 = 0").withColumn("name", F.concat("name", F.lit("_new"))))


def _hunks(spark: SparkSession, sf_dir: str, ix) -> DataFrame:
    return P.table(spark, sf_dir, "lineitem").join(ix.symbols.select(F.col("id").alias("l_partkey"), "file"), "l_partkey").select("file", (F.col("l_linenumber") * 40).cast("long").alias("first"), (F.col("l_linenumber") * 40 + F.col("l_quantity")).cast("long").alias("last")).distinct()


_SNAPSHOT_SQL = """, newer AS (
  SELECT id, file, name, kind, scope, line, CASE WHEN id % 5 = 0 THEN signature || '!' ELSE signature END AS signature FROM symbols WHERE id % 7 <> 0
  UNION ALL SELECT id, file, name || '_new', kind, scope, line, signature FROM symbols WHERE id % 13 = 0
), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, name, kind, scope ORDER BY line, signature) AS r FROM symbols) WHERE r = 1
), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, name, kind, scope ORDER BY line, signature) AS r FROM newer) WHERE r = 1
), diff AS (
  SELECT coalesce(o.file, n.file) AS file, coalesce(o.name, n.name) AS name, coalesce(o.kind, n.kind) AS kind, coalesce(o.scope, n.scope) AS scope, coalesce(n.line, o.line) AS line,
    CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' WHEN o.signature <> n.signature THEN 'modified' END AS change
  FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name AND o.kind = n.kind AND o.scope IS NOT DISTINCT FROM n.scope
), hunk AS (
  SELECT DISTINCT s.file, CAST(l_linenumber * 40 AS BIGINT) AS first, CAST(l_linenumber * 40 + l_quantity AS BIGINT) AS last FROM lineitem JOIN symbols s ON s.id = l_partkey
), touched AS (
  SELECT DISTINCT s.id, s.file, s.name, s.kind, s.line FROM symbols s JOIN hunk h ON h.file = s.file AND s.line <= h.last AND h.first <= coalesce(s.end_line, s.line)
)"""


def _diff(ix) -> DataFrame:
    return changes.snapshot_diff(ix.symbols, _new_symbols(ix))


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    return changes.overlapping(ix.symbols, _hunks(spark, sf_dir, ix)).select("id", "file", "name", "kind", "line")


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.merged(_diff(P.index(spark, sf_dir)), _touched(spark, sf_dir).withColumn("change", F.lit("modified")))


_CHANGED = "SELECT DISTINCT name FROM diff WHERE change IS NOT NULL"


def _search_rows(ix, name: str) -> DataFrame:
    return ranking.classify(X.grep(P.code_lines(ix), name), ix)


_SEARCH_SQL = """, hits AS (SELECT c.* FROM code c, seed s WHERE contains(c.content, s.name)
), classed AS (
  SELECT h.file, h.line, CAST(1 AS BIGINT) AS col, h.content, CASE WHEN {test} THEN 'test' WHEN d.file IS NOT NULL THEN 'definition' WHEN regexp_matches(h.content, '^\\s*(use\\s|import\\s|from\\s)') THEN 'import' WHEN starts_with(ltrim(h.content), '//') THEN 'comment' WHEN r.file IS NOT NULL THEN 'call_site' ELSE 'other' END AS category
  FROM hits h LEFT JOIN (SELECT DISTINCT file, line FROM symbols) d ON d.file = h.file AND d.line = h.line LEFT JOIN (SELECT DISTINCT file, line FROM refs) r ON r.file = h.file AND r.line = h.line
), tiered AS (SELECT *, CASE category WHEN 'definition' THEN 0 WHEN 'call_site' THEN 1 WHEN 'import' THEN 2 WHEN 'other' THEN 3 WHEN 'comment' THEN 4 ELSE 5 END AS tier FROM classed
), counted AS (SELECT count(*) FILTER (category = 'definition') AS defs, count(*) FILTER (category = 'import') AS uses FROM tiered
), folded AS (
  SELECT t.*, CASE WHEN defs > 0 AND uses > 0 AND category = 'definition' THEN '(+' || uses || ' other location' || CASE WHEN uses = 1 THEN ')' ELSE 's)' END END AS annotation
  FROM tiered t, counted WHERE NOT (defs > 0 AND uses > 0 AND category = 'import')
)""".replace("{test}", O.TEST.format("h.file"))


def _rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    service = Service(ix, P.code_lines(ix), lambda _: _query_vector(spark, sf_dir))
    return _rounded(service.search(seed(ix), mode="semantic", include_tests=True), "score")


_Q = ", q AS (SELECT vector AS qv FROM vectors WHERE symbol_id = 0), scored AS (SELECT v.symbol_id, v.file, v.stale, list_dot_product(v.vector, q.qv) AS score FROM vectors v, q)"

_RRF_SQL = _Q + """, top AS (SELECT symbol_id, score FROM scored ORDER BY score DESC, symbol_id LIMIT 20
), sem AS (SELECT row_number() OVER (ORDER BY score DESC, symbol_id) AS rank, s.name, s.kind, s.file, s.line, score FROM top JOIN symbols s ON s.id = symbol_id
), str AS (SELECT row_number() OVER (ORDER BY file, line, content) AS rank, c.file, c.line, c.content FROM code c, seed s WHERE contains(c.content, s.name)
), lists AS (
  SELECT file, line, rank, content, 0 AS list, CAST(NULL AS VARCHAR) AS annotation FROM str UNION ALL SELECT file, line, rank, name || ' (' || kind || ')', 1, format('[semantic: {:.2f}]', score) FROM sem
)
SELECT file, line, arg_min(content, list * 1000000 + rank) AS content, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score,
  CASE WHEN count(*) > 1 THEN 'both' WHEN min(list) = 0 THEN 'structural' ELSE 'semantic' END AS source,
  CASE WHEN min(list) = 0 THEN NULL ELSE arg_min(annotation, list * 1000000 + rank) END AS annotation FROM lists GROUP BY file, line"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    return _rounded(vectors.resolved(vectors.top_k(ix.embeddings, _query_vector(spark, sf_dir), 10), ix), "score")


def _semantic_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    return _rounded(vectors.resolved(vectors.top_k(vectors.scoped(ix, "src/m1"), _query_vector(spark, sf_dir), 10), ix), "score")


def _semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    return vectors.without_structural(_semantic(spark, sf_dir), X.grep(P.code_lines(ix), "_1"))


def _ask_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    near = graph.reach(ix, _hub(ix), reverse=True)
    return _rounded(vectors.ask(ix, _query_vector(spark, sf_dir), 20, near), "score")


def _semantic_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    newer = first_per(_new_symbols(ix), list(changes.KEY), "line", "signature").select("id", *[F.col(c).alias(f"n_{c}") for c in changes.KEY])
    there = _diff(ix).filter("change <> 'removed'").join(newer, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in changes.KEY])
    changed = there.join(ix.embeddings.select("symbol_id", "vector"), F.col("id") == F.col("symbol_id")).select(*changes.KEY, "vector")
    return _rounded(vectors.impact(changed, ix, 20), "score")


_IMPACT_SQL = _SNAPSHOT_SQL + """, ch AS (SELECT n.file AS cf, n.name AS changed, n.kind AS ck, n.scope AS cs, v.vector AS q FROM diff d JOIN n ON n.file = d.file AND n.name = d.name AND n.kind = d.kind AND n.scope IS NOT DISTINCT FROM d.scope JOIN vectors v ON v.symbol_id = n.id WHERE d.change IN ('added', 'modified')
), sc AS (SELECT ch.* EXCLUDE (q), symbol_id, round(list_dot_product(vector, q), 12) AS score FROM vectors, ch
), nth AS (SELECT *, row_number() OVER (PARTITION BY cf, changed, ck, cs ORDER BY score DESC, symbol_id) AS r FROM sc
), oth AS (SELECT * FROM nth WHERE r <= 20 AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = changed AND s.kind = ck AND s.file = cf AND s.id = symbol_id)
), best AS (SELECT o.changed, s.name, s.kind, s.file, s.line, o.score, row_number() OVER (PARTITION BY s.name, s.kind, s.file, s.line ORDER BY o.score DESC, o.changed, o.symbol_id) AS b FROM oth o JOIN symbols s ON s.id = o.symbol_id)
SELECT changed, name, kind, file, line, round(score, 6) AS score FROM best WHERE b = 1"""


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.index(spark, sf_dir).embeddings
    unit = v.withColumn("unit", vectors.normalized(F.transform("vector", lambda x: x * 3)))
    return unit.select("symbol_id", F.round(vectors.norm("vector"), 6).alias("norm"), F.round(vectors.norm("unit"), 6).alias("unit_norm"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))


def _silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.silhouette(_labelled(spark, sf_dir)), "silhouette")


_SILHOUETTE_SQL = """WITH a AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings),
p AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM a WHERE n <= 1000 OR r % CAST(ceil(n / 1000.0) AS BIGINT) = 0),
d AS (SELECT a.id, a.cluster, b.cluster AS c2, avg(list_distance(a.v, b.v)) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
e AS (SELECT id, cluster, min(d) FILTER (cluster = c2) AS a, min(d) FILTER (cluster <> c2) AS b FROM d GROUP BY id, cluster)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS points FROM e"""


def _budget(page: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = P.index(spark, sf_dir)
        found = _search_rows(ix, seed(ix)).select("tier", "file", "line", "content")
        out = budget.within(found, 120, ["tier", "file", "line", "content"], page, "content")
        return out.filter("taken").select(F.col("position").cast("long").alias("position"), "file", "line", "content", "tokens")

    return run


def _budget_sql(page: int) -> str:
    return O.sql(
        _SEARCH_SQL
        + f""", numbered AS (SELECT row_number() OVER (ORDER BY tier, file, line, content) AS position, file, line, content, CAST(ceil(octet_length(encode(content)) / 4.0) AS BIGINT) AS tokens FROM tiered
), fold(position, skip, used, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST({(page - 1) * 120} AS BIGINT), CAST(0 AS BIGINT), false UNION ALL
  SELECT n.position, CASE WHEN f.skip > 0 AND n.tokens <= f.skip THEN f.skip - n.tokens ELSE 0 END, CASE WHEN f.skip = 0 AND f.used + n.tokens <= 120 THEN f.used + n.tokens ELSE f.used END, f.skip = 0 AND f.used + n.tokens <= 120
  FROM fold f JOIN numbered n ON n.position = f.position + 1
) SELECT n.position, file, line, content, tokens FROM fold JOIN numbered n USING (position) WHERE taken"""
    )


def _service_page(page: int):
    """A page of the callers, by the service, in their order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = P.index(spark, sf_dir)
        return Service(ix).call("callers", limit=300, page=page, name=seed(ix), depth=2, include_tests=True)

    return run


def _service_page_sql(page: int) -> str:
    return f"""WITH RECURSIVE called AS ({O.callers(2)}),
numbered AS (SELECT *, row_number() OVER (ORDER BY depth, file, line, caller_name) AS position, CAST(ceil(octet_length(encode(CAST(to_json({{'caller_name': caller_name, 'caller_kind': caller_kind, 'file': file, 'line': line, 'signature': signature, 'depth': depth, 'target_file': target_file, 'confidence': confidence}}) AS VARCHAR))) / 4.0) AS BIGINT) AS tokens FROM called),
fold(position, skip, used, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST({(page - 1) * 300} AS BIGINT), CAST(0 AS BIGINT), false UNION ALL
  SELECT n.position, CASE WHEN f.skip > 0 AND n.tokens <= f.skip THEN f.skip - n.tokens ELSE 0 END, CASE WHEN f.skip = 0 AND f.used + n.tokens <= 300 THEN f.used + n.tokens ELSE f.used END, f.skip = 0 AND f.used + n.tokens <= 300
  FROM fold f JOIN numbered n ON n.position = f.position + 1
) SELECT n.* EXCLUDE (position) FROM fold JOIN numbered n USING (position) WHERE taken"""


def _stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    follower = events.Follower(spark)
    return follower.run(events.file_event_stream(spark, sf_dir)).select("path", "op", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "hash")


_EVENTS = "SELECT 'src/f' || CAST(user_id AS STRING) || '.rs' AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS op, ts, md5(props) AS hash, event_id FROM events"


def _debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.debounced(events.file_events(spark, sf_dir))
    return out.select("path", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")], "events", "op")


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events.file_events(spark, sf_dir)
    return events.reconciled(events.latest(e.filter("event_id % 3 <> 0")).filter("op <> 'deleted'"), events.latest(e).filter("op <> 'deleted'"))


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    calls = ix.refs.select("name", "file", "line").distinct()
    return resolve.targets(calls, ix.symbols).select("name", "file", "line", "target_id")


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.index(spark, sf_dir)
    kind = F.when(F.col("line") % 5 == 0, "import").otherwise("call")
    calls = ix.refs.select("name", "file", "line", "caller_id").distinct().withColumn("kind", kind)
    return resolve.confidence(calls, ix.symbols, ix.imports).select("name", "file", "line", "caller_id", "confidence")


def _entry_file(ix) -> str:
    return ix.symbols.groupBy("file").count().orderBy(F.desc("count"), "file").first()[0]


def _sources(ix) -> DataFrame:
    """A text for each file whose lines say which they are."""
    return ix.files.select("path", F.array_join(F.transform(F.sequence(F.lit(1), F.col("line_count")), lambda n: F.format_string("line %d of %s", n, "path")), "\n").alias("content"))


def _given_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, distances and representatives by the centres of the first eight vectors."""
    ix = P.index(spark, sf_dir)
    first = [r[0] for r in ix.embeddings.filter("symbol_id < 8").orderBy("symbol_id").select("vector").collect()]
    out = vectors.representatives(vectors.nearest_centres(ix.embeddings, first), ix, 3)
    return out.select(F.col("cluster").cast("long").alias("cluster"), F.col("nth").cast("long").alias("nth"), "symbol_id", "name", "file", F.round("distance", 6).alias("distance"), "representative")


_CENTRES_SQL = O.sql(""", c AS (SELECT symbol_id AS cluster, vector AS centre FROM vectors WHERE symbol_id < 8),
d AS (SELECT symbol_id, cluster, list_distance(vector, centre) AS distance FROM vectors, c),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY round(distance, 9), cluster) AS r FROM d) WHERE r = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, symbol_id) AS nth FROM m)
SELECT cluster, nth, symbol_id, coalesce(name, '') AS name, coalesce(s.file, '') AS file, round(distance, 6) AS distance, nth <= 3 AS representative FROM o LEFT JOIN symbols s ON s.id = symbol_id""")

_CONTEXT_SQL = O.flows(O.entry_names(0.5, 20), 5, 4, 0.5) + """
SELECT s.id, s.name, s.kind, s.file, s.line,
  (SELECT count(*) FROM (SELECT DISTINCT c.name, c.kind, c.file, c.line FROM refs r JOIN seed USING (name) JOIN symbols c ON c.id = r.caller_id WHERE r.confidence >= 0.5)) AS n_callers,
  (SELECT count(DISTINCT source_file) FROM imports, seed WHERE ends_with(lower(import_path), lower(name))) AS n_importers,
  (SELECT count(*) FROM (SELECT DISTINCT file, line, context FROM refs JOIN seed USING (name) WHERE caller_id IS NULL AND confidence >= 0.5)) AS n_type_users,
  e.n AS n_callees, i.n AS n_imports, k.n AS n_children, (SELECT count(DISTINCT entry) FROM flow JOIN seed USING (name)) AS n_flows
FROM symbols s JOIN seed USING (name)
LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT DISTINCT r.caller_id AS id, r.name, coalesce(d.kind, 'function') AS kind, coalesce(d.file, '') AS file, coalesce(d.line, 0) AS line FROM refs r LEFT JOIN symbols d ON d.name = r.name AND d.kind IN ('function', 'method') WHERE r.caller_id IS NOT NULL AND r.confidence >= 0.5) GROUP BY id) e ON e.id = s.id
LEFT JOIN (SELECT source_file, count(*) AS n FROM imports GROUP BY source_file) i ON i.source_file = s.file
LEFT JOIN (SELECT parent_id, count(*) AS n FROM type_edges GROUP BY parent_id) k ON k.parent_id = s.id"""

_TOPFILE = ", topfile AS (SELECT file FROM symbols GROUP BY file ORDER BY count(*) DESC, file LIMIT 1)"
_CONTAINS = "contains(lower(name), 'red')"

QUERIES: dict[str, tuple[Callable, str | None]] = {
    "grep_literal": (lambda s, d: X.grep(P.text_lines(s, d), "than the "), O.sql("SELECT file, line, CAST(1 AS BIGINT) AS col, content FROM texts WHERE contains(content, 'than the ')")),
    "grep_regex": (lambda s, d: X.grep(P.text_lines(s, d), r"\bth[a-n]+nd\b", regex=True), O.sql(r"SELECT file, line, CAST(1 AS BIGINT) AS col, content FROM texts WHERE regexp_matches(content, '\bth[a-n]+nd\b')")),
    "grep_ignore_case": (lambda s, d: X.grep(P.text_lines(s, d), "LICENSE", ignore_case=True), O.sql("SELECT file, line, CAST(1 AS BIGINT) AS col, content FROM texts WHERE contains(lower(content), 'license')")),
    "comment_lines": (_on(lambda ix: P.code_lines(ix).filter(X.is_comment_line("content")).select("file", "line", "content")), O.sql(r"SELECT file, line, content FROM code WHERE regexp_matches(content, '^\s*(//|/\*|\* |\*/|#)') AND NOT regexp_matches(content, '^\s*#include')")),
    "search_ranked": (_with(lambda ix, n: ranking.rank(_search_rows(ix, n)).select("tier", "category", "file", "line", "content")), O.sql(_SEARCH_SQL + " SELECT tier, category, file, line, content FROM tiered")),
    "search_dedup": (_with(lambda ix, n: ranking.search(P.code_lines(ix), ix, n).select("tier", "category", "file", "line", "content", "annotation")), O.sql(_SEARCH_SQL + " SELECT tier, category, file, line, content, annotation FROM folded")),
    "search_grouped": (
        _with(lambda ix, n: ranking.grouped(ranking.search(P.code_lines(ix), ix, n))),
        O.sql(_SEARCH_SQL + " SELECT tier, category, CASE category WHEN 'definition' THEN 'definitions' WHEN 'call_site' THEN 'usages' WHEN 'other' THEN 'usages' WHEN 'import' THEN 'imports' WHEN 'comment' THEN 'comments' ELSE 'tests' END AS heading, count(*) AS n, min(file) AS first_file, max(file) AS last_file FROM folded GROUP BY tier, category"),
    ),
    "search_mode_count": (_on(lambda ix: lookup.phrase_count(ix, "red gizmo")), O.sql(r"SELECT count(*) AS n FROM symbols WHERE contains(' ' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') || ' ', ' red gizmo ')")),
    "rrf_fusion": (_rrf, O.sql(_RRF_SQL)),
    "sym_exact": (_with(lambda ix, n: lookup.symbols(ix, n, exact=True).select("id", "name", "kind", "file", "line", "scope", "signature")), O.sql("SELECT id, s.name, kind, file, line, scope, signature FROM symbols s JOIN seed USING (name)")),
    "sym_substring": (_on(lambda ix: lookup.symbols(ix, "Red_", limit=40).select("id", "name", "kind", "file", "line")), O.sql(f"SELECT id, name, kind, file, line FROM symbols WHERE lower(name) LIKE '%red_%' ORDER BY {O.LOOSE.format('file')}, file, line, id LIMIT 40")),
    "sym_kind_file_scope": (_on(lambda ix: lookup.symbols(ix, "e", "method", "/f1", "Brand#11").select("id", "name", "file", "scope")), O.sql("SELECT id, name, file, scope FROM symbols WHERE contains(lower(name), 'e') AND kind = 'method' AND contains(lower(file), '/f1') AND scope = 'Brand#11'")),
    "ref_lookup": (_with(lambda ix, n: lookup.references(ix, n).drop("col")), O.sql("SELECT r.name, 'call' AS kind, r.file, r.line, r.context, c.name AS caller_name, r.confidence FROM refs r JOIN seed USING (name) LEFT JOIN symbols c ON c.id = r.caller_id")),
    "ref_with_subclasses": (
        _with(lambda ix, n: lookup.references_and_subclasses(ix, n, ["src/m1", "src/m2"]).drop("col")),
        O.sql("SELECT r.name, 'call' AS kind, r.file, r.line, r.context, c.name AS caller_name, r.confidence FROM refs r JOIN seed USING (name) LEFT JOIN symbols c ON c.id = r.caller_id WHERE r.file LIKE 'src/m1%' OR r.file LIKE 'src/m2%' UNION ALL SELECT k.name, 'subclass', k.file, k.line, k.signature, NULL, 1.0 FROM seed n JOIN symbols p ON lower(p.name) LIKE '%' || lower(n.name) || '%' JOIN type_edges e ON e.parent_id = p.id JOIN symbols k ON k.id = e.child_id WHERE k.file LIKE 'src/m1%' OR k.file LIKE 'src/m2%'"),
    ),
    "ref_files_only": (_with(lambda ix, n: lookup.reference_files(ix, n)), O.sql("SELECT file FROM refs JOIN seed USING (name) UNION SELECT k.file FROM seed n JOIN symbols p ON lower(p.name) LIKE '%' || lower(n.name) || '%' JOIN type_edges e ON e.parent_id = p.id JOIN symbols k ON k.id = e.child_id")),
    "sig_lookup": (_on(lambda ix: lookup.signatures(ix, "red")), O.sql(f"SELECT id, name, kind, file, line, signature FROM symbols WHERE {_CONTAINS} AND kind IN ('function', 'method')")),
    "file_symbols": (_on(lambda ix: lookup.file_symbols(ix, _entry_file(ix))), O.sql(_TOPFILE + " SELECT id, name, kind, line, scope, signature FROM symbols JOIN topfile USING (file)")),
    "near_names": (_on(lambda ix: lookup.near_names(ix, "red", 5)), O.sql(f"SELECT name FROM (SELECT DISTINCT name FROM symbols WHERE {_CONTAINS}) ORDER BY length(name), name LIMIT 5")),
    "deps": (_on(lambda ix: lookup.deps(ix, "src/main.rs")), O.sql("SELECT DISTINCT import_path FROM imports WHERE source_file = 'src/main.rs'")),
    "rdeps": (_on(lambda ix: lookup.rdeps(ix, "src/m1/f12.rs")), O.sql("SELECT DISTINCT source_file FROM imports WHERE lower(import_path) LIKE '%f12' AND source_file <> 'src/m1/f12.rs'")),
    "show_symbol": (_on(lambda ix: lookup.show_symbol(ix, "red_", file="f1").drop("end_line")), O.sql("SELECT id, name, kind, file, line, scope, signature FROM symbols WHERE contains(lower(name), 'red_') AND contains(lower(file), 'f1')")),
    "show_file": (_on(lambda ix: lookup.show_file(ix, "src/m1/")), O.sql("SELECT id, name, kind, file, line, end_line, signature FROM symbols WHERE starts_with(lower(file), 'src/m1/') AND scope IS NULL")),
    "show_shallow": (
        _on(lambda ix: lookup.bodies(lookup.show_symbol(ix, "red_"), ix, _sources(ix), "shallow").select("id", "name", "file", "body")),
        O.sql("SELECT id, name, file, signature AS body FROM symbols WHERE contains(lower(name), 'red_')"),
    ),
    "show_bodies": (
        _on(lambda ix: lookup.bodies(lookup.show_symbol(ix, "red_"), ix, _sources(ix), most=30).select("id", "name", "file", "body")),
        O.sql("""SELECT id, name, file, CASE WHEN kind IN ('class', 'struct', 'interface') AND end_line - line + 1 > 30 THEN signature ELSE
  (SELECT string_agg('line ' || CAST(x AS STRING) || ' of ' || file, chr(10) ORDER BY x) FROM range(line, least(end_line, line + 29) + 1) t(x)) || CASE WHEN end_line - line + 1 > 30 THEN chr(10) || '... (' || CAST(end_line - line - 29 AS STRING) || ' more lines)' ELSE '' END END AS body FROM symbols WHERE contains(lower(name), 'red_')"""),
    ),
    "show_lines": (lambda s, d: P.table(s, d, "documents").select("doc_id", X.line_range("text", 2, 4).alias("body")), "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS body FROM documents"),
    "callers_d1": (_with(lambda ix, n: graph.callers(ix, n, 1)), O.callers(1)),
    "callers_d3": (_with(lambda ix, n: graph.callers(ix, n, 3)), O.callers(3)),
    "callers_filtered": (_with(lambda ix, n: graph.callers(ix, n, 2, 0.8, None, "src/m5")), O.callers(2, 0.8, "contains(c.file, 'src/m5')")),
    "callers_module": (_with(lambda ix, n: graph.callers(ix, n, 1).filter("caller_name = '<module>'")), f"SELECT * FROM ({O.callers(1)}) WHERE caller_name = '<module>'"),
    "callees_d1": (_with(lambda ix, n: graph.callees(ix, n, 1)), O.callees(1)),
    "callees_d3": (_with(lambda ix, n: graph.callees(ix, n, 3)), O.callees(3)),
    "callpath": (
        _with(lambda ix, n: graph.call_path(ix, _far(ix, n), n)),
        O.sql(
            O.upstream(3)
            + """, far AS (SELECT name FROM levels WHERE depth > 0 ORDER BY depth DESC, name LIMIT 1), e AS (SELECT DISTINCT c.name AS a, r.name AS b FROM refs r JOIN symbols c ON c.id = r.caller_id),
fwd(name, depth) AS (SELECT name, 0 FROM far UNION SELECT e.b, f.depth + 1 FROM fwd f JOIN e ON e.a = f.name WHERE f.depth < 3),
flev AS (SELECT name, min(depth) AS depth FROM fwd GROUP BY name), par AS (SELECT y.name, min(x.name) AS parent FROM flev y JOIN e ON e.b = y.name JOIN flev x ON x.name = e.a AND x.depth = y.depth - 1 GROUP BY y.name),
back(name, depth) AS (SELECT l.name, l.depth FROM flev l JOIN seed USING (name) UNION ALL SELECT p.parent, b.depth - 1 FROM back b JOIN par p ON p.name = b.name WHERE b.depth > 0)
SELECT CAST(b.depth AS BIGINT) AS hop, b.name, s.kind, s.file, s.line FROM back b JOIN (SELECT DISTINCT ON (name) * FROM symbols ORDER BY name, file, line, id) s ON s.name = b.name"""
        ),
    ),
    "entry_points": (_on(lambda ix: graph.entry_points(ix, 0.9)), O.sql("SELECT id, name, kind, file, line FROM symbols s WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name = s.name AND r.caller_id IS NOT NULL AND r.confidence >= 0.9)")),
    "flow_trace": (_on(lambda ix: graph.flows(ix, graph.entry_points(ix, 0.9), 5, 4, 0.5)), O.sql(O.flows(O.entry_names(0.9), 5, 4, 0.5) + " SELECT entry, step, name, kind, file, line, CAST(depth AS BIGINT) AS depth FROM flow")),
    "blast_up": (_with(lambda ix, n: graph.blast(ix, [n], "upstream", 3)), O.sql(O.blast(3) + " SELECT * FROM affected")),
    "blast_down": (_with(lambda ix, n: graph.blast(ix, [n], "downstream", 2)), O.sql(O.blast(2, True) + " SELECT * FROM affected")),
    "blast_tiers": (_with(lambda ix, n: graph.blast_tiers(graph.blast(ix, [n], "upstream", 3))), O.sql(O.blast(3) + " SELECT source, severity, count(*) AS n, count(DISTINCT file) AS files, min(depth) AS least_depth FROM affected GROUP BY source, severity")),
    "blast_risk": (_with(lambda ix, n: graph.blast_risk(graph.blast(ix, _top(ix), "upstream", 1))), O.sql(O.blast(1, names=_TOP_SQL) + f" SELECT source, count(*) AS total, count(DISTINCT file) AS files, {O.RISK.format('count(*)')} AS risk FROM affected GROUP BY source")),
    "dep_edges": (_on(graph.dep_edges), O.sql(O.DEP_EDGES + " SELECT src, dst FROM dep_edges")),
    "reach_from": (_on(lambda ix: graph.reach(ix, _importer(ix))), O.sql(O.DEP_EDGES + O.reach("w", "SELECT file FROM importer") + " SELECT file FROM w")),
    "reach_to": (_on(lambda ix: graph.reach(ix, _hub(ix), reverse=True)), O.sql(O.DEP_EDGES + O.reach("w", "SELECT file FROM hub", True) + " SELECT file FROM w")),
    "reach_between": (_on(lambda ix: graph.reach_between(ix, "src/main.rs", _hub(ix))), O.sql(O.DEP_EDGES + O.reach("w", "SELECT 'src/main.rs'") + O.reach("v", "SELECT file FROM hub", True) + " SELECT file FROM w INTERSECT SELECT file FROM v")),
    "ctx_callers": (_with(lambda ix, n: context.callers(ix, n, 0.8)), O.sql("SELECT DISTINCT c.name, c.kind, c.file, c.line FROM refs r JOIN seed USING (name) JOIN symbols c ON c.id = r.caller_id WHERE r.confidence >= 0.8")),
    "ctx_importers": (_on(lambda ix: context.importers(ix, "F12")), O.sql("SELECT DISTINCT source_file FROM imports WHERE ends_with(lower(import_path), 'f12')")),
    "ctx_type_users": (_with(lambda ix, n: context.type_users(ix, n)), O.sql("SELECT DISTINCT file, line, context FROM refs JOIN seed USING (name) WHERE caller_id IS NULL")),
    "ctx_callees": (
        _with(lambda ix, n: context.callees(ix, context.matching(ix, n))),
        O.sql("SELECT DISTINCT s.id, r.name, coalesce(d.kind, 'function') AS kind, coalesce(d.file, '') AS file, coalesce(d.line, 0) AS line FROM symbols s JOIN seed USING (name) JOIN refs r ON r.caller_id = s.id LEFT JOIN symbols d ON d.name = r.name AND d.kind IN ('function', 'method')"),
    ),
    "ctx_children": (_with(lambda ix, n: context.children(ix, ix.symbols.select("id"))), O.sql("SELECT e.parent_id AS id, k.name, k.kind, k.file, k.line, e.relationship FROM type_edges e JOIN symbols p ON p.id = e.parent_id JOIN symbols k ON k.id = e.child_id")),
    "symbol_context": (_with(lambda ix, n: context.symbol_context(ix, n, min_confidence=0.5).select("id", "name", "kind", "file", "line", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("callers", "importers", "type_users", "callees", "imports", "children", "flows")])), O.sql(_CONTEXT_SQL)),
    "summary_languages": (_on(lambda ix: summary.languages(ix, "src/m1")), O.sql("SELECT language, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM files WHERE starts_with(path, 'src/m1/') GROUP BY language")),
    "summary_kinds": (_on(lambda ix: summary.kinds(ix, "src/m1/")), O.sql("SELECT kind, count(*) AS n FROM symbols WHERE starts_with(file, 'src/m1/') GROUP BY kind")),
    "summary_deps": (_on(lambda ix: summary.dependencies(ix, "./src/m1")), O.sql("SELECT count(DISTINCT import_path) AS deps FROM imports WHERE starts_with(source_file, 'src/m1/')")),
    "summary_tree": (
        _on(summary.roll_up),
        O.sql(
            """, up AS (SELECT path, CASE WHEN n = 0 THEN '.' ELSE array_to_string(list_slice(string_split(path, '/'), 1, n), '/') END AS node FROM (SELECT path, unnest(range(0, len(string_split(path, '/')) + 1)) AS n FROM (SELECT path FROM files UNION SELECT source_file FROM imports))
), f AS (SELECT node, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM files JOIN up USING (path) GROUP BY node
), s AS (SELECT node, count(*) AS symbols FROM symbols JOIN up ON up.path = file GROUP BY node
), d AS (SELECT node, count(DISTINCT import_path) AS deps FROM imports JOIN up ON up.path = source_file GROUP BY node)
SELECT f.node AS path, CASE WHEN f.node = '.' THEN NULL WHEN contains(f.node, '/') THEN regexp_replace(f.node, '/[^/]*$', '') ELSE '.' END AS parent, CAST(CASE WHEN f.node = '.' THEN 0 ELSE len(string_split(f.node, '/')) END AS BIGINT) AS depth, files, lines, coalesce(symbols, 0) AS symbols, coalesce(deps, 0) AS deps FROM f LEFT JOIN s USING (node) LEFT JOIN d USING (node)"""
        ),
    ),
    "summary_depth": (
        _on(lambda ix: summary.tree(ix, "src", 1).select("path", "parent", F.col("level").cast("long").alias("level"), "type", "files", "lines", "symbols", "deps")),
        O.sql("""SELECT p.path, CASE WHEN p.path = 'src' THEN NULL ELSE 'src' END AS parent, CAST(CASE WHEN p.path = 'src' THEN 0 ELSE 1 END AS BIGINT) AS level, 'directory' AS type, (SELECT count(*) FROM files WHERE starts_with(path, p.path || '/')) AS files,
  (SELECT CAST(sum(line_count) AS BIGINT) FROM files WHERE starts_with(path, p.path || '/')) AS lines, (SELECT count(*) FROM symbols WHERE starts_with(file, p.path || '/')) AS symbols, (SELECT count(DISTINCT import_path) FROM imports WHERE starts_with(source_file, p.path || '/')) AS deps
FROM (SELECT 'src' AS path UNION SELECT DISTINCT 'src/' || string_split(path, '/')[2] FROM files) p"""),
    ),
    "summary_children": (_on(lambda ix: summary.children(ix, ".").select("path", "files", "lines", "symbols")), O.sql("SELECT 'src/' || string_split(path, '/')[2] AS path, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(symbols_count) AS BIGINT) AS symbols FROM files GROUP BY 1")),
    "summary_import_edges": (
        _on(lambda ix: summary.import_edges(ix, "src/m1")),
        O.sql(r"""SELECT DISTINCT i.source_file AS "from", f.path AS "to" FROM imports i JOIN files f ON regexp_extract(f.path, '([^/]*)\.rs$', 1) = substr(i.import_path, 3) WHERE starts_with(i.source_file, 'src/m1/') AND starts_with(f.path, 'src/m1/') AND i.source_file <> f.path"""),
    ),
    "root_dirs": (_on(summary.root_dirs), O.sql("SELECT DISTINCT string_split(path, '/')[1] AS dir FROM files WHERE contains(path, '/')")),
    "outline": (_on(lambda ix: summary.outline(ix, _entry_file(ix))), O.sql(_TOPFILE + " SELECT id, name, kind, line FROM symbols JOIN topfile USING (file) WHERE scope IS NULL AND kind <> 'method' ORDER BY line, id LIMIT 50")),
    "semantic_topk": (_semantic, O.sql(_Q + " SELECT symbol_id, name, kind, s.file, line, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, symbol_id LIMIT 10) t JOIN symbols s ON s.id = t.symbol_id")),
    "semantic_scoped": (_semantic_scoped, O.sql(_Q + " SELECT symbol_id, name, kind, s.file, line, round(score, 6) AS score FROM (SELECT * FROM scored WHERE file LIKE 'src/m1%' AND NOT stale ORDER BY score DESC, symbol_id LIMIT 10) t JOIN symbols s ON s.id = t.symbol_id")),
    "semantic_dedup": (_semantic_dedup, O.sql(_Q + " SELECT symbol_id, name, kind, s.file, s.line, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, symbol_id LIMIT 10) t JOIN symbols s ON s.id = t.symbol_id WHERE NOT EXISTS (SELECT 1 FROM code c WHERE contains(c.content, '_1') AND c.file = s.file AND c.line = s.line)")),
    "semantic_ask_reachable": (_ask_reachable, O.sql(_Q + O.DEP_EDGES + O.reach("w", "SELECT file FROM hub", True) + " SELECT symbol_id, name, kind, s.file, line, round(score, 6) AS score FROM (SELECT * FROM scored WHERE file IN (SELECT file FROM w) ORDER BY score DESC, symbol_id LIMIT 20) t JOIN symbols s ON s.id = t.symbol_id")),
    "semantic_impact": (_semantic_impact, O.sql(_IMPACT_SQL)),
    "l2_norm": (_norms, "SELECT vec_id AS symbol_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings"),
    "centroid_mean": (lambda s, d: _rounded(vectors.centroids(_labelled(s, d)).select("cluster", F.col("dim").cast("long").alias("dim"), "mean"), "mean"), "SELECT label AS cluster, CAST(i - 1 AS BIGINT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i"),
    "silhouette_given_labels": (_silhouette, _SILHOUETTE_SQL),
    "cluster_given_centres": (_given_centres, _CENTRES_SQL),
    "kmeans_clusters": (_on(lambda ix: vectors.cluster(vectors.scoped(ix, ""), 5).select("symbol_id", "cluster", F.round("distance", 6).alias("distance"))), None),
    "cluster_representatives": (_on(lambda ix: vectors.representatives(vectors.cluster(vectors.scoped(ix, ""), 4), ix)), None),
    "snapshot_diff": (_on(_diff), O.sql(_SNAPSHOT_SQL + " SELECT file, name, kind, scope, line, change FROM diff WHERE change IS NOT NULL")),
    "hunk_overlap": (_touched, O.sql(_SNAPSHOT_SQL + " SELECT id, file, name, kind, line FROM touched")),
    "change_merge": (
        _merge,
        O.sql(_SNAPSHOT_SQL + ", mixed AS (SELECT file, name, kind, line, change, 0 AS p, 'parser' AS via FROM diff WHERE change IS NOT NULL UNION ALL SELECT file, name, kind, line, 'modified', 1, 'hunk' FROM touched) SELECT file, name, kind, line, change, via FROM (SELECT *, row_number() OVER (PARTITION BY file, name, kind ORDER BY p, line, change) AS r FROM mixed) WHERE r = 1"),
    ),
    "change_blast": (_on(lambda ix: changes.affected(ix, _diff(ix), 2)), O.sql(_SNAPSHOT_SQL + O.blast(2, names=_CHANGED) + " SELECT * FROM affected")),
    "change_risk": (
        _on(lambda ix: changes.combined_risk(ix, _diff(ix), 2)),
        O.sql(_SNAPSHOT_SQL + O.blast(2, names=_CHANGED) + f" SELECT max(n) AS most, CAST(sum(n) AS BIGINT) AS total, {O.RISK.format('max(n)')} AS risk FROM (SELECT count(*) AS n FROM affected GROUP BY source)"),
    ),
    "change_flows": (_on(lambda ix: changes.affected_flows(ix, _diff(ix), graph.entry_points(ix, 0.9), 5, 4, 0.5)), O.sql(_SNAPSHOT_SQL + O.flows(O.entry_names(0.9), 5, 4, 0.5) + f" SELECT entry, count(*) AS matches FROM (SELECT entry, name FROM flow UNION ALL SELECT DISTINCT entry, entry FROM flow) WHERE name IN ({_CHANGED}) GROUP BY entry")),
    "resolve_targets": (
        _resolve,
        O.sql(", loc AS (SELECT file, name, arg_max(id, line * 1000000000 + id) AS id FROM symbols GROUP BY file, name), uni AS (SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) = 1) SELECT DISTINCT r.name, r.file, r.line, coalesce(l.id, u.id) AS target_id FROM refs r LEFT JOIN loc l ON l.file = r.file AND l.name = r.name LEFT JOIN uni u ON u.name = r.name"),
    ),
    "confidence_score": (
        _confidence,
        O.sql("""SELECT DISTINCT r.name, r.file, r.line, r.caller_id, (CASE WHEN r.line % 5 = 0 THEN 0.95 WHEN EXISTS (SELECT 1 FROM imports i WHERE i.source_file = r.file AND (i.import_path = r.name OR ends_with(i.import_path, '/' || r.name))) THEN 0.95
WHEN EXISTS (SELECT 1 FROM symbols s WHERE s.file = r.file AND s.name = r.name) THEN 0.85 WHEN EXISTS (SELECT 1 FROM symbols c JOIN symbols s ON s.scope = c.scope WHERE c.id = r.caller_id AND s.name = r.name AND s.file = r.file) THEN 0.8 ELSE 0.5 END)::DOUBLE AS confidence FROM refs r"""),
    ),
    "unembedded_symbols": (_on(lambda ix: ix.symbols.join(ix.embeddings.select(F.col("symbol_id").alias("id")), "id", "left_anti").select("id", "name", "file")), O.sql("SELECT id, name, file FROM symbols WHERE id NOT IN (SELECT symbol_id FROM vectors)")),
    "embedding_stats": (_on(lambda ix: ix.embeddings.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("stale").cast("long")), F.lit(0)).alias("stale"))), O.sql("SELECT count(*) AS total, CAST(sum(CASE WHEN stale THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM vectors")),
    "index_status": (_on(resolve.status), O.sql("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM refs WHERE caller_id IS NOT NULL) AS refs_with_caller, (SELECT count(*) FROM type_edges) AS type_edges, (SELECT count(*) FROM vectors) AS embeddings")),
    "languages_seen": (_on(lambda ix: ix.files.agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))), O.sql("SELECT string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM files")),
    "token_budget": (_budget(1), _budget_sql(1)),
    "token_budget_page2": (_budget(2), _budget_sql(2)),
    "service_page": (_service_page(1), _service_page_sql(1)),
    "service_page2": (_service_page(2), _service_page_sql(2)),
    "stream_debounce_batch": (
        _debounced,
        f"WITH e AS ({_EVENTS}), b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)), c AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY path, burst ORDER BY ts DESC, event_id DESC) AS r FROM c) SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS \"first\", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"last\", count(*) AS events, max(op) FILTER (r = 1) AS op FROM d GROUP BY path, burst",
    ),
    "stream_upsert_state": (_stream_state, f"WITH e AS ({_EVENTS}), d AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM e) SELECT path, op, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, hash FROM d WHERE r = 1 AND op <> 'deleted'"),
    "reconcile": (
        _reconcile,
        f"WITH e AS ({_EVENTS}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_id % 3 <> 0) WHERE r = 1 AND op <> 'deleted'), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1 AND op <> 'deleted') SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'delete' WHEN o.path IS NULL THEN 'add' WHEN o.hash <> n.hash THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.path = n.path",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in QUERIES.items() if s}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: transitive callers of the most referenced name."""
    return QUERIES["callers_d3"][0](spark, sf_dir)
