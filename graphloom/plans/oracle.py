"""The index's projection in plain SQL, and helpers for the queries' SQL forms."""

from __future__ import annotations

BASE = """
symbols AS (
  SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || substr(p_brand, 7) AS name,
    CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN 'function' WHEN p_type = 'ECONOMY' THEN 'method' WHEN p_type = 'MEDIUM' THEN 'class' WHEN p_type = 'SMALL' THEN 'struct' ELSE 'interface' END AS kind,
    'src/m' || CAST(p_size % 10 AS STRING) || '/f' || CAST(p_partkey % 97 AS STRING) || CASE WHEN p_partkey % 11 = 0 THEN '_test' ELSE '' END || '.rs' AS file,
    CAST(p_partkey % 400 + 1 AS BIGINT) AS line, CAST(p_partkey % 400 + 1 + p_size AS BIGINT) AS end_line,
    CASE WHEN p_type = 'ECONOMY' THEN p_brand END AS scope, p_name || ' ' || p_type AS signature,
    CASE p_partkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'go' END AS language
  FROM part
), calls AS (
  SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS before FROM lineitem
), refs AS (
  SELECT t.name, coalesce(c.file, 'src/main.rs') AS file, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_quantity <= 4 THEN 'call ' ELSE 'type ' END || t.name AS context, CASE WHEN l_quantity <= 4 THEN before END AS caller_id, l_quantity <= 4 AS called,
    CASE WHEN l_discount < 0.025 THEN 0.95 WHEN l_discount < 0.055 THEN 0.85 WHEN l_discount < 0.075 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, l_partkey AS target_id
  FROM calls JOIN symbols t ON t.id = l_partkey LEFT JOIN symbols c ON c.id = before
), imports AS (
  SELECT DISTINCT r.file AS source_file, './' || regexp_extract(t.file, '([^/]*)\\.rs$', 1) AS import_path FROM refs r JOIN symbols t ON t.id = r.target_id WHERE r.called
), type_edges AS (
  SELECT id AS child_id, id // 3 AS parent_id, CASE WHEN id % 2 = 0 THEN 'extends' ELSE 'implements' END AS relationship FROM symbols WHERE kind IN ('class', 'struct', 'interface')
), files AS (
  SELECT file AS path, min(language) AS language, md5(file) AS hash, max(end_line) AS line_count, count(*) AS symbols_count FROM symbols GROUP BY file
), seed AS (
  SELECT name FROM refs GROUP BY name ORDER BY count(*) DESC, name LIMIT 1
), code AS (
  SELECT file, line, 'fn ' || name AS content FROM symbols UNION SELECT file, line + 500, '    ' || name || '();' FROM refs
  UNION SELECT file, line + 900, 'use crate::' || name || ';' FROM refs WHERE caller_id IS NULL
  UNION SELECT file, line + 1300, '// see ' || name FROM symbols
), texts AS (
  SELECT file, CAST(n AS BIGINT) AS line, regexp_replace(parts[n], '[\\r\\n]+$', '') AS content FROM (
    SELECT file, parts, unnest(range(1, len(parts) + 1 - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS n FROM (
      SELECT source || '/' || CAST(doc_id AS STRING) AS file, string_split(text, chr(10)) AS parts FROM documents))
), vectors AS (
  SELECT vec_id AS symbol_id, s.file, CAST(embedding AS DOUBLE[]) AS vector, vec_id % 10 = 9 AS stale, label FROM embeddings LEFT JOIN symbols s ON s.id = vec_id
)
"""

TEST = r"""regexp_matches({0}, '(^|/)(test|tests|__tests__|docs|doc|examples|example|fixtures|benchmarks|bench)(/|$)|_test(\.[^./]*)?$|\.(test|spec)\.[^/]*$')"""
LOOSE = "(" + " OR ".join([f"contains(lower({{0}}), '{s}')" for s in ("/test", "/bench", "/spec/", "/specs/", "_test.", ".test.", "_spec.", ".spec.", "/mock", "/examples/")] + [f"starts_with(lower({{0}}), '{s}')" for s in ("test", "bench", "examples/")]) + ")"


def sql(body: str) -> str:
    """A query over the projection; ``body`` is more CTEs (each starting with a comma) and a SELECT."""
    return f"WITH RECURSIVE {BASE} {body}"


def upstream(depth: int, conf: float = 0.0, first: str = "true") -> str:
    """CTEs: ``levels`` (name, depth) of names by callers; 0 is the seed, ``first`` filters the first step."""
    return f""", walk(name, depth) AS (
  SELECT name, 0 FROM seed UNION
  SELECT c.name, w.depth + 1 FROM walk w JOIN refs r ON r.name = w.name AND r.confidence >= {conf} JOIN symbols c ON c.id = r.caller_id WHERE w.depth < {depth} AND (w.depth > 0 OR ({first}))
), levels AS (SELECT name, min(depth) AS depth FROM walk GROUP BY name)"""


def downstream(depth: int, conf: float = 0.0) -> str:
    return f""", walk(name, depth) AS (
  SELECT name, 0 FROM seed UNION
  SELECT r.name, w.depth + 1 FROM walk w JOIN symbols c ON c.name = w.name JOIN refs r ON r.caller_id = c.id AND r.confidence >= {conf} WHERE w.depth < {depth}
), levels AS (SELECT name, min(depth) AS depth FROM walk GROUP BY name)"""


def callers(depth: int, conf: float = 0.0, first: str = "true") -> str:
    """Rows of the callers query; ``first`` filters the first level."""
    return sql(
        upstream(depth, conf, first)
        + f""", found AS (
  SELECT c.name, c.kind, c.file, c.line, c.signature, l.depth + 1 AS depth, r.file AS target_file, r.confidence
  FROM levels l JOIN refs r ON r.name = l.name AND r.confidence >= {conf} JOIN symbols c ON c.id = r.caller_id WHERE l.depth < {depth} AND (l.depth > 0 OR ({first}))
  UNION ALL
  SELECT '<module>', 'module', r.file, r.line, '<module> ' || r.file, 1, r.file, r.confidence FROM seed s JOIN refs r ON r.name = s.name AND r.confidence >= {conf} WHERE r.caller_id IS NULL AND ({first.replace("c.", "r.")})
), picked AS (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY depth, confidence DESC, line, kind, signature, target_file) AS r FROM found)
SELECT name AS caller_name, kind AS caller_kind, file, line, signature, CAST(depth AS BIGINT) AS depth, target_file, confidence FROM picked WHERE r = 1"""
    )


def callees(depth: int, conf: float = 0.0) -> str:
    return sql(
        downstream(depth, conf)
        + f""", found AS (
  SELECT r.name, r.file, r.line, r.context, l.depth + 1 AS depth, c.file AS source_file, r.confidence
  FROM levels l JOIN symbols c ON c.name = l.name JOIN refs r ON r.caller_id = c.id AND r.confidence >= {conf} WHERE l.depth < {depth}
), picked AS (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY depth, confidence DESC, line, context, source_file) AS r FROM found)
SELECT name AS callee_name, file, line, context, CAST(depth AS BIGINT) AS depth, source_file, confidence FROM picked WHERE r = 1"""
    )


def blast(depth: int, down: bool = False, names: str = "SELECT name FROM seed") -> str:
    """CTE ``affected`` (source, name, kind, file, line, depth, confidence), tests left out and not crossed."""
    keep = "NOT " + TEST.format("file")
    if down:
        edge = "SELECT c.name AS at, r.name, coalesce(d.kind, 'function') AS kind, r.file, r.line, r.confidence, 0 AS via FROM refs r JOIN symbols c ON c.id = r.caller_id LEFT JOIN (SELECT DISTINCT ON (name) name, kind FROM symbols ORDER BY name, file, line, id) d ON d.name = r.name"
    else:
        edge = "SELECT r.name AS at, c.name, c.kind, c.file, c.line, r.confidence, 0 AS via FROM refs r JOIN symbols c ON c.id = r.caller_id"
    child = "" if down else " UNION ALL SELECT n.name AS source, k.name, k.kind, k.file, k.line, 1 AS depth, 1.0 AS confidence, 1 AS via FROM starts n JOIN symbols p ON p.name = n.name JOIN type_edges e ON e.parent_id = p.id JOIN symbols k ON k.id = e.child_id"
    kids = "" if down else f" UNION SELECT n.name, k.name, 1 FROM starts n JOIN symbols p ON p.name = n.name JOIN type_edges e ON e.parent_id = p.id JOIN symbols k ON k.id = e.child_id WHERE {keep.replace('(file', '(k.file')}"
    return f""", starts AS ({names}), edge AS ({edge}), walk(source, name, depth) AS (
  (SELECT name, name, 0 FROM starts{kids}) UNION
  SELECT w.source, e.name, w.depth + 1 FROM walk w JOIN edge e ON e.at = w.name WHERE w.depth < {depth} AND {keep.replace("(file", "(e.file")}
), levels AS (SELECT source, name, min(depth) AS depth FROM walk GROUP BY ALL), found AS (
  SELECT l.source, e.name, e.kind, e.file, e.line, l.depth + 1 AS depth, e.confidence, e.via FROM levels l JOIN edge e ON e.at = l.name WHERE l.depth < {depth}{child}
), picked AS (SELECT *, row_number() OVER (PARTITION BY source, name, file ORDER BY depth, via, confidence DESC, line, kind) AS r FROM found),
affected AS (SELECT source, name, kind, file, line, CAST(depth AS BIGINT) AS depth, confidence::DOUBLE AS confidence, CASE depth WHEN 1 THEN 'will_break' WHEN 2 THEN 'likely_affected' ELSE 'may_need_testing' END AS severity FROM picked WHERE r = 1 AND {keep})"""


DEP_EDGES = """, dep_edges AS (
  SELECT DISTINCT i.source_file AS src, f.path AS dst FROM imports i JOIN files f ON regexp_replace(regexp_extract(f.path, '([^/]*)$', 1), '\\.[^.]*$', '') = regexp_extract(i.import_path, '([^/:]*)$', 1) WHERE i.source_file <> f.path
), hub AS (SELECT dst AS file FROM dep_edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1
), importer AS (SELECT source_file AS file FROM imports WHERE source_file <> 'src/main.rs' GROUP BY source_file ORDER BY count(*) DESC, source_file LIMIT 1)"""


def reach(as_: str, start: str, reverse: bool = False) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f", {as_}(file) AS ({start} UNION SELECT e.{b} FROM {as_} w JOIN dep_edges e ON e.{a} = w.file)"


RISK = "CASE WHEN {0} <= 3 THEN 'low' WHEN {0} <= 10 THEN 'medium' WHEN {0} <= 25 THEN 'high' ELSE 'critical' END"


def flows(entries: str, depth: int, branching: int, conf: float, as_: str = "flow") -> str:
    """CTE ``flow`` (entry, step, name, kind, file, line, depth), level by level; ``entries`` selects names."""
    out = f""", {as_}_def AS MATERIALIZED (
  SELECT name, id AS def_id, kind, file AS def_file, line AS def_line, row_number() OVER (PARTITION BY name ORDER BY file, line, id) AS which FROM symbols WHERE kind IN ('function', 'method')
), {as_}_edge AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caller_id ORDER BY confidence DESC, name, which) AS nth FROM (
    SELECT caller_id, name, max(confidence) AS confidence FROM refs WHERE caller_id IS NOT NULL AND confidence >= {conf} GROUP BY ALL) LEFT JOIN {as_}_def USING (name)) WHERE nth <= {branching}
), {as_}0 AS MATERIALIZED (
  SELECT name AS entry, def_id AS id, name, kind, def_file AS file, def_line AS line, 0 AS depth, CAST(0 AS BIGINT) AS step FROM {as_}_def WHERE which = 1 AND name IN ({entries})
)"""
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT entry, name FROM {as_}{k}" for k in range(d))
        out += f""", {as_}{d} AS MATERIALIZED (
  SELECT entry, def_id AS id, name, coalesce(kind, 'function') AS kind, coalesce(def_file, '') AS file, coalesce(def_line, 0) AS line, {d} AS depth, base + row_number() OVER (PARTITION BY entry ORDER BY frm, nth) AS step FROM (
    SELECT *, row_number() OVER (PARTITION BY entry, name ORDER BY frm, nth) AS r FROM (SELECT l.entry, l.step AS frm, e.* FROM {as_}{d - 1} l JOIN {as_}_edge e ON e.caller_id = l.id) ANTI JOIN ({seen}) USING (entry, name)
  ) JOIN (SELECT entry, max(step) AS base FROM {as_}{d - 1} GROUP BY entry) USING (entry) WHERE r = 1
)"""
    every = " UNION ALL ".join(f"SELECT entry, step, name, kind, file, line, depth FROM {as_}{d}" for d in range(depth + 1))
    return out + f""", {as_} AS (SELECT * FROM ({every}) WHERE entry IN (SELECT entry FROM ({every}) GROUP BY entry HAVING count(*) > 1))"""


def entry_names(conf: float, limit: int | None = None) -> str:
    """Names of the entry points, by place."""
    return f"SELECT name FROM (SELECT * FROM symbols s WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name = s.name AND r.caller_id IS NOT NULL AND r.confidence >= {conf}) ORDER BY file, line, id{f' LIMIT {limit}' if limit else ''})"
