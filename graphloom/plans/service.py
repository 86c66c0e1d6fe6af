"""One door to the catalogue's queries: names and keyword arguments in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..index import Index, discovered, read_meta
from ..operators import budget, changes, context, graph, lookup, ranking, summary, vectors
from ..sources import build, files, git, parse, resolve

class Service:
    """Answers named queries over an index.

    ``text`` are its lines (file, line, content) and ``contents`` its files (path, content), ``embed`` turns a query into
    a vector, ``repo`` is the repository on disk, ``home`` a folder of saved indexes. ``include_tests`` (default no)
    drops test files from results after traversal, and during it for blast."""

    def __init__(self, ix: Index | None, text: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, contents: DataFrame | None = None, repo: str | None = None, home: str | None = None):
        self.ix, self.embed, self.contents, self.repo, self.home = ix, embed, contents, repo, home
        self.text = text if text is not None or contents is None else X.lines(contents)
        self.tools: dict[str, Callable[..., DataFrame]] = {
            "search": self.search, "sym": self.sym, "ref": self.ref, "sig": lambda name: lookup.signatures(self.ix, name), "deps": lambda file: lookup.deps(self.ix, file), "rdeps": lambda file: lookup.rdeps(self.ix, file),
            "show": self.show, "callers": self.callers, "callees": self.callees, "callpath": self.callpath, "summary": self.summary, "flows": self.flows,
            "blast": lambda symbol, direction="upstream", depth=3, include_tests=False, min_confidence=None: graph.blast(self.ix, [symbol], direction, depth, include_tests, min_confidence),
            "context": lambda name, file=None, kind=None, min_confidence=None: context.symbol_context(self.ix, name, file, kind, min_confidence), "ask": self.ask,
            "cluster": lambda path=".", top=5: vectors.representatives(vectors.cluster(vectors.scoped(self.ix, "" if path == "." else path)), self.ix, top),
            "impact": self.impact, "changes": self.changes, "status": lambda: resolve.status(self.ix), "init": self.init, "update": self.update, "repos": self.repos,
            "root": lambda: summary.root_dirs(self.ix), "languages": lambda path=".": summary.languages(self.ix, path), "outline": lambda file: summary.outline(self.ix, file),
        }

    # --- calls and pages

    def _order(self, tool: str, rows: DataFrame) -> list:
        """The order of a tool's rows, in which budgets and pages are spent."""
        if tool == "search":
            return [F.desc("score"), "file", "line"] if "score" in rows.columns else ["tier", "file", "line", "content"] if "tier" in rows.columns else ["file", "line", "content"]
        if tool == "show":
            return [*(["asked"] if "asked" in rows.columns else []), *([F.desc("exact")] if "exact" in rows.columns else []), X.is_test_shown("file"), "file", "line", "id"]
        if tool == "flows":
            return ["entry", "step"] if "step" in rows.columns else ["file", "line", "id"]
        if tool == "changes" and "entry" in rows.columns:
            return ["entry"]
        orders = {
            "sym": [X.is_test_lookup("file"), *lookup.PLACE], "ref": [F.col("kind") != "subclass", "file", "line", "name", "context", "caller_name", "confidence"], "sig": ["file", "line", "id"],
            "callers": ["depth", "file", "line", "caller_name"], "callees": ["depth", "file", "line", "callee_name"], "callpath": ["hop"], "summary": ["level", "path"], "blast": ["depth", "file", "line", "name"],
            "context": ["file", "line", "id"], "ask": [F.desc("score"), "symbol_id"], "cluster": ["cluster", "nth"], "impact": [F.desc("score"), "name", "file", "line"], "changes": ["file", "line", "name", "kind"], "outline": ["line", "id"], "repos": ["repo"],
        }
        if tool == "ref" and len(rows.columns) == 1:
            return ["file"]
        return orders.get(tool) or list(rows.columns)

    def _rows(self, tool: str, args: dict) -> DataFrame:
        if tool not in self.tools:
            raise KeyError(f"unknown tool: {tool}")
        return self.tools[tool](**args)

    def call(self, tool: str, limit: int | None = None, page: int = 1, **args) -> DataFrame:
        """A tool's rows; with ``limit``, those that a token budget, spent in the tool's order, leaves of them."""
        rows = self._rows(tool, args)
        if limit is None:
            return rows
        return budget.within(rows, limit, self._order(tool, rows), page).filter("taken").orderBy("position").select(*rows.columns, "tokens")

    def answer(self, tool: str, limit: int | None = None, page: int = 1, piped: bool = False, **args) -> DataFrame:
        """One row: the page's results as JSON, and whether more follow. Without ``limit`` a page has 4,000 tokens, 2,000 where output is piped."""
        rows = self._rows(tool, args)
        limit = limit or (budget.PIPE_PAGE if piped else budget.TOOL_PAGE)
        return budget.answer(rows, self._order(tool, rows), limit, page, skipped_count=tool == "search")

    # --- the index's life

    def init(self, root: str | None = None) -> DataFrame:
        """Index a repository anew, with its vectors where there is an embedding function, and save it where there is a home."""
        self.repo = root or self.repo
        spark = SparkSession.active()
        self.contents = files.walk(spark, self.repo)
        self.text, self.ix = X.lines(self.contents), build.index(self.contents)
        self.ix = self.ix.with_(embeddings=spark.createDataFrame([], "symbol_id long, file string, vector array<float>, stale boolean"))
        return self._kept(self.ix.files.select("path"))

    def update(self, force: bool = False, skip_embed: bool = False) -> DataFrame:
        """Bring the index in line with the repository on disk: unchanged files are skipped unless ``force``."""
        if force:
            return self.init()
        self.contents = files.walk(SparkSession.active(), self.repo)
        hashed = self.contents.select("path", F.md5("content").alias("hash"))
        changed = hashed.join(self.ix.files.select("path", "hash"), ["path", "hash"], "left_anti").select("path")
        self.text, self.ix = X.lines(self.contents), build.reconcile(self.ix, self.contents)
        return self._kept(changed, skip_embed)

    def _kept(self, changed: DataFrame, skip_embed: bool = False) -> DataFrame:
        spark, embed = SparkSession.active(), self.embed
        if embed and not skip_embed:
            self.ix = self.ix.with_(embeddings=build.reembedded(self.ix, self.contents, changed, lambda texts: [embed(t) for t in texts]))
        if self.home:
            path = f"{self.home}/{self.repo.rstrip('/').rpartition('/')[2]}"
            seen = [r[0] for r in self.ix.files.select("language").distinct().orderBy("language").collect()]
            self.ix.save(path, {"repository": self.repo, "languages": seen})
            self.ix = Index.load(spark, path)
        return resolve.status(self.ix)

    def repos(self) -> DataFrame:
        """The saved indexes: (repo, files, symbols, repository, languages)."""
        spark = SparkSession.active()
        found = discovered(spark, self.home) if self.home else {}
        facts = [(name, (meta := read_meta(spark, path)).get("repository"), ",".join(meta.get("languages", []))) for name, path in found.items()]
        facts = spark.createDataFrame(facts, "repo string, repository string, languages string")
        counts = resolve.catalogue({name: Index.load(spark, path) for name, path in found.items()})
        return facts.withColumns({"files": F.lit(0), "symbols": F.lit(0)}) if counts is None else counts.join(facts, "repo").orderBy("repo")

    def use(self, repo: str) -> Service:
        """The service over another of the saved indexes."""
        spark, found = SparkSession.active(), discovered(SparkSession.active(), self.home)
        if repo not in found:
            raise KeyError(f"unknown repository: {repo}")
        return Service(Index.load(spark, found[repo]), embed=self.embed, repo=read_meta(spark, found[repo]).get("repository"), home=self.home)

    # --- queries

    def _tests(self, rows: DataFrame, include: bool) -> DataFrame:
        return rows if include else rows.filter(~X.is_test("file"))

    def search(self, pattern: str, regex: bool | None = None, ignore_case: bool = False, mode: str | None = None, paths: list[str] | None = None, include_tests: bool = False, raw: bool = False, file: str | None = None) -> DataFrame:
        """Text search: plain where ``raw``, ranked where the index knows the phrase, fused with the nearest symbols where ``mode`` is semantic."""
        regex = X.looks_like_regex(pattern) if regex is None else regex
        under = [*(paths or []), *([file] if file else [])]
        text = self.text.filter(lookup._under(under)) if under else self.text
        hits = self._tests(X.grep(text, pattern, regex, ignore_case), include_tests)
        mode = "plain" if raw else mode or lookup.search_mode(self.ix, pattern)
        if mode == "semantic":
            found = vectors.resolved(vectors.top_k(self.ix.embeddings, self.embed(pattern), 20), self.ix)
            return ranking.fuse(ranking.ranked_rows(hits, "file", "line", "content"), ranking.ranked_rows(found, F.desc("score"), "symbol_id"))
        return ranking.rank(ranking.fold_reexports(ranking.classify(hits, self.ix))) if mode == "smart" else hits.orderBy("file", "line")

    def sym(self, name: str, kind: str | None = None, file: str | None = None, exact: bool = False, limit_rows: int | None = None) -> DataFrame:
        q = X.split_qualified(name)
        return lookup.symbols(self.ix, q.name, kind, file or q.file_hint, q.scope_hint, exact, limit_rows)

    def ref(self, name: str, output: str = "full", paths: list[str] | None = None, file: str | None = None) -> DataFrame:
        paths = [*(paths or []), *([file] if file else [])] or None
        return lookup.reference_files(self.ix, name, paths) if output == "files" else lookup.references_and_subclasses(self.ix, name, paths)

    def show(self, name: str | None = None, file: str | None = None, kind: str | None = None, exact: bool = False, shallow: bool = False, paths: list[str] | None = None, most: int = 80) -> DataFrame:
        """Symbols with ``body``, of each name of a comma list, or of each of ``paths``; duplicates stay. Without contents, bodies are signatures."""
        out = None
        names = [n.strip() for n in name.split(",")] if name else [None]
        for k, (one, where) in enumerate((n, p) for n in names for p in (paths or [file])):
            if one is None:
                rows = lookup.show_file(self.ix, where).withColumn("exact", F.lit(False)).withColumn("scope", F.lit(None).cast("string"))
            else:
                q = X.split_qualified(one)
                rows = lookup.show_symbol(self.ix, q.name, exact, kind, where or q.file_hint, q.scope_hint).withColumn("exact", F.col("name") == q.name)
            rows = rows.select(F.lit(k).alias("asked"), "exact", "id", "name", "kind", "file", "line", "end_line", "scope", "signature")
            out = rows if out is None else out.unionByName(rows)
        if self.contents is None:
            return out.withColumn("body", F.col("signature"))
        return lookup.bodies(out, self.ix, self.contents, "shallow" if shallow else "full", most)

    def callers(self, name: str, depth: int = 1, min_confidence: float | None = None, reference_file: str | None = None, callers_file: str | None = None, include_tests: bool = False) -> DataFrame:
        q = X.split_qualified(name)
        return self._tests(graph.callers(self.ix, q.name, depth, min_confidence, reference_file or q.file_hint, callers_file), include_tests)

    def callees(self, name: str, depth: int = 1, min_confidence: float | None = None, reference_file: str | None = None, callees_file: str | None = None, include_tests: bool = False) -> DataFrame:
        q = X.split_qualified(name)
        return self._tests(graph.callees(self.ix, q.name, depth, min_confidence, reference_file or q.file_hint, callees_file), include_tests)

    def callpath(self, start: str, end: str, **more) -> DataFrame:
        return graph.call_path(self.ix, start, end, **more)

    def summary(self, path: str = ".", detail: str = "rich", depth: int = 0, recursive: bool = False) -> DataFrame:
        """A path's metrics and those of what lies ``depth`` levels below, or all of it where ``recursive``."""
        return summary.detailed(self.ix, summary.tree(self.ix, path, None if recursive else depth), detail)

    def flows(self, entry: str | None = None, file: str | None = None, depth: int = 10, branching: int = 4, min_confidence: float | None = None) -> DataFrame:
        """Entry points, or the flow of one; a file's only entry point is traced at once."""
        entries = graph.entry_points(self.ix, min_confidence, file)
        if entry is None and (file is None or entries.limit(2).count() != 1):
            return entries
        chosen = entries if entry is None else self.ix.symbols.sparkSession.createDataFrame([(entry,)], "name string")
        return graph.flows(self.ix, chosen, depth, branching, min_confidence)

    def _parsed(self, paths: DataFrame) -> DataFrame:
        """Symbols that changed files have on disk now."""
        now = files.walk(SparkSession.active(), self.repo).join(paths, "path", "left_semi")
        return build.symbols_of(parse.parsed(now))

    def changes(self, scope: str = "unstaged", base: str | None = None, blast: bool = False, flows: bool = False, min_confidence: float | None = None) -> DataFrame:
        """Symbols that a diff of the repository changed, by parsing and by hunks; or, with ``blast`` or ``flows``, what they affect."""
        spark = SparkSession.active()
        paths = git.changed_files(spark, self.repo, scope, base)
        old = self.ix.symbols.join(paths.withColumnRenamed("path", "file"), "file", "left_semi")
        parsed = changes.snapshot_diff(old, self._parsed(paths))
        touched = changes.overlapping(old, git.hunks(spark, self.repo, scope, base)).withColumn("change", F.lit("modified"))
        found = changes.merged(parsed, touched)
        if blast:
            return changes.affected(self.ix, found, 3, min_confidence)
        if flows:
            return changes.affected_flows(self.ix, found, graph.entry_points(self.ix, min_confidence), min_confidence=min_confidence)
        return found

    def impact(self, file: str | None = None, since: str | None = None) -> DataFrame:
        """Symbols near those that a file, or all files changed since a revision, have added or modified."""
        spark = SparkSession.active()
        paths = git.changed_since(spark, self.repo, since) if since else spark.createDataFrame([(git.checked_path(file),)], "path string")
        old, new = self.ix.symbols.join(paths.withColumnRenamed("path", "file"), "file", "left_semi"), self._parsed(paths)
        found = changes.snapshot_diff(old, new).filter("change <> 'removed'")
        same = [new[c].eqNullSafe(found[c]) for c in changes.KEY]
        changed = new.join(found, same, "left_semi")
        embed = self.embed
        vectors_ = build.embedded(build.chunks(changed, self.ix.imports, files.walk(spark, self.repo)), lambda texts: [embed(t) for t in texts], partial=True)
        unit = vectors_.select(F.col("symbol_id").alias("id"), vectors.normalized("vector").alias("vector"))
        return vectors.impact(changed.join(unit, "id").select("name", "kind", "file", "scope", "vector"), self.ix)

    def ask(self, query: str, start: str | None = None, end: str | None = None, k: int = 50) -> DataFrame:
        near = None
        if start and end:
            near = graph.reach_between(self.ix, start, end)
        elif start or end:
            near = graph.reach(self.ix, start or end, reverse=not start)
        return vectors.ask(self.ix, self.embed(query), k, near)
