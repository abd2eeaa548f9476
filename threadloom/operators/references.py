"""References to files and packages that don't exist: anti-joins against what the working tree holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Extensions that make a word a file name.
EXTENSIONS = ("js", "ts", "jsx", "tsx", "mjs", "cjs", "py", "rs", "go", "rb", "java", "json", "md", "yml", "yaml", "toml", "sql", "sh", "css", "html", "txt", "env", "lock", "cfg", "ini")

# Import lines, local names, packages that come with the languages, and libraries known by name.
JS_IMPORT = r"""(?<![A-Za-z0-9_])(?:import|export)(?![A-Za-z0-9_])[^;\n]*?(?<![A-Za-z0-9_])from\s*['"]([^'"\n]+)['"]|(?<![A-Za-z0-9_])require\(\s*['"]([^'"\n]+)['"]\s*\)|(?<![A-Za-z0-9_])import\(\s*['"]([^'"\n]+)['"]\s*\)"""
PY_IMPORT = r"(?m)^[ \t]*(?:from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+import(?![A-Za-z0-9_])|import\s+([A-Za-z_][A-Za-z0-9_.]*(?:\s*,\s*[A-Za-z_][A-Za-z0-9_.]*)*))"
LOCAL = r"^(?:\.{1,2}/|/|node:)"
NODE_BUILT_IN = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants",
    "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http",
    "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process",
    "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys",
    "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
PYTHON_BUILT_IN = (
    "os", "sys", "re", "json", "math", "random", "datetime", "time", "collections", "itertools",
    "functools", "typing", "pathlib", "subprocess", "logging", "argparse", "unittest", "asyncio",
    "io", "abc", "enum", "dataclasses", "copy", "hashlib", "base64", "csv", "sqlite3", "socket",
    "threading", "multiprocessing", "shutil", "glob", "tempfile", "traceback", "inspect", "string",
    "textwrap", "decimal", "fractions", "statistics", "struct", "pickle", "http", "urllib", "xml",
    "html", "email", "warnings", "contextlib", "operator", "weakref", "gc", "platform", "signal",
)
LIBRARIES = (
    "cytoscape", "d3", "three", "whisper", "numpy", "pandas", "scipy", "sklearn",
    "tensorflow", "torch", "pytorch", "keras", "matplotlib", "seaborn", "react",
    "vue", "svelte", "angular", "jquery", "lodash", "underscore", "moment", "axios",
    "express", "flask", "django", "fastapi", "requests", "pillow", "opencv", "cv2",
    "transformers", "langchain", "openai", "anthropic", "redux", "webpack", "rollup",
    "vite", "babel", "eslint", "prettier", "jest", "mocha", "chai", "pytest",
    "bootstrap", "tailwind", "chartjs", "plotly", "leaflet", "mapbox", "socketio",
)


def file_references(turns: DataFrame, text: str = "text") -> DataFrame:
    """tree, ref and first_ord: the distinct file names of each tree's texts, by first mention; turns has tree and ord."""
    pattern = r"(?<![A-Za-z0-9_./-])((?:\.{0,2}/)?[A-Za-z0-9_-][A-Za-z0-9_./-]*\.(?:" + "|".join(EXTENSIONS) + r"))(?![A-Za-z0-9_])"
    each = turns.select("tree", "ord", F.explode(F.regexp_extract_all(F.substring(text, 1, 20_000), F.lit(pattern), F.lit(1))).alias("ref"))
    return each.select("tree", "ord", F.regexp_replace(F.lower("ref"), r"^\./", "").alias("ref")).groupBy("tree", "ref").agg(F.min("ord").alias("first_ord"))


def missing_files(refs: DataFrame, existing: DataFrame, created: DataFrame) -> DataFrame:
    """References that name no existing path, no existing base name and nothing that the tree itself created.

    existing has path; created has tree and path. Base names are compared too, as a bare name may lie anywhere.
    """
    base = F.element_at(F.split("path", "/"), -1)
    paths = existing.select(F.lower("path").alias("ref")).union(existing.select(F.lower(base).alias("ref"))).distinct()
    own = created.select("tree", F.lower("path").alias("ref")).union(created.select("tree", F.lower(base).alias("ref"))).distinct()
    return refs.join(paths, "ref", "left_anti").join(own, ["tree", "ref"], "left_anti").select("tree", "ref", "first_ord")


def imports(turns: DataFrame, text: str = "text") -> DataFrame:
    """tree, package and first_ord: roots of packages that JavaScript and Python import lines name; local ones are left out."""
    js = F.regexp_extract_all(text, F.lit(r"""(?:from|require\(|import\(|import)\s*['"]([^'"\s]+)['"]"""), F.lit(1))
    py = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_][A-Za-z0-9_]*)(?![^\n]*['\"])"), F.lit(1))
    each = turns.select("tree", "ord", F.explode(F.concat(js, py)).alias("name")).filter(~F.col("name").rlike(r"^(?:\.|/|node:)"))
    root = F.when(F.col("name").startswith("@"), F.regexp_extract("name", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.element_at(F.split("name", "/"), 1))
    return each.select("tree", "ord", root.alias("package")).filter("package <> ''").groupBy("tree", "package").agg(F.min("ord").alias("first_ord"))


def undeclared(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Imported packages that no manifest declares; declared has package."""
    return found.join(declared.select("package").distinct(), "package", "left_anti").select("tree", "package", "first_ord")


def imports_by_language(turns: DataFrame, text: str = "text") -> DataFrame:
    """tree, lang (js or py), package and first_ord: what import lines of texts name, paths inside packages cut for js; local ones are left out.

    The first 20,000 letters of a text are looked at, which is the rule's own bound.
    """
    seen = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 20_000)
    js = F.filter(F.flatten(F.array(*(F.regexp_extract_all(seen, F.lit(JS_IMPORT), F.lit(g)) for g in (1, 2, 3)))), lambda n: n != "")
    several = F.flatten(F.transform(F.regexp_extract_all(seen, F.lit(PY_IMPORT), F.lit(2)), lambda n: F.split(n, r"\s*,\s*")))
    py = F.filter(F.transform(F.concat(F.regexp_extract_all(seen, F.lit(PY_IMPORT), F.lit(1)), several), F.trim), lambda n: n != "")
    named = lambda names, lang: F.transform(names, lambda n: F.struct(F.lit(lang).alias("lang"), n.alias("name")))
    each = turns.select("tree", "ord", F.explode(F.concat(named(js, "js"), named(py, "py"))).alias("i")).select("tree", "ord", "i.*").filter(~F.col("name").rlike(LOCAL))
    root = F.when(F.col("name").startswith("@"), F.substring_index("name", "/", 2)).otherwise(F.substring_index("name", "/", 1))
    return each.select("tree", "ord", "lang", root.alias("package")).filter("package <> ''").groupBy("tree", "lang", "package").agg(F.min("ord").alias("first_ord"))


def undeclared_imports(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports (of imports_by_language) that are neither built in nor declared; declared has kind and name, as project.declared gives.

    Names of js count only where any manifest declares something, names of py only where one for Python does.
    """
    python = F.col("kind") == "python"
    names = declared.select(F.when(python, "py").otherwise("js").alias("lang"), F.when(python, F.lower("name")).otherwise(F.col("name")).alias("_name")).distinct()
    judged = declared.select(F.explode(F.when(python, F.array(F.lit("js"), F.lit("py"))).otherwise(F.array(F.lit("js")))).alias("lang")).distinct()
    built_in = ((F.col("lang") == "js") & F.col("package").isin(*NODE_BUILT_IN)) | ((F.col("lang") == "py") & F.col("package").isin(*PYTHON_BUILT_IN))
    asked = found.filter(~built_in).withColumn("_name", F.when(F.col("lang") == "py", F.lower("package")).otherwise(F.col("package")))
    return asked.join(judged, "lang", "left_semi").join(names, ["lang", "_name"], "left_anti").select("tree", "lang", "package", "first_ord")


def without_libraries(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """File references (with ref) that don't stand for a library: a bare name.ext whose name a manifest declares, or, without manifests, a well-known one."""
    bare = ~F.contains("ref", F.lit("/")) & F.col("ref").rlike(r"^.+\.[^.]*$")
    stem = F.lower(F.regexp_extract("ref", r"^(.+)\.[^.]*$", 1))
    root = F.when(F.col("name").startswith("@"), F.substring_index("name", "/", 2)).otherwise(F.substring_index("name", "/", 1))
    known = F.array(*map(F.lit, LIBRARIES))
    otherwise = declared.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.explode(known).alias("_stem"))
    names = declared.select(F.lower(root).alias("_stem")).union(otherwise).distinct()
    # what isn't a bare name has a null here, which the anti-join keeps
    return refs.withColumn("_stem", F.when(bare, stem)).join(names, "_stem", "left_anti").drop("_stem")


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
