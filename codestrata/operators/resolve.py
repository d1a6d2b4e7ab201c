"""Joins of paths with modules, mentions and imports, as equality joins on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Endings tried for a relative import, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEXES = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def nearest_module(findings: DataFrame, modules: DataFrame, path: str = "path") -> DataFrame:
    """Each finding with its deepest known ancestor module, else its first directory, else ``general``."""
    f = findings.withColumn("__id", F.monotonically_increasing_id())
    up = f.select("__id", F.explode(ancestors(F.col(path))).alias("module")).join(modules.select("module").distinct(), "module")
    best = up.groupBy("__id").agg(F.max_by("module", F.char_length("module")).alias("__m"))
    first = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("general")
    return f.join(best, "__id", "left").withColumn("module", F.coalesce("__m", first)).drop("__id", "__m")


def submodules(modules: DataFrame) -> DataFrame:
    """(module, inner) for each module and the modules at or below it."""
    up = modules.select(F.col("module").alias("inner"), F.explode(F.concat(ancestors(F.col("module")), F.array("module"))).alias("module"))
    return up.join(modules.select("module"), "module", "left_semi").select("module", "inner")


def match_mentions(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Files for mentions (ord, mention): the exact path, else the longest path that ends in it."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    keyed = files.select("path", F.explode(tails).alias("mention"))
    w = W.partitionBy("ord").orderBy((F.col("path") == F.col("mention")).desc(), F.char_length("path").desc(), "path")
    hit = mentions.join(keyed, "mention").withColumn("__k", F.row_number().over(w)).where("__k = 1")
    return hit.groupBy("path").agg(F.min_by("mention", "ord").alias("mention"), F.min("ord").alias("ord"))


def _normalised(path: Column) -> Column:
    """``.`` and ``..`` removed from a path."""
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports (source_file, specifier) joined to the first candidate path that exists."""
    i = imports.where(F.col("specifier").startswith("."))
    folder = F.regexp_replace("source_file", "[^/]*$", "")
    base = _normalised(F.concat(folder, F.col("specifier")))
    swapped = [F.when(base.endswith(".js"), F.concat(F.regexp_replace(base, r"\.js$", ""), F.lit(e))) for e in (".ts", ".tsx")]
    tried = F.array(*(F.concat(base, F.lit(e)) for e in ENDINGS), *swapped, *(F.concat(base, F.lit(e)) for e in INDEXES))
    c = i.select("source_file", "specifier", F.posexplode(tried).alias("pos", "path")).join(files.select("path"), "path")
    return i.distinct().join(c.groupBy("source_file", "specifier").agg(F.min_by("path", "pos").alias("target_file")), ["source_file", "specifier"], "left")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Absolute Python imports by dotted name: module file, then package."""
    p = F.replace("specifier", F.lit("."), F.lit("/"))
    c = imports.select("source_file", "specifier", F.posexplode(F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))).alias("pos", "path")).join(files.select("path"), "path")
    return imports.distinct().join(c.groupBy("source_file", "specifier").agg(F.min_by("path", "pos").alias("target_file")), ["source_file", "specifier"], "left")


def resolve_namespaces(usings: DataFrame, declared: DataFrame, most: int = 20) -> DataFrame:
    """Namespaces to the files that declare them, else to up to 20 files of namespaces below."""
    exact = usings.join(declared, "namespace").where("source_file <> path").select("source_file", "namespace", F.col("path").alias("target_file"))
    rest = usings.join(declared.select("namespace"), "namespace", "left_anti")
    dots = F.split("namespace", r"\.")
    up = declared.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(dots)), lambda n: F.array_join(F.slice(dots, 1, n), "."))).alias("namespace"))
    w = W.partitionBy("source_file", "namespace").orderBy("path")
    near = rest.join(up.distinct(), "namespace").where("source_file <> path").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return exact.unionByName(near.select("source_file", "namespace", F.col("path").alias("target_file")))
