"""Detectors: metrics to finding rows (category, severity, primary file, title parts)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ordered layer patterns (level, name, path segment names).
LAYER_PATTERNS = (
    (0, "data", ("db", "data", "database", "dal", "repository", "repo")),
    (0, "data", ("schema", "migration", "drizzle")),
    (1, "domain", ("domain", "model", "models", "entities", "types")),
    (2, "service", ("service", "services", "logic", "core")),
    (2, "service", ("indexer", "engine", "pipeline")),
    (3, "api", ("api", "routes?", "controller", "handler")),
    (4, "presentation", ("ui", "views?", "components?", "pages?", "dashboard")),
    (4, "presentation", ("cli", "commands?")),
)
#: Severity ranks; unknown counts as 0.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def layer_level(path: Column) -> Column:
    """Level of the first matching layer pattern, or null."""
    out = F.lit(None).cast("int")
    for level, _, names in reversed(LAYER_PATTERNS):
        out = F.when(path.rlike(f"(?i)(^|/)({'|'.join(names)})/"), F.lit(level)).otherwise(out)
    return out


def circular_dependencies(components: DataFrame) -> DataFrame:
    """A finding for each strongly connected component (G1)."""
    g = components.groupBy("component").agg(F.count("*").alias("cycle_length"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members"))
    sev = F.when(F.col("cycle_length") > 5, "high").when(F.col("cycle_length") > 2, "medium").otherwise("low")
    return g.select("component", "cycle_length", "members", sev.alias("severity"))


def dead_code(symbols: DataFrame, referenced: DataFrame) -> DataFrame:
    """Exported symbols that nothing references, by file (D7, G2); ``referenced`` holds (file_id, name) or (file_id)."""
    keys = [c for c in ("file_id", "name") if c in referenced.columns]
    dead = symbols.where("exported").join(referenced.select(*keys).distinct(), keys, "left_anti")
    g = dead.groupBy("file_id").agg(F.count("*").alias("n_dead"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return g.select("file_id", "n_dead", "names", F.when(F.col("n_dead") > 5, "medium").otherwise("low").alias("severity"))


def god_modules(fans: DataFrame, fan_in: int = 8, fan_out: int = 8, combined: int = 20) -> DataFrame:
    """Files with many dependents and dependencies."""
    s = F.col("fan_in") + F.col("fan_out")
    sev = F.when(s > 40, "high").when(s > 30, "medium").otherwise("low")
    return fans.where((F.col("fan_in") >= fan_in) & (F.col("fan_out") >= fan_out) & (s >= combined)).select("node", "fan_in", "fan_out", sev.alias("severity"))


def layering_violations(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges against the layer order, one finding for each edge."""
    lv = files.select("id", "path", layer_level(F.col("path")).alias("lv")).where("lv is not null")
    a, b = lv.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.col("lv").alias("a")), lv.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"), F.col("lv").alias("b"))
    gap = F.col("a") - F.col("b")
    kind = F.when(gap < 0, "upward").when(gap > 1, "skip")
    sev = F.when(gap < -2, "high").when(gap < 0, "medium").otherwise("low")
    return edges.where("dst is not null").join(a, "src").join(b, "dst").withColumn("kind", kind).where("kind is not null").select("src_path", "dst_path", "kind", sev.alias("severity"))


def coupling_findings(metrics: DataFrame, efferent: int = 15, afferent: int = 20, total: int = 25, cohesion: float = 0.2) -> DataFrame:
    """Up to four findings of each file over the thresholds."""
    e, a, c = F.col("efferent"), F.col("afferent"), F.col("cohesion")
    def over(metric: str, value: Column, limit: int) -> Column:
        return F.when(value > limit, F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.when(value > 2 * limit, "high").otherwise("medium").alias("severity")))
    low = F.when((c < cohesion) & (c >= 0), F.struct(F.lit("cohesion").alias("metric"), c.cast("double").alias("value"), F.lit("low").alias("severity")))
    rows = F.filter(F.array(over("efferent", e, efferent), over("afferent", a, afferent), over("total", e + a, total), low), lambda x: x.isNotNull())
    return metrics.select("node", F.explode(rows).alias("f")).select("node", "f.metric", "f.value", "f.severity")


def _path_of(evidence: Column, at: str) -> Column:
    """The first path key of a JSON object that holds a text, else the first of its file paths."""
    def text(key: str) -> Column:
        v = F.try_variant_get(evidence, f"{at}.{key}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(evidence, f"{at}.{key}", "string"))
    return F.coalesce(*(F.nullif(text(k), F.lit("")) for k in ("filePath", "file", "path", "sourceFilePath")), text("filePaths[0]"))


def _json_objects(deep: int = 3) -> str:
    """A pattern of the strings of a JSON text and of its outermost objects, if they nest up to ``deep`` levels; it never backtracks."""
    text = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    found = text
    for _ in range(deep):
        found = rf'{text}|\{{[^{{}}"\\]*+(?:(?:{found})[^{{}}"\\]*+)*+\}}'
    return f"(?s){found}"


_OBJECTS = _json_objects()
#: What an object with a path holds in its text: one of the keys, or an escape that may spell one.
_NAMED = r'"(?:filePath|file|path|sourceFilePath|filePaths)"|\\'


def _objects_in(array: Column) -> Column:
    """The texts of the objects in a JSON array, in order, through nested arrays of any depth and length.

    A pattern finds those of few levels; a text with a brace that it does not reach is folded mark by mark.
    """
    found = F.filter(F.regexp_extract_all(array, F.lit(_OBJECTS), F.lit(0)), lambda o: o.startswith("{"))
    return F.when(F.regexp_replace(array, _OBJECTS, "").rlike("[{}]"), _folded_objects(array)).otherwise(found)


def _folded_objects(array: Column) -> Column:
    marks = F.regexp_extract_all(array, F.lit(r'(?s)[^"\\{}]*(?:\\.|["{}\\])'), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit("").alias("own"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, m: Column) -> Column:
        mark = F.right(m, F.lit(1))
        pair = (F.char_length(m) > 1) & (F.substring(m, -2, 1) == "\\")
        quote, brace = (mark == '"') & ~pair, mark.isin("{", "}") & ~pair & ~s["quoted"]
        depth = s["depth"] + F.when(brace, F.when(mark == "{", 1).otherwise(-1)).otherwise(0)
        opens, closes = brace & (s["depth"] == 0), brace & (depth == 0)
        own = F.when(opens, F.lit("{")).when(s["depth"] > 0, F.concat(s["own"], m)).otherwise("")
        return F.struct(depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), own.alias("own"), F.when(closes, F.concat(s["found"], F.array(own))).otherwise(s["found"]).alias("found"))

    return F.aggregate(marks, zero, step)["found"]


def primary_file(evidence: Column) -> Column:
    """The path that evidence (JSON text) is about; of an array the first element, nested ones included, that has one."""
    v = F.try_parse_json(evidence)
    whole = F.schema_of_variant(v)
    named = F.filter(_objects_in(evidence), lambda o: o.rlike(_NAMED))
    inside = F.filter(F.transform(named, lambda o: _path_of(F.try_parse_json(o), "$")), lambda p: p.isNotNull())
    return F.when(whole.startswith("ARRAY"), F.get(inside, F.lit(0))).otherwise(_path_of(v, "$"))


def fingerprint(category: Column, primary: Column, severity: Column) -> Column:
    """Hash of category, primary file and severity."""
    return F.sha2(F.concat_ws("|", category, F.coalesce(primary, F.lit("unknown")), severity), 256)


def confidence(measured: Column, threshold: Column) -> Column:
    """How far a value lies over its threshold, in [0, 1]."""
    return F.when(threshold == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (measured - threshold) / F.nullif(threshold, F.lit(0)))))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The most confident finding of each fingerprint, first on ties."""
    w = W.partitionBy("fingerprint").orderBy(F.col("confidence").desc_nulls_last(), "ord")
    return findings.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def _related(a: str, b: str) -> bool:
    return {a, b} in ({"coupling", "god-module"}, {"circular-dep", "coupling"}) or a == b == "coupling"


MERGED = "primary_file string, category string, severity string, title string, description string, suggestion string, merged string, confidence double, ord long"


def merge_related(findings: DataFrame) -> DataFrame:
    """Merges findings of related categories of one primary file, greedily in input order.

    The worst finding of a cluster gives category, severity and title; descriptions and suggestions follow
    from the worst to the mildest.  A finding without a primary file stays alone, and needs no group.
    """
    cols = ["ord", "category", "severity", "title", "description", "suggestion"]

    def merged(rows: list[dict]) -> list[tuple]:
        clusters: list[list[dict]] = []
        for row in sorted(rows, key=lambda r: r["ord"]):
            home = next((c for c in clusters if any(_related(row["category"], x["category"]) and row["category"] != x["category"] for x in c)), None)
            (home.append(row) if home is not None else clusters.append([row]))
        out = []
        for c in clusters:
            c = sorted(c, key=lambda r: -SEVERITY_RANK.get(r["severity"], 0))
            suggestions = list(dict.fromkeys(r["suggestion"] for r in c if r["suggestion"]))
            out.append((c[0]["category"], c[0]["severity"], c[0]["title"], " Additionally: ".join(r["description"] for r in c), " Also: ".join(suggestions), ",".join(dict.fromkeys(r["category"] for r in c)), 1.0 if len(c) == 1 else min(1.0, 0.5 * len(c)), min(r["ord"] for r in c)))
        return out

    @F.pandas_udf(f"array<struct<{MERGED.removeprefix('primary_file string, ').replace(' ', ':').replace(',:', ',')}>>")
    def fold(groups: pd.Series) -> pd.Series:
        return pd.Series([merged(list(g)) for g in groups], dtype=object)

    alone = findings.where("primary_file is null").select("primary_file", "category", "severity", "title", "description", F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.col("category").alias("merged"), F.lit(1.0).alias("confidence"), F.col("ord").cast("long").alias("ord"))
    known = findings.where("primary_file is not null").withColumn("ord", F.col("ord").cast("long"))
    filed = known.groupBy("primary_file").agg(F.collect_list(F.struct(*cols)).alias("g")).select("primary_file", F.explode(fold.asNondeterministic()("g")).alias("m"))
    return filed.select("primary_file", "m.*").unionByName(alone)


def detect(files: DataFrame, edges: DataFrame, symbols: DataFrame, referenced: DataFrame, components: DataFrame, metrics: DataFrame) -> DataFrame:
    """All detectors over one project, related findings merged and repeats dropped.

    ``files`` (id, path), ``edges`` (src, dst), ``symbols`` and ``referenced`` as for dead code, ``components``
    (component, node) of the cycles, ``metrics`` (node, fan_in, fan_out, efferent, afferent, cohesion).
    Returns the merged rows with their fingerprint, best first by confidence within a fingerprint.
    """
    path = files.select(F.col("id").alias("node"), "path")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    smallest = components.groupBy("component").agg(F.min("node").alias("node"))
    cycles = circular_dependencies(components).join(smallest, "component").join(path, "node")
    dead = dead_code(symbols, referenced).withColumnRenamed("file_id", "node").join(path, "node")
    gods = god_modules(metrics).join(path, "node")
    layers = layering_violations(edges, files)
    coupled = coupling_findings(metrics).join(path, "node")
    rows = [
        (0, cycles, "circular-dep", F.col("path"), text("Circular dependency of ", F.col("cycle_length"), " files"), F.col("members")),
        (1, dead, "dead-code", F.col("path"), text(F.col("n_dead"), " unused exports"), F.col("names")),
        (2, gods, "god-module", F.col("path"), text("God module"), text("fan-in ", F.col("fan_in"), ", fan-out ", F.col("fan_out"))),
        (3, layers, "layering-violation", F.col("src_path"), text("Layering violation (", F.col("kind"), ")"), text(F.col("src_path"), " -> ", F.col("dst_path"))),
        (4, coupled, "coupling", F.col("path"), text("High ", F.col("metric")), text(F.col("metric"), " ", F.round("value", 4))),
    ]
    found = None
    for no, df, category, primary, title, description in rows:
        # the order of the detectors, then of the file and the text: what greedy merging follows
        part = df.select(primary.alias("primary_file"), F.lit(category).alias("category"), "severity", title.alias("title"), description.alias("description"), F.lit(None).cast("string").alias("suggestion"), F.lit(no).alias("no"))
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("primary_file").orderBy("no", "title", "description")
    merged = merge_related(found.withColumn("ord", F.row_number().over(order).cast("long")).drop("no"))
    return dedup_findings(merged.withColumn("fingerprint", fingerprint(F.col("category"), F.col("primary_file"), F.col("severity"))))


def parse_gaps(df: DataFrame, text: str = "response") -> DataFrame:
    """Findings from a JSON array in a text, code fences stripped; bad JSON gives none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    items = F.from_json(bare, "array<struct<title:string,description:string,severity:string,category:string>>", {"mode": "PERMISSIVE"})
    g = df.select(F.explode(F.filter(items, lambda x: x.isNotNull())).alias("g"))
    sev = F.lower(F.coalesce("g.severity", F.lit("low")))
    return g.select(F.coalesce("g.title", F.lit("Untitled")).alias("title"), F.coalesce("g.description", F.lit("")).alias("description"), F.when(sev.isin(*SEVERITY_RANK), sev).otherwise("low").alias("severity"), F.coalesce("g.category", F.lit("gap")).alias("category"))
