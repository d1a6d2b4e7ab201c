"""The documentation layer: which files are documents or settings, what they say, and what the project is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T

# Headings (lower-case patterns) that tell a project's purpose, its architecture and its setup.
PURPOSE = r"^what\s+is|^about$|^overview$|^introduction$|^description$|^purpose$|^summary$"
ARCHITECTURE = r"^architecture$|^design$|^structure$|^system\s+design|^tech(nical)?\s+stack|^stack$|^components$|^modules$"
SETUP = r"^install(ation)?$|^setup$|^getting\s+started$|^quick\s*start$|^usage$|^prerequisites$|^requirements$"

# Settings files by name (or path, where the pattern has a slash), first match first: (category, purpose, pattern).
CONFIGS = (
    ("package-manager", "Node.js package manifest", r"package\.json"),
    ("package-manager", "npm lock file", r"package-lock\.json"),
    ("package-manager", "Yarn lock file", r"yarn\.lock"),
    ("package-manager", "pnpm lock file", r"pnpm-lock\.yaml"),
    ("package-manager", "npm configuration", r"\.npmrc"),
    ("package-manager", "Yarn configuration", r"\.yarnrc(\.yml)?"),
    ("package-manager", "Rust package manifest", r"Cargo\.toml"),
    ("package-manager", "Go module manifest", r"go\.mod"),
    ("package-manager", "Python dependencies", r"requirements\.txt"),
    ("package-manager", "Pipenv dependencies", r"Pipfile"),
    ("package-manager", "Python project configuration", r"pyproject\.toml"),
    ("package-manager", "Ruby dependencies", r"Gemfile"),
    ("package-manager", "PHP package manifest", r"composer\.json"),
    ("package-manager", "C# project file", r"\.csproj"),
    ("package-manager", "Visual Studio solution", r".*\.sln"),
    ("package-manager", "NuGet configuration", r"nuget\.config"),
    ("typescript", "TypeScript configuration", r"tsconfig(\..+)?\.json"),
    ("linter", "ESLint configuration", r"\.eslintrc(\.(js|cjs|mjs|json|yml|yaml))?"),
    ("linter", "ESLint flat configuration", r"eslint\.config\.(js|cjs|mjs|ts)"),
    ("formatter", "Prettier configuration", r"\.prettierrc(\.(js|cjs|json|yml|yaml))?"),
    ("formatter", "Prettier configuration", r"prettier\.config\.(js|cjs|mjs)"),
    ("linter", "Stylelint configuration", r"\.stylelintrc(\.(js|cjs|json|yml|yaml))?"),
    ("editor", "Editor configuration", r"\.editorconfig"),
    ("linter", "Biome linter/formatter configuration", r"biome\.json"),
    ("bundler", "Webpack configuration", r"webpack\.config\.(js|cjs|mjs|ts)"),
    ("bundler", "Vite configuration", r"vite\.config\.(js|ts|mjs)"),
    ("bundler", "Rollup configuration", r"rollup\.config\.(js|cjs|mjs|ts)"),
    ("bundler", "esbuild configuration", r"esbuild\.config\.(js|cjs|mjs|ts)"),
    ("bundler", "Turborepo configuration", r"turbo\.json"),
    ("bundler", "Nx workspace configuration", r"nx\.json"),
    ("bundler", "Lerna monorepo configuration", r"lerna\.json"),
    ("test", "Vitest configuration", r"vitest\.config\.(js|ts|mjs)"),
    ("test", "Jest configuration", r"jest\.config\.(js|cjs|mjs|ts|json)"),
    ("test", "Mocha configuration", r"\.mocharc(\.(js|cjs|json|yml|yaml))?"),
    ("test", "Cypress configuration", r"cypress\.config\.(js|ts)"),
    ("test", "Playwright configuration", r"playwright\.config\.(js|ts)"),
    ("test", "pytest configuration", r"pytest\.ini"),
    ("test", "Python setup configuration", r"setup\.cfg"),
    ("ci", "GitHub Actions workflow", r"\.github/workflows/.+\.ya?ml"),
    ("ci", "GitLab CI configuration", r"\.gitlab-ci\.ya?ml"),
    ("ci", "Jenkins pipeline", r"Jenkinsfile"),
    ("ci", "CircleCI configuration", r"\.circleci/config\.ya?ml"),
    ("ci", "Travis CI configuration", r"\.travis\.ya?ml"),
    ("ci", "Azure Pipelines configuration", r"azure-pipelines\.ya?ml"),
    ("ci", "Bitbucket Pipelines configuration", r"bitbucket-pipelines\.ya?ml"),
    ("docker", "Docker image definition", r"Dockerfile(\..+)?"),
    ("docker", "Docker Compose configuration", r"docker-compose(\..+)?\.ya?ml"),
    ("docker", "Docker ignore patterns", r"\.dockerignore"),
    ("environment", "Environment variables", r"\.env(\..+)?"),
    ("git", "Git ignore patterns", r"\.gitignore"),
    ("git", "Git attributes", r"\.gitattributes"),
    ("database", "Drizzle ORM configuration", r"drizzle\.config\.(js|ts)"),
    ("database", "Knex migration configuration", r"knexfile\.(js|ts)"),
    ("database", "Prisma schema", r"prisma/schema\.prisma"),
    ("database", "Alembic migration configuration", r"alembic\.ini"),
    ("deployment", "Vercel deployment configuration", r"vercel\.json"),
    ("deployment", "Netlify deployment configuration", r"netlify\.toml"),
    ("deployment", "Fly.io deployment configuration", r"fly\.toml"),
    ("deployment", "Heroku process configuration", r"Procfile"),
    ("deployment", "Google App Engine configuration", r"app\.ya?ml"),
)
# Dependencies that count as frameworks.
FRAMEWORKS = r"(?i)^(react|next|vue|nuxt|angular|express|fastify|nestjs|svelte|remix|astro)$|^@(angular|vue|nestjs|svelte)/"
# Names of languages in a tech stack.
STACK_LANGUAGES = {"typescript": "TypeScript", "tsx": "TypeScript", "javascript": "JavaScript", "python": "Python", "c_sharp": "C#"}
#: Dependencies told of each section of a manifest.
MOST_DEPENDENCIES = 20


def _filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# --- documents

def parse_documents(files: DataFrame) -> DataFrame:
    """(path, title, purpose, architecture, setup, summary) of document files (path, content).

    The title is the first top heading, else the file's name; each part is the content of the first
    section with a matching heading (null if that is empty); without any the first section speaks.
    """
    sections = T.markdown_sections(files.where(T.is_doc(F.col("path"))), "path", "content")

    def part(pattern: str) -> Column:
        return F.nullif(F.min_by("content", F.when(F.lower("heading").rlike(pattern), F.col("section"))), F.lit(""))

    found = sections.groupBy("path").agg(
        F.min_by("heading", F.when(F.col("level") == 1, F.col("section"))).alias("h1"), part(PURPOSE).alias("purpose"), part(ARCHITECTURE).alias("architecture"),
        part(SETUP).alias("setup"), F.min_by("content", "section").alias("first"),
    )
    docs = files.where(T.is_doc(F.col("path"))).select("path").join(found, "path", "left")
    title = F.coalesce("h1", F.regexp_replace(_filename(F.col("path")), r"\.[^.]+$", ""))
    told = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {name}\n"), c))
    rest = F.when(F.coalesce("purpose", "architecture", "setup").isNull() & (F.col("first") != ""), F.concat(F.lit("\n"), "first"))
    summary = F.concat_ws("\n", F.concat(F.lit("# "), title), told("Purpose", "purpose"), told("Architecture", "architecture"), told("Setup", "setup"), rest)
    return docs.select("path", title.alias("title"), "purpose", "architecture", "setup", F.trim(summary).alias("summary"))


def doc_content(headers: DataFrame, comments: DataFrame) -> DataFrame:
    """(path, doc_content) from file headers (path, header) and comments (path, kind, text, start_line)."""
    told = comments.where(F.col("kind").isin("jsdoc", "docstring", "xml-doc"))
    line = F.concat(F.lit("- [L"), F.col("start_line").cast("string"), F.lit("] "), F.substring("text", 1, 200))
    lines = told.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start_line", line.alias("line")))).alias("l"))
    both = headers.select("path", "header").join(lines, "path", "full")
    head = F.when(F.col("header") != "", F.concat(F.lit("File description: "), "header"))
    listed = F.when(F.col("n") > 0, F.concat(F.lit("Documentation comments ("), F.col("n").cast("string"), F.lit("):\n"), F.array_join("l.line", "\n")))
    return both.select("path", F.trim(F.concat_ws("\n", head, listed)).alias("doc_content"))


# --- settings

def classify_config(path: Column) -> Column:
    """struct(category, purpose) of a settings file, else null; the first pattern decides."""
    name, out = _filename(path), F.lit(None).cast("struct<category:string,purpose:string>")
    for category, purpose, pattern in reversed(CONFIGS):
        hit = (path if "/" in pattern else name).rlike(f"(?i)^{pattern}$")
        out = F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(purpose).alias("purpose"))).otherwise(out)
    return out


def _string_at(v: Column, path: str) -> Column:
    """A JSON value if it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _details(pairs: list[tuple[str, Column]]) -> Column:
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def manifest_details(content: Column) -> Column:
    """Name, description, version, dependencies, frameworks, scripts and engines of a package manifest."""
    v = F.try_parse_json(content)
    sections = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>, engines map<string,string>")
    names = [F.coalesce(F.map_keys(sections[s]), F.array().cast("array<string>")) for s in ("dependencies", "devDependencies")]
    deps = F.concat(*(F.slice(n, 1, MOST_DEPENDENCIES) for n in names))
    frames = F.array_distinct(F.filter(F.concat(*names), lambda n: n.rlike(FRAMEWORKS)))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", "))
    as_json = lambda c: F.when(c.isNotNull(), F.to_json(c))
    return _details([*((k, _string_at(v, f"$.{k}")) for k in ("name", "description", "version")), ("dependencies", joined(deps)), ("frameworks", joined(frames)), ("scripts", as_json(sections["scripts"])), ("engines", as_json(sections["engines"]))])


def tsconfig_details(content: Column) -> Column:
    """Target, module, strictness and base of a TypeScript configuration; comments are allowed."""
    v = F.try_parse_json(F.regexp_replace(F.regexp_replace(content, r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", ""))
    strict = F.try_variant_get(v, "$.compilerOptions.strict", "variant")
    return _details([
        ("target", _string_at(v, "$.compilerOptions.target")), ("module", _string_at(v, "$.compilerOptions.module")),
        ("strict", F.when(F.schema_of_variant(strict) == "BOOLEAN", F.try_variant_get(v, "$.compilerOptions.strict", "boolean"))), ("extends", _string_at(v, "$.extends")),
    ])


def docker_details(path: Column, content: Column) -> Column:
    """The base image of a Dockerfile."""
    image = F.nullif(F.regexp_extract(content, r"(?im)^FROM\s+(\S+)", 1), F.lit(""))
    return _details([("baseImage", F.when(_filename(path).rlike("(?i)^Dockerfile"), image))])


def env_details(content: Column) -> Column:
    """Names, not values, of the variables of an environment file."""
    names = F.regexp_extract_all(content, F.lit(r"(?im)^[ \t\r]*([A-Z_][A-Z0-9_]*)="), 1)
    return _details([("variables", F.when(F.size(names) > 0, F.array_join(names, ", ")))])


def parse_configs(files: DataFrame) -> DataFrame:
    """(path, category, purpose, details) of the settings files among (path, content)."""
    # generated rows, so that what reads a class or a detail later does not work it out again
    found = files.select("path", "content", F.explode(F.array(classify_config(F.col("path")))).alias("c")).where("c is not null")
    content, kind = F.coalesce("content", F.lit("")), F.col("c.category")
    details = F.when(kind == "package-manager", manifest_details(content)).when(kind == "typescript", tsconfig_details(content)).when(kind == "docker", docker_details(F.col("path"), content))
    details = details.when(kind == "ci", _details([("type", F.lit("CI/CD pipeline configuration"))])).when(kind == "environment", env_details(content)).otherwise(_details([("", F.lit(None))]))
    return found.select("path", "c.category", "c.purpose", F.explode(F.array(details)).alias("details"))


def config_content(configs: DataFrame) -> DataFrame:
    """(path, doc_content): what is told of a settings file, long values cut."""
    shown = F.transform(F.filter(F.map_entries("details"), lambda e: e["value"] != ""), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.when(F.char_length(e["value"]) > 200, F.concat(F.substring(e["value"], 1, 200), F.lit("..."))).otherwise(e["value"])))
    more = F.when(F.size(shown) > 0, F.concat(F.lit("Details:\n"), F.array_join(shown, "\n")))
    return configs.select("path", F.concat_ws("\n", F.concat(F.lit("Config: "), "purpose"), F.concat(F.lit("Category: "), "category"), more).alias("doc_content"))


def tech_stack(configs: DataFrame, files: DataFrame) -> DataFrame:
    """One row of sorted sets: languages, frameworks, tools and dependencies; scripts of the last path win."""
    names = F.create_map(*(F.lit(x) for kv in STACK_LANGUAGES.items() for x in kv))
    languages = files.select(F.lit("languages").alias("kind"), F.element_at(names, F.col("language")).alias("value"))
    detail = lambda k: F.split(F.element_at("details", F.lit(k)), ", ")
    manifests = configs.where("category = 'package-manager'")
    listed = [manifests.select(F.lit(kind).alias("kind"), F.explode(detail(kind)).alias("value")) for kind in ("frameworks", "dependencies")]
    by_purpose = F.create_map(*(F.lit(x) for kv in (("bundler", "build_tools"), ("test", "test_frameworks"), ("ci", "ci_systems"), ("docker", "containers")) for x in kv))
    tools = configs.select(F.element_at(by_purpose, F.col("category")).alias("kind"), F.when(F.col("category") == "docker", F.lit("Docker")).otherwise(F.col("purpose")).alias("value"))
    rows = languages.unionByName(tools)
    for part in listed:
        rows = rows.unionByName(part)
    kinds = ("languages", "frameworks", "build_tools", "test_frameworks", "ci_systems", "containers", "dependencies")
    distinct = rows.where("kind is not null and value is not null").distinct()
    sets = distinct.agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds))
    scripts = manifests.select("path", F.explode(F.from_json(F.element_at("details", F.lit("scripts")), "map<string,string>")).alias("name", "command"))
    last = scripts.groupBy("name").agg(F.max_by("command", "path").alias("command"))
    return sets.join(last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "command")))).alias("scripts")), how="left")


# --- intent

def project_modules(documents: DataFrame, configs: DataFrame, headers: DataFrame) -> DataFrame:
    """(dir, name, description, files): sub-packages with what is told of them (K24); files are (path, description)."""
    own = configs.where("category = 'package-manager' and path like '%/package.json'")
    modules = own.groupBy(F.regexp_replace("path", "/package[.]json$", "").alias("dir")).agg(F.min_by("details", "path").alias("details"))
    read = documents.where("purpose is not null and path like '%/%'").groupBy(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("dir")).agg(F.min_by(F.substring("purpose", 1, 200), "path").alias("told"))
    modules = modules.join(read, "dir", "left").select("dir", F.coalesce(F.element_at("details", F.lit("name")), "dir").alias("name"), F.coalesce(F.element_at("details", F.lit("description")), "told").alias("description"))
    # a file belongs to the first module, in order of paths, that holds it
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = headers.where("header <> '' and path like '%/%'").select("path", F.substring("header", 1, 150).alias("text"), F.explode(above).alias("dir")).join(modules.select("dir"), "dir")
    first = held.groupBy("path", "text").agg(F.min("dir").alias("dir"))
    files = first.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("files"))
    return modules.join(files, "dir", "left")


def intent(documents: DataFrame, configs: DataFrame, headers: DataFrame, stack: DataFrame) -> DataFrame:
    """One row (description, purpose, architecture, full_text): what the project is for.

    The description comes from a manifest, else from the first sentence of the main readme's purpose,
    else from its title.  Files told of a module are at most ten.
    """
    readmes = documents.where(F.contains(F.lower("path"), F.lit("readme")))
    rank = F.struct(F.when(F.lower("path").isin("readme.md", "readme"), 0).otherwise(1), "path")
    main = readmes.agg(F.min_by("title", rank).alias("title"), F.min_by("purpose", rank).alias("purpose"), F.min_by("architecture", rank).alias("architecture"))
    stated = configs.where("category = 'package-manager'").agg(F.min_by(F.element_at("details", F.lit("description")), F.when(F.element_at("details", F.lit("description")).isNotNull(), F.col("path"))).alias("stated"))
    sentence = F.regexp_extract("purpose", r"(?s)^(.*?)(?:\.\s|$)", 1)
    sentence = F.when((sentence != "") & (F.char_length(sentence) <= 200), F.when(F.endswith(sentence, F.lit(".")), sentence).otherwise(F.concat(sentence, F.lit("."))))
    description = F.coalesce("stated", sentence, F.nullif("title", F.lit("")), F.lit("No project description found."))
    told = F.concat_ws("\n", F.concat(F.lit("### "), "name"), "description", F.when(F.size("files") > 0, F.concat(F.lit("Key files:\n"), F.array_join(F.transform(F.slice("files", 1, 10), lambda f: F.concat(F.lit("- "), f["path"], F.lit(": "), f["text"])), "\n"))), F.lit(""))
    modules = project_modules(documents, configs, headers).agg(F.array_join(F.array_sort(F.collect_list(F.struct("dir", told.alias("told"))))["told"], "\n").alias("modules"))
    listed = configs.where("category not in ('git', 'editor')").agg(F.array_join(F.array_sort(F.collect_list(F.struct("path", F.concat(F.lit("- "), "path", F.lit(": "), "purpose").alias("line"))))["line"], "\n").alias("configs"))
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    tech = stack.select(F.concat_ws("\n", line("Languages", "languages"), line("Frameworks", "frameworks"), line("Build tools", "build_tools"), line("Test frameworks", "test_frameworks")).alias("tech"))
    one = main.join(stated, how="left").join(modules, how="left").join(listed, how="left").join(tech, how="left")
    section = lambda head, c: F.when(c != "", F.concat(F.lit(f"## {head}\n"), c, F.lit("\n")))
    full = F.concat_ws(
        "\n", F.lit("# Project Intent\n"), section("Description", description), section("Purpose", F.col("purpose")), section("Architecture", F.col("architecture")), section("Tech Stack", F.col("tech")),
        F.when(F.col("modules") != "", F.concat(F.lit("## Modules\n\n"), "modules")), F.when(F.col("configs") != "", F.concat(F.lit("## Configuration\n\n"), "configs", F.lit("\n"))),
    )
    return one.select(description.alias("description"), "purpose", "architecture", F.regexp_replace(full, r"\s+$", "").alias("full_text"))
