"""Project detection from a table of paths (relative to the project's root): languages, projects, auxiliary targets, build commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.paths import LANGUAGES, PRUNED_DIRS, extension, file_name, iac_type, language_priority, marker_language, parent, source_language

#: Extensions and file names of auxiliary targets.
TARGET_EXTENSIONS = {"terraform": (".tf", ".tfvars", ".hcl"), "kubernetes": (".yaml", ".yml"), "yaml": (".yaml", ".yml"), "github-actions": (".yaml", ".yml"), "gitlab-ci": (".yaml", ".yml"), "azure-pipelines": (".yaml", ".yml"), "json": (".json",), "xml": (".xml",), "jsp": (".jsp", ".jspx"), "vf": (".page", ".component")}
TARGET_FILE_NAMES = {"dockerfile": ("dockerfile", "containerfile"), "docker-compose": ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), "gitlab-ci": (".gitlab-ci.yml",), "azure-pipelines": ("azure-pipelines.yml", "azure-pipelines.yaml")}


def visited(paths: DataFrame) -> DataFrame:
    """Different paths that no pruned directory lies on. The optimizer moves filters on a path below distinct(), but not below an aggregate,
    so what is made of a path is computed once a path and not once a row."""
    paths = paths.select("path").distinct().groupBy("path").agg(F.max("path").alias("p")).select(F.col("p").alias("path"))
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return paths.filter(~F.arrays_overlap(dirs, F.array(*map(F.lit, PRUNED_DIRS))))


def projects(paths: DataFrame) -> DataFrame:
    """root, language, marker_file, by root and language priority."""
    name = F.lower(file_name(F.col("path")))
    rows = visited(paths).select(parent(F.col("path")).alias("root"), marker_language(name).alias("language"), name.alias("marker_file"))
    return rows.filter("language is not null").distinct().orderBy("root", language_priority(F.col("language")), "marker_file")


def languages(paths: DataFrame) -> DataFrame:
    """Distinct languages of sources and markers with their priority, by priority."""
    rows = visited(paths)
    found = rows.select(source_language(F.col("path")).alias("language")).unionByName(rows.select(marker_language(F.lower(file_name(F.col("path")))).alias("language")))
    return found.filter("language is not null").distinct().withColumn("priority", language_priority(F.col("language"))).orderBy("priority")


def target_key(path: Column) -> Column:
    kind, ext = iac_type(F.lower(path)), extension(path)
    other = F.when(ext.isin("jsp", "jspx"), "jsp").when(ext.isin("page", "component"), "vf").when(ext == "xml", "xml").when(ext == "json", "json").when(ext.isin("yaml", "yml"), "yaml")
    return F.when(kind != "unknown", kind).otherwise(other)


def target_kind(key: Column) -> Column:
    return (
        F.when(key.isin("dockerfile", "docker-compose", "kubernetes", "terraform"), "iac").when(key.isin("github-actions", "gitlab-ci", "azure-pipelines"), "cicd")
        .when(key.isin("jsp", "vf"), "template").otherwise("config")
    )


def target_scope(path: Column, key: Column) -> Column:
    """Workflows belong to the nearest directory of that name, single files to themselves, others to their directory."""
    workflows = F.regexp_extract(path, r"(?i)\A((?:.*/)?workflows)(?:/|\z)", 1)
    return F.when((key == "github-actions") & (workflows != ""), workflows).when(key.isin("dockerfile", "docker-compose", "gitlab-ci", "azure-pipelines"), path).otherwise(parent(path))


def auxiliary_targets(paths: DataFrame) -> DataFrame:
    """path (scope), key, kind, marker: one a scope and key; of several files the last by path is the marker."""
    rows = visited(paths).withColumn("key", target_key(F.col("path"))).filter("key is not null")
    rows = rows.groupBy(target_scope(F.col("path"), F.col("key")).alias("scope"), "key").agg(F.max_by(F.lower(file_name(F.col("path"))), "path").alias("marker"))
    return rows.select(F.col("scope").alias("path"), "key", target_kind(F.col("key")).alias("kind"), "marker").orderBy("path", "key")


def _values(key: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for k, values in table.items():
        out = (F if out is None else out).when(key == k, F.array(*map(F.lit, values)))
    return out.otherwise(F.array().cast("array<string>"))


def profile(paths: DataFrame) -> DataFrame:
    """One row: languages by priority, primary_language, target_keys, is_polyglot, label, extensions, file_names."""
    langs = languages(paths).agg(F.array_sort(F.collect_list(F.struct("priority", "language"))).alias("l")).select(F.transform("l", lambda x: x["language"]).alias("languages"))
    keys = auxiliary_targets(paths).agg(F.array_sort(F.collect_set("key")).alias("aux"))
    both = langs.crossJoin(keys).withColumn("target_keys", F.array_sort(F.array_union("languages", "aux")))  # two single rows
    ext = F.flatten(F.concat(F.transform("languages", lambda x: _values(x, {k: v[0] for k, v in LANGUAGES.items()})), F.transform("aux", lambda x: _values(x, TARGET_EXTENSIONS))))
    return both.select(
        "languages", F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("unknown")).alias("primary_language"), "target_keys", (F.size("target_keys") > 1).alias("is_polyglot"),
        F.when(F.size("target_keys") == 0, "unknown").when(F.size("target_keys") == 1, F.try_element_at("target_keys", F.lit(1))).otherwise("polyglot").alias("label"),
        F.array_sort(F.array_distinct(ext)).alias("supported_extensions"), F.array_sort(F.array_distinct(F.flatten(F.transform("aux", lambda x: _values(x, TARGET_FILE_NAMES))))).alias("supported_file_names"),
    )


def build_targets(project_rows: DataFrame) -> DataFrame:
    """language, path, command for each project; roots are relative, the empty one is the project's own."""
    root, language, marker = F.col("root"), F.col("language"), F.col("marker_file")
    own = (root == "") | (root == ".")
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    choose = lambda here, *there: F.when(own, here).otherwise(at(*there))
    command = (
        F.when(language == "dotnet", choose("dotnet build", "dotnet build ", root, "/", marker))
        .when(language == "typescript", choose("npm run build", "npm run build --prefix ", root))
        .when(language == "python", choose("python -m compileall .", "python -m compileall ", root))
        .when(language == "go", choose("go build ./...", "cd ", root, " && go build ./..."))
        .when(language == "rust", choose("cargo build", "cargo build --manifest-path ", root, "/Cargo.toml"))
        .when((language == "java") & (marker == "pom.xml"), choose("mvn compile", "mvn -f ", root, "/pom.xml compile"))
        .when(language.isin("java", "kotlin"), choose("gradle build", "gradle -p ", root, " build"))
        .when((language == "cpp") & (marker == "cmakelists.txt"), choose("cmake --build .", "cmake --build ", root))
        .when(language == "cpp", choose("make", "make -C ", root))
        .when(language == "php", choose("composer validate", "composer --working-dir ", root, " validate"))
        .when(language == "ruby", choose("bundle exec rubocop", "cd ", root, " && bundle exec rubocop"))
    )
    return project_rows.select("language", F.col("root").alias("path"), command.alias("command")).filter("command is not null")
