"""Path predicates and classifications as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that secret and infrastructure scans of files pass over.
SECRET_IGNORED = (
    r"vendor/", r"node_modules/", r"\.git/", r"__pycache__/", r"\.pytest_cache/", r"target/debug/", r"target/release/", r"dist/", r"build/", r"\.next/", r"\.venv/", r"venv/",
    r"\.idea/", r"\.vscode/", r"\.lock\z", r"package-lock\.json\z", r"yarn\.lock\z", r"Cargo\.lock\z", r"poetry\.lock\z", r"\.min\.js\z", r"\.min\.css\z", r"_test\.", r"\.test\.",
    r"_spec\.", r"\.spec\.", r"/tests?/", r"/__tests__/", r"CHANGELOG", r"LICENSE", r"README", r"\.md\z",
)
IAC_IGNORED = (r"vendor/", r"node_modules/", r"\.git/", r"__pycache__/", r"\.pytest_cache/", r"\.terraform/", r"\.terragrunt-cache/", r"target/", r"dist/", r"build/", r"\.idea/", r"\.vscode/")
#: Globs that rule scans pass over; they match a whole path, so as written they match little.
DEFAULT_GLOBS = ("node_modules/", "dist/", "build/", ".git/", "vendor/", "target/", "__pycache__/", ".next/")
#: Directories that a project profile does not enter.
PRUNED_DIRS = ("node_modules", "target", ".git", "__pycache__", "vendor", "dist", "build", ".next", "bin", "obj", ".idea", ".vscode", ".venv", "coverage")


def is_traversal(path: Column) -> Column:
    """Absolute, with a drive letter, or with a `..` component."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"\A/|\A[A-Za-z]:|(\A|/)\.\.(/|\z)")


def any_regex(path: Column, patterns: tuple[str, ...]) -> Column:
    return path.rlike("|".join(patterns)) if patterns else F.lit(False)


def matches_ignore(path: Column, patterns: list[str]) -> Column:
    """A regular expression found anywhere, or, if it is none, a substring."""
    out = F.lit(False)
    for p in patterns:
        try:
            re.compile(p)
            out = out | path.rlike(p)
        except re.error:
            out = out | F.contains(path, F.lit(p))
    return out


def glob_regex(glob: str) -> str | None:
    """A glob as a regular expression for whole paths; `*` and `?` cross `/`, `**` must be a whole component; None if it is no glob."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            run = len(glob) - len(glob[i:].lstrip("*")) - i
            if run > 2:
                return None
            if run == 2:
                if (i and glob[i - 1] != "/") or (i + 2 < len(glob) and glob[i + 2] != "/"):
                    return None
                if i + 2 < len(glob):
                    out.append("(?:.*/)?")
                    i += 3
                    continue
            out.append(".*")
            i += run
            continue
        if c == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] == "!" else i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out.append("[" + ("^" if body.startswith("!") else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body.removeprefix("!")) + "]")
            i = end + 1
            continue
        out.append("." if c == "?" else re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def matches_globs(path: Column, globs: list[str]) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    found = [r for r in map(glob_regex, [*DEFAULT_GLOBS, *globs]) if r]
    out = F.lit(False)
    for r in found:
        out = out | path.rlike(r)
    return out


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """Behind the last dot of the file name, lower-cased; none for names without dot or with only a leading one."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"\A.+\.([^.]*)\z", 1)), F.lit(""))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def iac_type(path: Column) -> Column:
    """Kind of infrastructure file, by the first rule that holds."""
    low, name = F.lower(path), file_name(path)
    yaml = name.endswith(".yaml") | name.endswith(".yml")
    return (
        F.when(F.lower(name).startswith("dockerfile") | name.endswith(".dockerfile"), "dockerfile")
        .when(F.contains(name, F.lit("docker-compose")) | name.isin("compose.yml", "compose.yaml"), "docker-compose")
        .when(low.rlike("/k8s/|/kubernetes/|/manifests/|/helm/") | (yaml & low.rlike("deployment|service|configmap")), "kubernetes")
        .when(name.endswith(".tf") | name.endswith(".tfvars"), "terraform")
        .when(F.contains(low, F.lit(".github/workflows/")), "github-actions")
        .when(name == ".gitlab-ci.yml", "gitlab-ci")
        .when(F.contains(name, F.lit("azure-pipelines")), "azure-pipelines")
        .otherwise("unknown")
    )


#: Other names of infrastructure kinds.
IAC_ALIASES = {"docker_compose": "docker-compose", "compose": "docker-compose", "k8s": "kubernetes", "tf": "terraform", "github_actions": "github-actions", "github": "github-actions", "gitlab_ci": "gitlab-ci", "gitlab": "gitlab-ci", "azure_pipelines": "azure-pipelines", "azure": "azure-pipelines"}
IAC_TYPES = ("dockerfile", "docker-compose", "kubernetes", "terraform", "github-actions", "gitlab-ci", "azure-pipelines")


def iac_type_named(name: str) -> str:
    low = name.lower()
    low = IAC_ALIASES.get(low, low)
    return low if low in IAC_TYPES else "unknown"


def is_ci_path(path: Column) -> Column:
    low = F.lower(path)
    return F.contains(low, F.lit(".github/workflows/")) | low.endswith(".gitlab-ci.yml") | low.endswith("azure-pipelines.yml") | low.endswith("azure-pipelines.yaml")


#: Metrics language by the end of the path, first hit first.
METRICS_SUFFIXES = ((".cs", "dotnet"), (".ts", "typescript"), (".tsx", "typescript"), (".js", "typescript"), (".jsx", "typescript"), (".py", "python"), (".go", "go"), (".rs", "rust"), (".java", "java"), (".cpp", "cpp"), (".cc", "cpp"), (".c", "cpp"), (".php", "php"), (".rb", "ruby"), (".kt", "kotlin"), (".kts", "kotlin"))


def metrics_language(path: Column) -> Column:
    low, out = F.lower(path), None
    for suffix, language in METRICS_SUFFIXES:
        out = (F if out is None else out).when(low.endswith(suffix), language)
    return out.otherwise("unknown")


#: Languages in order of priority with their extensions, build and lint commands and tools.
LANGUAGES = {
    "dotnet": ((".cs", ".cshtml"), "dotnet build", "dotnet build --verbosity normal", ("dotnet",)),
    "rust": ((".rs",), "cargo build", "cargo clippy", ("cargo", "rustc")),
    "go": ((".go",), "go build ./...", "golangci-lint run", ("go",)),
    "java": ((".java",), "mvn compile", "mvn checkstyle:check", ("mvn",)),
    "kotlin": ((".kt", ".kts"), "gradle build", "detekt", ("gradle", "kotlinc")),
    "typescript": ((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "npm run build", "npx tsc --noEmit", ("npm", "node")),
    "python": ((".py",), "python -m compileall .", "flake8 .", ("python",)),
    "php": ((".php",), "composer validate", "phpstan analyse", ("composer", "php")),
    "ruby": ((".rb", ".gemspec"), "bundle exec rubocop", "rubocop", ("ruby",)),
    "cpp": ((".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"), "make", "cppcheck .", ("gcc",)),
    "shell": ((".sh", ".bash", ".zsh", ".ksh", ".csh"), None, "shellcheck -f gcc", ("bash",)),
}
#: Names that mean a language.
LANGUAGE_NAMES = {"csharp": "dotnet", "c#": "dotnet", "ts": "typescript", "javascript": "typescript", "js": "typescript", "py": "python", "golang": "go", "rs": "rust", "c++": "cpp", "c": "cpp", "rb": "ruby", "kt": "kotlin", "bash": "shell", "sh": "shell", "zsh": "shell", "posix": "shell"}


def language_named(name: str) -> str | None:
    low = name.lower()
    low = LANGUAGE_NAMES.get(low, low)
    return low if low in LANGUAGES else None


def source_language(path: Column) -> Column:
    """Language by extension, null if none."""
    ext, out = extension(path), None
    for language, (extensions, *_) in LANGUAGES.items():
        out = (F if out is None else out).when(ext.isin(*(e[1:] for e in extensions)), language)
    return out


def marker_language(name: Column) -> Column:
    """Language of a project by the lower-cased name of a marker file, null if it is none."""
    return (
        F.when(name.endswith(".csproj") | name.endswith(".sln"), "dotnet")
        .when(name == "cargo.toml", "rust").when(name == "go.mod", "go").when(name.isin("pom.xml", "settings.gradle", "build.gradle"), "java")
        .when(name.isin("build.gradle.kts", "settings.gradle.kts"), "kotlin").when(name == "package.json", "typescript")
        .when(name.isin("pyproject.toml", "requirements.txt", "setup.py"), "python").when(name == "composer.json", "php").when(name == "gemfile", "ruby")
        .when(name.isin("makefile", "cmakelists.txt"), "cpp").when(name.endswith(".gemspec"), "ruby")
    )


def language_priority(language: Column) -> Column:
    out = None
    for i, name in enumerate(LANGUAGES):
        out = (F if out is None else out).when(language == name, i)
    return out.otherwise(len(LANGUAGES))
