"""Which paths are indexed: exclusion rules, secret paths and ignore files, as column expressions built from globs.

Globs become regular expressions when the plan is built; a path is tested against one alternation of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import file_name, path_parts, suffix

# The default lists.
EXCLUDED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".bmp", ".tiff", ".tif",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".pyc", ".pyo", ".class",
    ".pyd", ".zip", ".tar", ".gz", ".tgz", ".bz2", ".rar", ".7z", ".jar", ".war",
    ".ear", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac", ".ogg", ".webm",
    ".m4a", ".m4v", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".doc", ".docx", ".xls",
    ".xlsx", ".ppt", ".pptx", ".sqlite", ".db", ".sqlite3", ".mdb", ".lock", ".map", ".pdf",
]
EXCLUDED_FILENAMES = [
    ".DS_Store", "Thumbs.db", ".gitkeep", ".npmrc", ".yarnrc", ".pypirc", ".netrc", "credentials.json",
]
SECRET_FILENAMES = [
    ".env", ".npmrc", ".pypirc", ".netrc", "credentials.json", "id_rsa", "id_ed25519",
]
SECRET_PATTERNS = [
    ".env.*", "*.pem", "*.key", "*.crt", "*.p12", "*.pfx", "service-account*.json", ".aws",
    ".aws/*", ".ssh", ".ssh/*", ".kube", ".kube/*",
]
SECRET_DIRECTORIES = [
    ".ssh", ".aws", ".kube",
]
EXCLUDED_DIRECTORIES = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".env", "env", "dist",
    "build", ".idea", ".vscode", ".next", ".nuxt", "target", "bin", "obj",
    "coverage", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "eggs", "*.egg-info",
    ".eggs", "vendor", "Pods", ".gradle", ".mvn", "out", ".output", ".parcel-cache",
    ".turbo", ".aws", ".ssh", ".kube", ".claude", ".claude/worktrees", "graphify-out",
]


def glob_regex(glob: str) -> str:
    """A shell glob, where * and ? also match slashes, as an unanchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            own = glob[i:j].replace("\\", "\\\\")
            out += "[" + ("^" + own[1:] if own.startswith("!") else own) + "]"
            i = j + 1
        else:
            out += re.escape(c)
    return out


def _any(globs: list[str]) -> str:
    return "^(?s:" + "|".join(map(glob_regex, globs)) + ")$"


@dataclass(frozen=True)
class Policy:
    """Rules for paths. A decision has an action, ordered reason codes and whether the path looks secret."""

    excluded_extensions: list[str] = field(default_factory=lambda: EXCLUDED_EXTENSIONS)
    excluded_directories: list[str] = field(default_factory=lambda: EXCLUDED_DIRECTORIES)
    excluded_filenames: list[str] = field(default_factory=lambda: EXCLUDED_FILENAMES)
    secret_filenames: list[str] = field(default_factory=lambda: SECRET_FILENAMES)
    secret_patterns: list[str] = field(default_factory=lambda: SECRET_PATTERNS)

    def secret_reasons(self, path: Column) -> Column:
        name = file_name(path)

        def hit(glob: str) -> Column:
            rule = _any([glob])
            return name.rlike(rule) | path.rlike(rule) | F.exists(path_parts(path), lambda p: p.rlike(rule))

        codes = [F.when(name.isin(self.secret_filenames), F.lit("secret_filename"))]
        codes += [F.when(hit(g), F.lit(f"secret_path_pattern:{g}")) for g in self.secret_patterns]
        codes += [F.when(F.exists(path_parts(path), lambda p: p.isin(SECRET_DIRECTORIES)), F.lit("secret_directory"))]
        return F.array_compact(F.array(*codes))

    def is_secret(self, path: Column) -> Column:
        """The same decision by three tests, without the codes."""
        name, rule = file_name(path), _any(self.secret_patterns)
        return name.isin(self.secret_filenames) | name.rlike(rule) | path.rlike(rule) | F.exists(path_parts(path), lambda p: p.rlike(rule) | p.isin(SECRET_DIRECTORIES))

    def in_excluded_directory(self, path: Column) -> Column:
        plain = [g.strip("/") for g in self.excluded_directories if "/" not in g.strip("/")]
        deep = [g.strip("/") for g in self.excluded_directories if "/" in g.strip("/")]
        out = F.exists(path_parts(path), lambda p: p.rlike(_any(plain))) if plain else F.lit(False)
        if deep:
            out = out | F.regexp_replace(path, "^/+|/+$", "").rlike(_any([v for g in deep for v in (g, f"*/{g}", f"{g}/*", f"*/{g}/*")]))
        return out

    def decision(self, path: Column | str, is_directory: bool = False) -> Column:
        """STRUCT(action, reason_codes, secret_risk, safe_to_auto_delete)."""
        path = F.col(path) if isinstance(path, str) else path
        more = [F.when(file_name(path).isin(self.excluded_filenames), F.lit("excluded_filename"))]
        if not is_directory:
            more.append(F.when(suffix(path).isin(self.excluded_extensions), F.lit("excluded_extension")))
        more.append(F.when(self.in_excluded_directory(path), F.lit("excluded_directory")))
        secret = self.secret_reasons(path)
        codes = F.array_distinct(F.concat(secret, F.array_compact(F.array(*more))))
        return F.struct(F.when(F.size(codes) > 0, F.lit("skip")).otherwise(F.lit("index")).alias("action"), codes.alias("reason_codes"), (F.size(secret) > 0).alias("secret_risk"), (F.size(secret) == 0).alias("safe_to_auto_delete"))


def _unescaped_end(rule: str) -> str:
    """rule without the spaces at its end, but for one after a backslash."""
    bare = rule.rstrip(" \t")
    slashes = len(bare) - len(bare.rstrip("\\"))
    return bare + rule[len(bare) : len(bare) + 1] if slashes % 2 else bare


_POSIX = {"alpha": "\\p{Alpha}", "digit": "0-9", "alnum": "\\p{Alnum}", "upper": "A-Z", "lower": "a-z", "space": "\\s", "punct": "\\p{Punct}", "xdigit": "0-9A-Fa-f"}


def _class(rule: str, i: int) -> tuple[str, int] | None:
    """(expression, where it ends) of the class that begins with the bracket at i; None if no bracket closes it."""
    j, out = i + 1, ""
    negated = j < len(rule) and rule[j] in "!^"
    j += negated
    first = True
    while j < len(rule) and (rule[j] != "]" or first):
        first = False
        if rule.startswith("[:", j) and (k := rule.find(":]", j)) > 0 and rule[j + 2 : k] in _POSIX:
            out, j = out + _POSIX[rule[j + 2 : k]], k + 2
            continue
        c = rule[j]
        if c == "\\" and j + 1 < len(rule):
            j, c = j + 1, rule[j + 1]
            out += "\\" + c if not c.isalnum() else c
        elif c == "-":
            out += "-" if out and j + 1 < len(rule) and rule[j + 1] != "]" else "\\-"
        else:
            out += "\\" + c if c in "[]^&\\" else c
        j += 1
    if j >= len(rule) or not out:
        return None
    return ("[^/" + out + "]" if negated else "(?!/)[" + out + "]"), j + 1


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (Java regular expression over the path below its folder, negated); None for blanks, comments and rules that match nothing.

    Classes with ranges, negation and POSIX names; a backslash takes the sign after it as it is, a leading # or ! and a space at the end too."""
    rule = _unescaped_end(line.rstrip("\r\n"))
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folder_only = rule.endswith("/")
    rule = rule.rstrip("/")
    if not rule:
        return None
    anchored = "/" in rule
    rule, out, i = rule.lstrip("/"), "", 0
    while i < len(rule):
        own = _class(rule, i) if rule[i] == "[" else None
        if own:
            out, i = out + own[0], own[1]
        elif rule[i] == "[" or rule[i] == "\\" and i + 1 == len(rule):
            return None  # an open bracket or a backslash that escapes nothing
        elif rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            i += rule[i] == "\\"
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder_only else "(?:/.*)?$"), negated


def ignore_rules(texts: DataFrame) -> DataFrame:
    """(folder, rules, any_rule) of texts (folder, text) of ignore files: rules in their order, as (pattern, negated), and an expression for all that ignore.
    A folder's texts are taken one after the other."""

    def parse(text):
        return [r for r in map(ignore_regex, text.splitlines()) if r]

    rules = F.udf(parse, "array<struct<pattern:string,negated:boolean>>")
    one = texts.groupBy("folder").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text")).select("folder", rules("text").alias("rules"))
    some = F.array_join(F.transform(F.filter("rules", lambda r: ~r["negated"]), lambda r: r["pattern"]), "|")
    return one.withColumn("any_rule", some).where("any_rule <> ''")


def left_out(below: Column, rules: Column) -> Column:
    """Whether rules (pattern, negated), in order, leave out a path below their folder: of the path and of each folder on the way to it, the last rule
    that matches decides, and what lies in a folder that is left out cannot be taken back."""
    parts = F.split(below, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    ways = F.concat(F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>")), F.array(below))
    last = lambda way: F.try_element_at(F.filter(rules, lambda r: F.rlike(way, r["pattern"])), F.lit(-1))
    return F.exists(ways, lambda way: ~F.coalesce(last(way)["negated"], F.lit(True)))


def ignored(path: Column, files: dict[str, str]) -> Column:
    """Whether any of a few folders' ignore files leaves path out, as one expression; any file that ignores the path wins. files: text of the ignore file
    by its folder. For rules of many folders there is scan.gitignored()."""
    out = F.lit(False)
    for folder, text in files.items():
        base = folder.rstrip("/") + "/"
        rules = [r for r in map(ignore_regex, text.splitlines()) if r]
        if rules:
            own = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("negated")) for p, n in rules))
            out = out | (F.startswith(path, F.lit(base)) & left_out(F.substring(path, len(base) + 1, 1_000_000), own))
    return out


# File types by extension, in groups of one type each; everything else is text.
TYPE_OF = {
    ".md": "markdown",
    ".markdown": "markdown",
    ".pdf": "pdf",
    ".py": "python",
    ".pyi": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".vue": "javascript",
    ".svelte": "javascript",
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".kt": "java",
    ".kts": "java",
    ".scala": "java",
    ".groovy": "java",
    ".gradle": "java",
    ".sbt": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "shell",
    ".ps1": "shell",
    ".psm1": "shell",
    ".bat": "shell",
    ".cmd": "shell",
    ".json": "json",
    ".jsonc": "json",
    ".json5": "json",
    ".prettierrc": "json",
    ".eslintrc": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".csv": "csv",
    ".sql": "sql",
    ".graphql": "graphql",
    ".gql": "graphql",
    ".html": "html",
    ".htm": "html",
    ".xhtml": "html",
    ".css": "css",
    ".scss": "css",
    ".sass": "css",
    ".less": "css",
}


def file_type(path: Column | str) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TYPE_OF.items() for x in kv))
    return F.coalesce(F.element_at(known, suffix(path)), F.lit("text"))
