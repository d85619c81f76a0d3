"""Scalar functions on names, paths and texts, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages they stand for; others stand for themselves.
LANGUAGES = {
    "rs": "rust", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "py": "python", "go": "go",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "cs": "csharp", "rb": "ruby",
    "php": "php", "kt": "kotlin", "kts": "kotlin", "groovy": "groovy", "pp": "puppet", "erb": "erb",
}

# Names that call nothing of the code base's own.
INTRINSICS = (
    "assert assert_eq assert_ne debug_assert panic todo unimplemented unreachable println eprintln print eprint dbg free malloc calloc realloc "
    "len length size writefilesync readfilesync console log require include"
).split()


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of * and ?."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\^$.|+()\[\]{}])", r"\\\1", c) for c in pattern) + "$"


def glob(col: Column, pattern: str) -> Column:
    """Whether the whole value matches; equality where the pattern has no wildcard."""
    return col.rlike(glob_regex(pattern)) if re.search(r"[*?]", pattern) else col == pattern


def file_glob(path: Column, pattern: str) -> Column:
    """A path glob: one without a slash may begin anywhere; a base name may match as well."""
    whole = pattern if "/" in pattern or pattern.startswith("*") else f"*{pattern}"
    return glob(path, whole) | glob(base_name(path), pattern)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the base name; null if there is none."""
    found = F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def language(path: Column, properties: Column | None = None) -> Column:
    """The property ``language`` if there is one, else by extension, lower-case."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    by_path = F.coalesce(table[extension(path)], extension(path))
    return F.lower(by_path if properties is None else F.coalesce(properties["language"], by_path))


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def scope_key(name: Column) -> Column:
    """Backslash and dot as slashes, so that prefixes compare across separators."""
    return F.translate(name, "\\.", "//")


def in_scope(qualified: Column, path: Column, scope: str) -> Column:
    """By prefix of the qualified name; where that is null, by whole segments of the path."""
    key = scope.replace("\\", "/").replace(".", "/").strip("/")
    return F.when(qualified.isNotNull(), scope_key(qualified).startswith(key)).otherwise(
        F.coalesce(F.concat(F.lit("/"), normal_path(path), F.lit("/")).contains(f"/{key}/"), F.lit(False))
    )


def role(path: Column, name: Column, stub: Column | None = None) -> Column:
    """test, external or production: tests are told by path or name, then stubs and names of
    intrinsics are external. A null path tells nothing."""
    p = F.lower(normal_path(path))
    file = base_name(p)
    by_path = F.concat(F.lit("/"), p).rlike("/tests?/") | file.rlike(r"\.(test|spec)\.|_test\.(rs|py|go|java)$|_tests\.rs$|^test_")
    low = F.lower(name)
    by_name = low.contains("cfg(test)") | low.rlike("(^|::)tests::|::tests$")
    bare = F.regexp_replace(F.regexp_extract(name, r"([^.:#]*)$", 1), "!+$", "")
    external = bare.isin(INTRINSICS) | F.lower(bare).isin("writefilesync", "readfilesync")
    if stub is not None:
        external = stub | external
    no = F.lit(False)
    return F.when(F.coalesce(by_path, no) | F.coalesce(by_name, no), "test").when(F.coalesce(external, no), "external").otherwise("production")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path has one of the patterns, freed of its stars, as whole segments."""
    whole, found = F.concat(F.lit("/"), F.lower(normal_path(path)), F.lit("/")), F.lit(False)
    for pattern in patterns:
        needle = pattern.replace("\\", "/").lower().replace("*", "").strip("/")
        if needle:
            found = found | whole.contains(f"/{needle}/")
    return found


# Endings and folders that say nothing about a module.
MODULE_ENDINGS = ".ts .tsx .js .jsx .mjs .cjs .py .rs .go .java .kt .cs .rb".split()
MODULE_NOISE = "src lib app pkg internal main java kotlin python crates".split()


def module_segments(raw: Column) -> Column:
    """Lower-case segments of an import or a path, without quotes, scopes, relative
    prefixes, one known ending, index files and folders of mere structure."""
    s = F.regexp_replace(F.trim(raw), r"""^["']+|["']+$""", "")
    s = F.regexp_replace(s, r"^(?:\.[/\\])*(?:\.\.[/\\])*@?", "")
    s = F.regexp_replace(s, "(?:" + "|".join(re.escape(e) for e in sorted(MODULE_ENDINGS, key=len, reverse=True)) + ")$", "")
    s = F.regexp_replace(s, r"[/\\](?:index|mod|__init__)$", "")
    parts = F.transform(F.split(s, r"[/\\.:]"), F.lower)
    return F.filter(parts, lambda x: (x != "") & ~x.isin(MODULE_NOISE))


def suffix_overlap(a: Column, b: Column) -> Column:
    """How many segments two lists share at their ends."""
    same = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def is_constructor(node_type: Column, name: Column, qualified: Column, properties: Column) -> Column:
    """A function that is marked as one, is called <init>, or is named like its owner."""
    base = F.element_at(F.split(qualified, r"\("), 1)
    marked = (properties["is_constructor"] == "true") | properties["kind"].isin("constructor", "constructor_declaration")
    own = F.regexp_extract(base, r"([^.:\\]+)(?:::|[.\\])[^.:\\]+$", 1)
    tail = F.regexp_extract(base, r"([^.:\\]+)$", 1)
    by_name = base.rlike(r"(?:\.|::|\\)<init>$") | ((name != "") & (tail == name) & (own == name))
    no = F.lit(False)
    return (node_type == "function") & (F.coalesce(marked, no) | F.coalesce(by_name, no))


def symbol_parts(symbol: Column) -> Column:
    """A struct of file, class and name of ``Class::method``, ``file:method`` or a plain name."""
    member = F.regexp_extract(symbol, r"([^:]+)$", 1)
    klass = F.regexp_extract(symbol, r"^(.+)::[^:]+$", 1)
    file = F.regexp_extract(symbol, r"^([^:]+\.[^:]+):[^:]+$", 1)
    return F.struct(F.nullif(file, F.lit("")).alias("file"), F.nullif(klass, F.lit("")).alias("class"), member.alias("name"))


# Severity by source and sink; 5 for all other pairs.
SEVERITY = {
    ("http_parameter", "sql_query"): 10, ("http_parameter", "shell_command"): 10, ("http_parameter", "html_render"): 9,
    ("http_parameter", "code_eval"): 10, ("file_input", "shell_command"): 8, ("file_input", "sql_query"): 7,
    ("database_result", "html_render"): 6, ("environment_var", "shell_command"): 7,
}


def severity(source: Column, sink: Column) -> Column:
    out = F.lit(5)
    for (a, b), n in SEVERITY.items():
        out = F.when((source == a) & (sink == b), n).otherwise(out)
    return out


# What interface languages call a type; string for all others.
IDL_TYPES = {
    "proto": {"int64": "int64", "double": "double", "bool": "bool"},
    "thrift": {"int64": "i64", "double": "double", "bool": "bool"},
    "openapi": {"int64": "integer", "double": "number", "bool": "boolean"},
}


def idl_type(kind: Column, target: str) -> Column:
    out = F.lit("string")
    for a, b in IDL_TYPES[target].items():
        out = F.when(kind == a, b).otherwise(out)
    return out


def purl(kind: Column, namespace: Column, name: Column, version: Column) -> Column:
    """A package URL; null parts are left out."""
    return F.concat(F.lit("pkg:"), F.lower(kind), F.lit("/"), F.coalesce(F.concat(namespace, F.lit("/")), F.lit("")), name, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def purl_parts(url: Column) -> Column:
    """A struct of type, namespace, name and version of a package URL, without qualifiers."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    part = lambda k: F.nullif(F.regexp_extract(plain, r"^pkg:([^/]+)/(?:(.+)/)?([^/@]+)(?:@([^@]+))?$", k), F.lit(""))
    return F.struct(F.lower(part(1)).alias("type"), part(2).alias("namespace"), part(3).alias("name"), part(4).alias("version"))


def stable_key(*parts: Column) -> Column:
    """A 128-bit id from texts that no text can hold the border of; null counts as empty."""
    return F.md5(F.concat_ws("\u00ff", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def owner(qualified: Column) -> Column:
    """What stands before the last ``::``, ``#`` or ``.``; null if nothing does."""
    found = F.regexp_extract(qualified, r"^(.*)(?:::|#|\.)[^.:#]+$", 1)
    return F.when(found != "", found)


def member(qualified: Column) -> Column:
    return F.regexp_extract(qualified, r"([^.:#]+)$", 1)


def plain_type(name: Column) -> Column:
    """A type's bare name: no generics, references, pointers or qualifiers."""
    bare = F.regexp_replace(F.regexp_replace(name, r"<.*>", ""), r"^(?:&|\*|mut |const |\s)+|[\[\]?*&\s]+$", "")
    return F.regexp_extract(bare, r"([^.:]+)$", 1)


def import_prefix(name: Column, depth: int = 2) -> Column:
    """The first ``depth`` segments of an import; null for paths, blanks and unknowns."""
    clean = F.trim(F.regexp_replace(name, r"""^['"]|['"];?$""", ""))
    parts = F.filter(F.split(clean, r"[./\\]|::"), lambda x: x != "")
    bad = clean.startswith("/") | clean.rlike(r"\s") | (clean == "<unknown>") | (clean == "")
    return F.when(~bad, F.array_join(F.slice(parts, 1, depth), "."))


def package_label(path: Column) -> Column:
    """The package of a file: for JVM layouts what follows the source root, for others what
    follows ``src/`` or the last two folders."""
    p = normal_path(path)
    jvm = F.regexp_extract(p, r"src/(?:main|test)/(?:java|kotlin|scala)/(.+)/[^/]+$", 1)
    space = F.regexp_extract(p, r"(?:^|/)(?:crates|packages)/([^/]+)/", 1)
    src = F.regexp_extract(p, r"(?:^|/)src/(.+)/[^/]+$", 1)
    parts = F.split(p, "/")
    last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts) - 1, F.lit(2))), "/")
    return F.when(jvm != "", F.translate(jvm, "/", ".")).when(space != "", space).when(src != "", src).when(F.size(parts) > 1, last).otherwise("(root)")


def tokens(text: Column) -> Column:
    """Distinct name tokens: split at lower-to-upper borders and at anything but letters
    and digits, of three bytes or more, ASCII letters lower-cased."""
    parted = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    words = F.filter(F.split(parted, r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 3)
    return F.array_distinct(F.transform(words, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def complexity_level(value: Column) -> Column:
    return F.when(value <= 5, "low").when(value <= 10, "moderate").when(value <= 20, "high").otherwise("very_high")


def escaped(text: Column) -> Column:
    """Text for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Patterns of secrets.
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned_secret": r"""(?:api[_-]?key|secret|token|passw(?:or)?d)\s*[=:]\s*["'][^"'\s]{8,}["']""",
}


def secrets(text: Column) -> Column:
    """An array of (kind, match) for every match of every pattern."""

    def of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match")))

    return F.concat(*[of(k, p) for k, p in SECRETS.items()])
