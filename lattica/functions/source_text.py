"""What source texts tell without a parser: environment variables and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How languages read environment variables and settings; group 1 is the name.
USAGES = {
    "rust": r"""(?:env::var(?:_os)?\(|env!\(|option_env!\()\s*"([^"]+)"|std::env::var\("([^"]+)"\)""",
    "python": r"""(?:os\.environ(?:\.get)?[\[(]|os\.getenv\()\s*["']([^"']+)["']""",
    "javascript": r"""process\.env(?:\.(\w+)|\[["'](\w+)["']\])""",
    "typescript": r"""process\.env(?:\.(\w+)|\[["'](\w+)["']\])""",
    "go": r"""os\.(?:Getenv|LookupEnv)\("([^"]+)"\)""",
    "java": r"""System\.(?:getenv|getProperty)\("([^"]+)"\)|@Value\("\$\{([^}:"]+)""",
    "csharp": r"""Environment\.GetEnvironmentVariable\("([^"]+)"\)""",
    "ruby": r"""ENV(?:\.fetch\(|\[)["']([^"']+)["']""",
}


def usages(language: Column, text: Column) -> Column:
    """The names that a text reads, by its language, in order and each once."""
    out = F.array().cast("array<string>")
    for name, pattern in USAGES.items():
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, 2 + pattern.count("|@Value") + pattern.count("|\\[[") + pattern.count("|std"))]
        both = found[0] if len(found) == 1 else F.zip_with(found[0], found[1], lambda a, b: F.when(a != "", a).otherwise(b))
        out = F.when(language == name, F.array_distinct(both)).otherwise(out)
    return out


def signature(text: Column) -> Column:
    """A struct of name, params (name and type; unknown if none) and returns of the first
    function head in a text, of a language that writes ``fn`` or ``def``."""
    head = r"(?:fn|def)\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([\w<>]+))?"
    part = lambda k: F.regexp_extract(text, head, k)
    given = F.filter(F.transform(F.split(part(2), ","), F.trim), lambda p: p != "")

    def split(p: Column) -> Column:
        kind = F.trim(F.regexp_extract(p, r"^[^:]*:(.*)$", 1))
        return F.struct(F.trim(F.regexp_extract(p, r"^([^:]*)", 1)).alias("name"), F.when(kind == "", "unknown").otherwise(kind).alias("type"))

    return F.when(part(1) != "", F.struct(part(1).alias("name"), F.transform(given, split).alias("params"), F.nullif(part(3), F.lit("")).alias("returns")))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two signatures take as many parameters and return the same, but for case."""
    kind = lambda s: F.lower(F.trim(F.coalesce(s["returns"], F.lit(""))))
    return (F.size(a["params"]) == F.size(b["params"])) & (kind(a) == kind(b))
