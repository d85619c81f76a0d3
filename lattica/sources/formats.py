"""Configuration files, manifests, lockfiles, advisories, diffs and repository walks, as rows."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T

Flat = list[tuple[str, str, str | None]]


def walk(spark: SparkSession, path: str, pattern: str = "*", exclude: tuple[str, ...] = (), most_bytes: int = 1 << 20) -> DataFrame:
    """(path, length, content) of files under ``path``: no binary ones, none too large, and
    none with an excluded folder in its path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    df = df.filter(F.col("length") <= most_bytes)
    if exclude:
        df = df.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in exclude])))
    return df.filter(F.instr(F.hex(F.substring("content", 1, 4096)).cast("string"), "0000") == 0).select("path", "length", "content")


def route(path) -> F.Column:
    """lockfile, manifest, workflow, config, source or skip, by the file's name."""
    name, ext = F.lower(T.base_name(path)), T.extension(path)
    lock = name.isin("cargo.lock", "go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "mix.lock", "pubspec.lock", "gradle.lockfile") | name.rlike(r"^requirements.*\.txt$")
    manifest = name.isin("pom.xml", "cargo.toml", "package.json", "go.mod", "build.gradle", "build.gradle.kts")
    workflow = F.concat(F.lit("/"), T.normal_path(path)).contains("/.github/workflows/") & ext.isin("yml", "yaml")
    config = ext.isin("json", "yaml", "yml", "toml", "xml", "properties", "ini", "env")
    source = ext.isin([*T.LANGUAGES, *"jsx swift scala lua md sql sh ex dart zig".split()])
    return F.when(lock, "lockfile").when(manifest, "manifest").when(workflow, "workflow").when(config, "config").when(source, "source").otherwise("skip")


def _leaf(path: str, value) -> tuple[str, str, str | None]:
    if value is None:
        return path, "null", None
    if isinstance(value, bool):
        return path, "boolean", str(value).lower()
    if isinstance(value, (int, float)):
        return path, "number", str(value)
    return path, "string", str(value)


def flatten(value, path: str = "") -> Flat:
    """Dotted paths of all leaves; list places in brackets; empty containers are leaves."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flatten(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flatten(v, f"{path}[{i}]")]
    if isinstance(value, (dict, list)):
        return [(path, "object" if isinstance(value, dict) else "array", None)]
    return [_leaf(path, value)]


def flat_json(text: str) -> Flat:
    return flatten(json.loads(text))


def flat_toml(text: str) -> Flat:
    return flatten(tomllib.loads(text))


def flat_properties(text: str) -> Flat:
    """key=value, key:value or key value; # and ! begin comments; a last backslash goes on."""
    out, held = [], ""
    for line in text.splitlines():
        line = held + line.strip()
        held = ""
        if not line or line[0] in "#!":
            continue
        if line.endswith("\\") and not line.endswith("\\\\"):
            held = line[:-1]
            continue
        m = re.match(r"((?:\\.|[^=:\s\\])+)\s*[=:\s]?\s*(.*)$", line)
        if m:
            out.append((m[1], "string", m[2]))
    return out


def flat_yaml(text: str) -> Flat:
    """Block mappings and lists of scalars, as configuration files mostly are."""
    rows, stack = [], [(-1, "")]
    counts: dict[str, int] = {}
    for raw in text.splitlines():
        line = re.sub(r"\s+#.*$", "", raw).rstrip()
        body = line.lstrip()
        if not body or body[0] == "#" or body in ("---", "..."):
            continue
        depth = len(line) - len(body)
        while stack[-1][0] >= depth and not (body.startswith("- ") and stack[-1][0] == depth and not stack[-1][1].endswith("]")):
            stack.pop()
        base = stack[-1][1]
        if body.startswith("- "):
            n = counts.get(base, 0)
            counts[base] = n + 1
            base, body = f"{base}[{n}]", body[2:]
            stack.append((depth, base))
            depth += 2
        m = re.match(r"""(?:"([^"]*)"|'([^']*)'|([^:#"'][^:]*)):(?:\s+(.*))?$""", body)
        if not m:
            rows.append(_scalar(base, body))
            continue
        key = m[1] or m[2] or m[3]
        path = f"{base}.{key}" if base else key
        if m[4] in (None, ""):
            stack.append((depth, path))
        else:
            rows.append(_scalar(path, m[4]))
    return rows


def _scalar(path: str, text: str) -> tuple[str, str, str | None]:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return path, "string", text[1:-1]
    if text in ("null", "~"):
        return path, "null", None
    if text in ("true", "false"):
        return path, "boolean", text
    return (path, "number", text) if re.fullmatch(r"-?\d+(\.\d+)?", text) else (path, "string", text)


def flat_xml(text: str) -> Flat:
    """Element paths with their texts, attributes as ``path.@name``."""
    from xml.etree import ElementTree

    out: Flat = []

    def visit(node, path: str) -> None:
        name = node.tag.rsplit("}", 1)[-1]
        here = f"{path}.{name}" if path else name
        out.extend((f"{here}.@{k}", "string", v) for k, v in node.attrib.items())
        if node.text and node.text.strip():
            out.append((here, "string", node.text.strip()))
        for child in node:
            visit(child, here)

    visit(ElementTree.fromstring(text), "")
    return out


#: Config formats by extension; register more by adding to it.
FORMATS: dict[str, Callable[[str], Flat]] = {"json": flat_json, "toml": flat_toml, "yaml": flat_yaml, "yml": flat_yaml, "properties": flat_properties, "xml": flat_xml}


def config_keys(files: DataFrame) -> DataFrame:
    """(path, key, value_type, value) of configuration files (path, content); files that
    cannot be read give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                read = FORMATS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    rows += [(path, *x) for x in (read(bytes(content).decode("utf-8", "replace")) if read else ())]
                except (ValueError, SyntaxError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "key", "value_type", "value"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, key string, value_type string, value string")


Deps = list[tuple[str, str, str | None]]


def _pairs(pattern: str, ecosystem: str) -> Callable[[str], Deps]:
    return lambda text: [(ecosystem, n, v) for n, v in re.findall(pattern, text, re.M)]


def _package_lock(text: str) -> Deps:
    data = json.loads(text)
    if "packages" in data:
        return [("npm", k.rsplit("node_modules/", 1)[-1], v.get("version")) for k, v in data["packages"].items() if k]
    return [("npm", k, v.get("version")) for k, v in data.get("dependencies", {}).items()]


def _toml_packages(ecosystem: str) -> Callable[[str], Deps]:
    return lambda text: [(ecosystem, p["name"], p.get("version")) for p in tomllib.loads(text).get("package", ())]


def _composer(text: str) -> Deps:
    data = json.loads(text)
    return [("packagist", p["name"], p.get("version")) for part in ("packages", "packages-dev") for p in data.get(part, ())]


def _pipfile(text: str) -> Deps:
    data = json.loads(text)
    return [("pypi", n, (v.get("version") or "").lstrip("=") or None) for part in ("default", "develop") for n, v in data.get(part, {}).items()]


def _npm(text: str) -> Deps:
    data = json.loads(text)
    return [("npm", n, v) for part in ("dependencies", "devDependencies", "peerDependencies") for n, v in data.get(part, {}).items()]


def _cargo(text: str) -> Deps:
    data = tomllib.loads(text)
    return [("cargo", n, v if isinstance(v, str) else v.get("version")) for part in ("dependencies", "dev-dependencies", "build-dependencies") for n, v in data.get(part, {}).items()]


def _maven(text: str) -> Deps:
    flat = re.findall(r"<dependency>(.*?)</dependency>", text, re.S)
    get = lambda d, k: (re.search(rf"<{k}>\s*([^<\s]+)", d) or [None, None])[1]
    return [("maven", f"{get(d, 'groupId')}:{get(d, 'artifactId')}", get(d, "version")) for d in flat]


#: Manifests and lockfiles by name; register more by adding to it.
DEPENDENCIES: dict[str, Callable[[str], Deps]] = {
    "package.json": _npm,
    "package-lock.json": _package_lock,
    "cargo.toml": _cargo,
    "cargo.lock": _toml_packages("cargo"),
    "poetry.lock": _toml_packages("pypi"),
    "uv.lock": _toml_packages("pypi"),
    "pipfile.lock": _pipfile,
    "composer.lock": _composer,
    "pom.xml": _maven,
    "go.mod": _pairs(r"^\s*(?:require\s+)?([\w./~-]+\.[\w./~-]+)\s+(v[\w.+-]+)", "go"),
    "go.sum": _pairs(r"^(\S+) (v[^\s/]+) h1:", "go"),
    "requirements.txt": _pairs(r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", "pypi"),
    "gemfile.lock": _pairs(r"^ {4}([\w.-]+) \(([^)]+)\)", "rubygems"),
    "gradle.lockfile": _pairs(r"^([\w.-]+:[\w.-]+):([^=\s]+)=", "maven"),
    "build.gradle": _pairs(r"""(?:implementation|api|compileOnly|testImplementation)\s*\(?["']([\w.-]+:[\w.-]+):([^"']+)["']""", "maven"),
    "yarn.lock": _pairs(r"""^"?(@?[^@\s"]+)@[^\n]*:\n\s+version:? "?([^"\n]+)""", "npm"),
    "mix.lock": _pairs(r'"([\w]+)": \{:hex, :\w+, "([^"]+)"', "hex"),
    "pubspec.lock": _pairs(r'^  (\w+):\n(?:    .*\n)*?    version: "([^"]+)"', "pub"),
}


def dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, package, version) of manifests and lockfiles (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                read = DEPENDENCIES.get(path.rsplit("/", 1)[-1].lower())
                try:
                    rows += [(path, *x) for x in (read(bytes(content).decode("utf-8", "replace")) if read else ())]
                except (ValueError, KeyError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "package", "version"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, ecosystem string, package string, version string")


OSV = "id string, summary string, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"


def advisories(raw: DataFrame) -> DataFrame:
    """(id, ecosystem, package, introduced, fixed, last_affected) from OSV documents in a
    column ``json``: each introduction and what ends it."""
    a = raw.select(F.from_json("json", OSV).alias("o")).select("o.id", F.explode("o.affected").alias("a"))
    r = a.select("id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"), F.explode("a.ranges").alias("r"))
    e = r.select("id", "ecosystem", "package", F.col("r.events").alias("e"), F.posexplode("r.events").alias("i", "x")).filter("x.introduced IS NOT NULL")
    after = F.element_at(F.slice("e", F.col("i") + 2, 1000), 1)
    nothing = F.col("i") + 1 >= F.size("e")
    return e.select("id", "ecosystem", "package", F.col("x.introduced").alias("introduced"), F.when(~nothing, after["fixed"]).alias("fixed"), F.when(~nothing, after["last_affected"]).alias("last_affected"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(path, h_start, h_end) on the new side, from diff lines (diff, n, line)."""
    from pyspark.sql import Window

    w = Window.partitionBy("diff").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1)
    df = lines.withColumn("path", F.last(F.when(name != "", name), ignorenulls=True).over(w))
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    df = df.filter(F.col("line").rlike(head)).withColumn("h_start", F.regexp_extract("line", head, 1).cast("int"))
    n = F.coalesce(F.expr(f"try_cast(regexp_extract(line, r'{head}', 2) AS int)"), F.lit(1))
    return df.select("path", "h_start", (F.col("h_start") + F.greatest(n - 1, F.lit(0))).alias("h_end"))


_BOM = "components array<struct<name:string,version:string,purl:string>>, packages array<struct<name:string,versionInfo:string>>, Results array<struct<Packages:array<struct<Name:string,Version:string>>>>"


def bill_of_materials(raw: DataFrame) -> DataFrame:
    """(path, package, version) of CycloneDX, SPDX and scanner reports (path, json)."""
    o = raw.select("path", F.from_json("json", _BOM).alias("o"))
    cyclone = F.transform("o.components", lambda c: F.struct(c["name"].alias("package"), c["version"].alias("version")))
    spdx = F.transform("o.packages", lambda c: F.struct(c["name"].alias("package"), c["versionInfo"].alias("version")))
    scan = F.transform(F.flatten(F.transform("o.Results", lambda r: F.coalesce(r["Packages"], F.array()))), lambda c: F.struct(c["Name"].alias("package"), c["Version"].alias("version")))
    none = F.array().cast("array<struct<package:string,version:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in (cyclone, spdx, scan)])
    return o.select("path", F.explode(every).alias("x")).select("path", "x.package", "x.version").filter("package IS NOT NULL").distinct()


def sniffed(content) -> F.Column:
    """matlab or objectivec for a text of a ``.m`` file, by which one's marks it has more of."""
    count = lambda p: F.regexp_count(content, F.lit(p))
    objective = count(r"(?m)^\s*(#import|#include|@interface|@implementation|@property|@end)") + count(r"\[\w+ \w+")
    matlab = count(r"(?m)^\s*(function\b|end\s*$|%|classdef\b)") + count(r"\.\*|\.\^")
    return F.when(matlab > objective, "matlab").otherwise("objectivec")
