"""Version orders of package ecosystems, as keys that sort like them, and hash functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: In semantic order; the registered query compares all of them.
SAMPLE = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0"]

# What ecosystems call releases before and after a release, in their order.
MAVEN = {"alpha": 1, "a": 1, "beta": 2, "b": 2, "milestone": 3, "m": 3, "rc": 4, "cr": 4, "snapshot": 5, "": 6, "ga": 6, "final": 6, "release": 6, "sp": 7}
PYTHON = {"dev": 0, "a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "rc": 3, "pre": 3, "": 4, "post": 5, "rev": 5, "r": 5}
PACKAGIST = {"dev": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "rc": 3, "": 4, "pl": 5, "patch": 5, "p": 5}


def _number(digits: str) -> str:
    """Digits that sort by value: their count first."""
    plain = digits.lstrip("0")
    return f"{len(plain):03d}{plain}"


def _semver(v: str) -> str:
    core, _, pre = re.sub(r"\+.*$", "", v.strip().lstrip("vV=")).partition("-")
    key = [_number(p) if p.isdigit() else "~" + p for p in (core.split(".") + ["0", "0"])[: max(3, core.count(".") + 1)]]
    # A release comes after what stands before it; numbers come before words there.
    tail = ["0" + _number(p) if p.isdigit() else "1" + p for p in pre.split(".")] if pre else ["~"]
    return ".".join(key) + "\x01" + "\x02".join(tail)


def _worded(words: dict[str, int], v: str) -> str:
    """Numbers, and words by their rank; trailing zeros do not count."""
    release = words[""]
    epoch, _, rest = v.strip().lower().lstrip("v").rpartition("!")
    parts = re.findall(r"\d+|[a-z]+", re.sub(r"\+.*$", "", rest))
    at = next((i for i, p in enumerate(parts) if not p.isdigit()), len(parts))
    core = parts[:at]
    while core and not core[-1].strip("0"):
        core.pop()
    key = [_number(p) for p in core]
    tail = []
    for p in parts[at:]:
        tail.append("9" + _number(p) if p.isdigit() else f"{words.get(p, release):01d}" + ("" if p in words else p))
    return _number(epoch or "0") + "!" + ".".join(key) + "\x01" + "\x02".join(tail or [str(release)])


def _gem(v: str) -> str:
    """Words come before numbers, and before the end."""
    parts = re.findall(r"\d+|[a-z]+", v.strip().lower().replace("-", ".pre."))
    while parts and parts[-1].isdigit() and not parts[-1].strip("0"):
        parts.pop()
    return "\x02".join(["2" + _number(p) if p.isdigit() else "0" + p for p in parts] + ["1"])


def _rock(v: str) -> str:
    main, _, rev = v.strip().lstrip("v").partition("-")
    return ".".join(_number(p) if p.isdigit() else "~" + p for p in main.split(".")) + "\x01" + _number(rev if rev.isdigit() else "0")


ENGINES: dict[str, Callable[[str], str]] = {
    "semver": _semver,
    "semver_nocase": lambda v: _semver(v.lower()),
    "go": _semver,
    "maven": lambda v: _worded(MAVEN, v),
    "pep440": lambda v: _worded(PYTHON, v),
    "packagist": lambda v: _worded(PACKAGIST, v),
    "rubygems": _gem,
    "luarocks": _rock,
    "conan": lambda v: _semver(v.split("@")[0]),
}


def version_key(scheme: str, engine: Callable[[str], str] | None = None) -> Callable[[Column], Column]:
    """A function on columns of versions that gives texts in the scheme's order; ``engine``
    stands for a scheme of one's own. Null gives null. Engines are asked once for each
    different version of a batch."""
    key = engine or ENGINES[scheme]

    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield v.map({x: key(x) for x in v.dropna().unique()})

    return run


@F.pandas_udf(LongType())
def splitmix64(x: pd.Series) -> pd.Series:
    """The splitmix64 step on each value, as a signed 64-bit number."""
    z = x.to_numpy().astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64))


@F.pandas_udf(LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as a signed 64-bit number; all texts of a batch together,
    one byte place at a time."""
    raws = [t.encode() if isinstance(t, str) else b"" for t in text]
    size = np.array([len(r) for r in raws])
    h, begin = np.full(len(raws), 0xCBF29CE484222325, dtype=np.uint64), np.cumsum(size) - size
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        h[on] = (h[on] ^ data[begin[on] + k]) * np.uint64(0x100000001B3)
    return pd.Series(h.view(np.int64))
