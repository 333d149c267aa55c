"""Configuration: a flat YAML map with defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession

from ..functions.scoring import MATRICES, parse_matrix, register_matrix


def parse_budget(literal: str | int) -> int:
    """Bytes of '512m', '2G', '10k', '7b' or a plain number."""
    m = re.fullmatch(r"\s*(\d+)\s*([bkmg]?)\s*", str(literal), re.I)
    if not m:
        raise ValueError(f"not a memory budget: {literal!r}")
    value = int(m[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]
    if value <= 0:
        raise ValueError(f"a memory budget must be over 0: {literal!r}")
    return value


@dataclass(frozen=True)
class Params:
    AlignOverLongerSequence: int = 80
    MatchSimilarity: int = 40
    OptimalScoreOverSelfScore: int = 30
    SlideWindowSize: int = 3
    ExactMatchLength: int = 4
    SuffixArrayBlockSize: int = 100
    Function: str = "sw_stats_striped_16"
    Matrix: str = "blosum62"
    Open: int = -10
    Gap: int = -1
    MemoryWorker: int = 512 << 20
    MemorySequences: int = 2 << 30
    SkipPrefixes: list[str] = field(default_factory=list)
    OutputAll: bool = False
    OutputToDisk: bool = True
    DistributeSequences: bool = False
    UseLengthFilter: bool = True
    UseIterator: bool = False
    UseCounter: bool = False
    UseArray: bool = False
    UseTree: bool = False
    UseTreeDynamic: bool = False
    UseTreeHybrid: bool = False
    PrintStats: bool = True
    Alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ:;"
    AlphabetBegin: str = ":"
    AlphabetDollar: str = ";"
    DuplicatesLocal: bool = True
    DuplicatesSemiLocal: bool = False
    DuplicatesSmp: bool = False
    DuplicatesGlobal: bool = False
    BucketCutoff: int = 30
    SkipTree: bool = False
    PerformAlignments: bool = True

    def checked(self) -> Params:
        """These parameters, if they name a plan that can run."""
        _ = self.kind, self.dedup, self.strategy
        if self.Matrix.lower() not in MATRICES:
            raise ValueError(f"no such matrix: {self.Matrix}")
        for name in ("SlideWindowSize", "ExactMatchLength", "SuffixArrayBlockSize"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if self.SlideWindowSize > self.ExactMatchLength:
            raise ValueError("SlideWindowSize must not exceed ExactMatchLength: shorter matches would be lost")
        if self.Open > 0 or self.Gap > 0:
            raise ValueError("Open and Gap are scores, so they are not over 0")
        return self

    @property
    def letters(self) -> str:
        """The alphabet without its sentinels."""
        return "".join(c for c in self.Alphabet if c not in (self.AlphabetBegin, self.AlphabetDollar))

    @property
    def kind(self) -> str:
        """The alignment that Function names: sw, sg or nw."""
        kind = self.Function.split("_")[0].lower()
        if kind not in ("sw", "sg", "nw"):
            raise ValueError(f"no such alignment function: {self.Function}")
        return kind

    @property
    def dedup(self) -> str:
        """The scope in which repeated pairs are dropped, by precedence."""
        for name, scope in (("DuplicatesSmp", "process"), ("DuplicatesLocal", "none"), ("DuplicatesSemiLocal", "partition"), ("DuplicatesGlobal", "global")):
            if getattr(self, name):
                return scope
        raise ValueError("one of the Duplicates keys must be true")

    @property
    def strategy(self) -> str:
        for name in ("UseIterator", "UseTree", "UseTreeDynamic", "UseTreeHybrid", "UseCounter"):
            if getattr(self, name):
                return name[3:].lower()
        return "bruteforce"


def from_map(values: dict[str, Any]) -> Params:
    """Unknown keys are ignored; budgets may have a suffix."""
    known = {f.name: f for f in fields(Params)}
    out = {}
    for key, value in values.items():
        if key not in known:
            continue
        if key.startswith("Memory"):
            value = parse_budget(value)
        elif key == "SkipPrefixes":
            value = [str(v) for v in value or []]
        elif isinstance(known[key].default, bool):
            value = bool(value)
        elif isinstance(known[key].default, int):
            value = int(value)
        else:
            value = str(value)
        out[key] = value
    return Params(**out)


def load(spark: SparkSession, path: str) -> Params:
    """Reads a .yaml file from any store that Spark reads."""
    import yaml

    if not path.endswith(".yaml"):
        raise ValueError("the configuration must be a .yaml file")
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    return from_map(yaml.safe_load(text) or {})


def load_matrix(spark: SparkSession, name: str, path: str) -> None:
    """Makes the matrix in a text file known by a name."""
    register_matrix(name, parse_matrix("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())))


def echo(params: Params) -> str:
    import yaml

    return yaml.safe_dump({f.name: getattr(params, f.name) for f in fields(Params)}, sort_keys=False)
