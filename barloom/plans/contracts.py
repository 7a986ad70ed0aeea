"""Named, versioned sets of column builders: features and targets are declared, checked on schemas, and digested."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from barloom.functions.core import check_has, check_new

HISTORY = ("bounded", "expanding", "path_dependent", "cross_sectional")


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; tuples as lists, sets sorted."""
    plain = lambda v: sorted(v) if isinstance(v, set | frozenset) else str(v)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=plain)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class Block:
    """A builder with its parameters, the columns it reads and those it adds."""

    name: str
    builder: Callable[..., DataFrame]
    outputs: tuple[str, ...]
    inputs: frozenset[str]
    parameters: dict[str, Any] = field(default_factory=dict)
    history: str = "bounded"

    def __post_init__(self):
        if self.history not in HISTORY:
            raise ValueError(f"history must be one of {HISTORY}")
        if not self.outputs or len(set(self.outputs)) != len(self.outputs):
            raise ValueError("outputs must be named, once each")

    def apply(self, df: DataFrame) -> DataFrame:
        """df with the declared outputs, and nothing else that the builder adds."""
        check_has(df, self.inputs)
        check_new(df, self.outputs)
        made = self.builder(df, **self.parameters)
        check_has(made, self.outputs)
        return made.select(*df.columns, *self.outputs)

    def manifest(self) -> dict[str, Any]:
        return {"name": self.name, "parameters": self.parameters, "outputs": self.outputs, "inputs": sorted(self.inputs), "history": self.history}


@dataclass(frozen=True)
class BlockSet:
    """Blocks in order; an output may not be declared twice."""

    name: str
    version: str
    blocks: tuple[Block, ...]

    def __post_init__(self):
        if len(set(self.outputs)) != len(self.outputs):
            raise ValueError("two blocks have the same output")

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(c for b in self.blocks for c in b.outputs)

    @property
    def inputs(self) -> frozenset[str]:
        return frozenset().union(*(b.inputs for b in self.blocks))

    def apply(self, df: DataFrame) -> DataFrame:
        check_has(df, self.inputs)
        check_new(df, self.outputs)
        for block in self.blocks:
            df = block.apply(df)
        return df

    def select(self, names) -> BlockSet:
        """The same set with only the named blocks, in the set's order."""
        if unknown := set(names) - {b.name for b in self.blocks}:
            raise ValueError(f"no such blocks: {sorted(unknown)}")
        return BlockSet(self.name, self.version, tuple(b for b in self.blocks if b.name in set(names)))

    def manifest(self) -> dict[str, Any]:
        return {"name": self.name, "version": self.version, "blocks": [b.manifest() for b in self.blocks]}

    def digest(self) -> str:
        return digest(self.manifest())


@dataclass(frozen=True)
class Task:
    """One target column to learn: its type, horizon, and the column that tells when it is known, if any."""

    column: str
    kind: str
    horizon: int
    end_date_column: str | None = None

    def __post_init__(self):
        if self.kind not in ("boolean", "integer", "number"):
            raise ValueError("kind must be boolean, integer or number")
        if self.horizon < 1:
            raise ValueError("horizon must be positive")
