"""Detector interface and registry."""

from __future__ import annotations

import copy
from abc import ABC, abstractmethod
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.errors import AnalysisError, ConfigError
from oddledger.operators.groups import POSITION, HotKeys, Split, key_facts, position_rows
from oddledger.operators.transform import ORDER, prepare


CORE = ["id", "account_id", "timestamp", "amount"]


class Transactions:
    """Prepared detector input with facts that several detectors need once."""

    def __init__(self, df: DataFrame):
        self.df = prepare(df)

    @cached_property
    def _facts(self) -> tuple[int, HotKeys]:
        return key_facts(self.df, "account_id")

    @property
    def rows(self) -> int:
        return self._facts[0]

    @property
    def hot(self) -> HotKeys:
        return self._facts[1]

    def split(self, *extra: str, ordered: bool = False) -> Split:
        """The core columns by account.  Detectors that need no others start
        from the same exchange, and with ``ordered`` from the same numbered hot
        rows."""
        if extra:
            return Split.of(self.df.select(*CORE, *extra), "account_id", self.hot)
        if ordered and self.hot:
            return Split(self._core.cold, self._numbered)
        return self._core

    @cached_property
    def _core(self) -> Split:
        return Split.of(self.df.select(*CORE), "account_id", self.hot)

    @cached_property
    def _numbered(self) -> DataFrame:
        return position_rows(self._core.large, ["account_id"], ORDER, POSITION)


class Detector(ABC):
    """A detector turns transactions into scores.

    ``detect`` returns ``transaction_id``, ``score``, ``confidence`` and a
    ``metadata`` struct; it may leave out transactions it cannot judge.
    """

    type: str
    name: str
    description: str = ""
    min_rows: int = 1
    default_config: dict = {}

    def merged(self, config: dict | None) -> dict:
        full = {**copy.deepcopy(self.default_config), **(config or {})}
        self.validate(full)
        return full

    def validate(self, config: dict) -> None:  # noqa: B027
        """Raise ConfigError when the configuration cannot be used."""

    def run(self, data: DataFrame | Transactions, config: dict | None = None) -> DataFrame:
        """Merge defaults, check them and the row count, then build the plan."""
        full = self.merged(config)
        txns = data if isinstance(data, Transactions) else Transactions(data)
        if txns.rows < self.min_rows:
            raise AnalysisError(
                f"{self.type}.{self.name} needs at least {self.min_rows} transactions"
            )
        return self.detect(txns, full)

    @abstractmethod
    def detect(self, txns: Transactions, config: dict) -> DataFrame: ...

    def info(self) -> dict:
        return {
            "type": self.type,
            "name": self.name,
            "description": self.description,
            "min_rows": self.min_rows,
            "default_config": copy.deepcopy(self.default_config),
        }


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def scored(df: DataFrame, score: Column, confidence: Column, metadata: dict[str, Column]):
    """Shape a frame with ``id`` into the detector result."""
    return df.select(
        F.col("id").alias("transaction_id"),
        score.cast("double").alias("score"),
        confidence.cast("double").alias("confidence"),
        F.struct(*[c.alias(name) for name, c in metadata.items()]).alias("metadata"),
    )


_REGISTRY: dict[tuple[str, str], Detector] = {}


def register(detector: Detector) -> Detector:
    _REGISTRY[(detector.type, detector.name)] = detector
    return detector


def unregister(type: str, name: str) -> None:
    """Take a plug-in out again; an unknown one is passed over."""
    _REGISTRY.pop((type, name), None)


def get(type: str, name: str) -> Detector:
    try:
        return _REGISTRY[(type, name)]
    except KeyError:
        raise ConfigError(f"Unknown algorithm: {type}.{name}") from None


def list_detectors(type: str | None = None) -> list[dict]:
    return [d.info() for (kind, _), d in sorted(_REGISTRY.items()) if type in (None, kind)]
