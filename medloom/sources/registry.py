"""Source registry: named, checksum-pinned inputs read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fv

COLUMNS = "name string, origin string, file string, sha256 string, role string, format string, label string, text_column string, entity_column string, required boolean"


@dataclass(frozen=True)
class Source:
    name: str
    file: str
    sha256: str
    role: str
    kaggle: str | None = None
    url: str | None = None
    format: str = "csv"
    label: str | None = None
    text_column: str | None = None
    entity_column: str | None = None
    description: str = ""
    licence: str | None = None

    def __post_init__(self) -> None:
        if bool(self.kaggle) == bool(self.url):
            raise ValueError(f"{self.name}: name exactly one origin")
        if self.format not in ("csv", "xml"):
            raise ValueError(f"{self.name}: unknown format {self.format}")

    @property
    def origin(self) -> str:
        return self.kaggle or self.url or ""

    @property
    def required(self) -> bool:
        return self.role != "audit_only"


@dataclass(frozen=True)
class Registry:
    sources: dict[str, Source]
    gate: dict[str, float] = field(default_factory=lambda: dict(fv.GATE))

    def by_role(self, role: str) -> list[Source]:
        return [s for s in self.sources.values() if s.role == role]


def load_registry(path: str | Path) -> Registry:
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a registry file needs pyyaml") from exc
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return Registry({name: Source(name=name, **spec) for name, spec in raw["sources"].items()}, {**fv.GATE, **raw.get("quality_gate", {})})


def registry_frame(spark: SparkSession, registry: Registry) -> DataFrame:
    rows = [(s.name, s.origin, s.file, s.sha256, s.role, s.format, s.label, s.text_column, s.entity_column, s.required) for s in registry.sources.values()]
    return spark.createDataFrame(rows, COLUMNS)
