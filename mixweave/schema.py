"""The declared columns of a document collection."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class QualityColumn:
    name: str
    higher_better: bool = True

    @classmethod
    def parse(cls, spec: str | dict[str, Any]) -> QualityColumn:
        if isinstance(spec, str):
            return cls(spec)
        return cls(spec["name"], bool(spec.get("higher_better", True)))


@dataclass(frozen=True)
class DatasetSchema:
    domain_col: str
    quality_cols: tuple[QualityColumn, ...]
    text_col: str = "text"
    char_count_col: str | None = None
    row_in_shard_col: str | None = None
    domain_names: tuple[str, ...] = ()
    quality_names: tuple[str, ...] = ()
    prune_threshold: float = 3.0
    pattern: str = "*.parquet"
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = [n for n in ("domain_col", "quality_cols", "text_col") if not getattr(self, n)]
        if missing:
            raise ValueError(f"the schema lacks {', '.join(missing)}")

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> DatasetSchema:
        known = {"domain_col", "text_col", "char_count_col", "row_in_shard_col", "prune_threshold"}
        given = {k: raw[k] for k in known if raw.get(k) is not None}
        return cls(
            domain_col=given.pop("domain_col", ""), quality_cols=tuple(QualityColumn.parse(q) for q in raw.get("quality_cols", ())), domain_names=tuple(raw.get("domain_names", ())),
            quality_names=tuple(raw.get("quality_names", ())), pattern=raw.get("preprocessed_pattern", "*.parquet"), extra={k: v for k, v in raw.items() if k not in known}, **given,
        )

    @classmethod
    def from_yaml(cls, path: str) -> DatasetSchema:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    @property
    def quality(self) -> list[str]:
        return [q.name for q in self.quality_cols]

    def metadata_columns(self) -> list[str]:
        """What a metadata scan reads; the text only where no character count is stored."""
        return [self.domain_col, *self.quality, self.char_count_col or self.text_col]

    def text_columns(self) -> list[str]:
        return [self.text_col, *([self.row_in_shard_col] if self.row_in_shard_col else [])]

    def missing(self, df: DataFrame) -> list[str]:
        """Declared columns that df lacks."""
        optional = [c for c in (self.char_count_col, self.row_in_shard_col) if c]
        return [c for c in dict.fromkeys([self.domain_col, *self.quality, self.text_col, *optional]) if c not in df.columns]

    def problems(self, df: DataFrame) -> list[str]:
        """Declared columns that df lacks, and those of a wrong type."""
        declared = {**{q: T.NumericType for q in self.quality}, self.text_col: T.StringType}
        declared |= {c: T.IntegralType for c in (self.char_count_col, self.row_in_shard_col) if c}
        types = {f.name: f.dataType for f in df.schema.fields}
        return [f"missing column {c}" for c in self.missing(df)] + [f"column {c} is {types[c].simpleString()}" for c, kind in declared.items() if c in types and not isinstance(types[c], kind)]
