"""Settings with their defaults, and the settings file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class MemoryConfig:
    soft_delete_days: int = 30
    importance_threshold: float = 0.1
    inactive_days: int = 90
    low_importance: float = 0.3
    max_storage_gb: float = 10.0
    warning_usage: float = 0.9
    target_usage: float = 0.7


@dataclass(frozen=True)
class ImportanceConfig:
    decay: float = 0.05
    frequency_normalize: float = 10.0
    weight_recency: float = 0.3
    weight_frequency: float = 0.2
    weight_semantic: float = 0.2
    weight_explicit: float = 0.3


@dataclass(frozen=True)
class SourceWeights:
    user: float = 1.0
    system: float = 0.8
    inferred: float = 0.5
    external: float = 0.7


@dataclass(frozen=True)
class SearchConfig:
    alpha: float = 0.5
    mmr: bool = True
    mmr_lambda: float = 0.5
    mmr_top_k: int = 10
    mmr_candidates: int = 50
    half_life_hours: float = 336.0
    evergreen: tuple[str, ...] = ("global", "workspace")
    weights: SourceWeights = field(default_factory=SourceWeights)


@dataclass(frozen=True)
class ModelConfig:
    name: str = "minilm"
    dimension: int = 384
    pooling: str = "mean"
    min_score: float = 0.75


MODELS = {"minilm": ModelConfig(), "bge-m3": ModelConfig("bge-m3", 1024, "cls", 0.5)}


def custom_model(dimension: int) -> ModelConfig:
    return ModelConfig("custom", dimension, "mean", 0.5)


@dataclass(frozen=True)
class Settings:
    model: ModelConfig = field(default_factory=ModelConfig)
    data_dir: Path = Path("~/.mnemospark").expanduser()


def load(path: str | Path) -> Settings:
    """Read a settings file; one that doesn't exist is created with the defaults."""
    path = Path(path).expanduser()
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('data_dir = "~/.mnemospark"\n\n[model]\nname = "minilm"\n', encoding="utf-8")
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    model = raw.get("model", {})
    base = MODELS.get(model.get("name", "minilm")) or custom_model(int(model["dimension"]))
    known = {f.name for f in fields(ModelConfig)}
    return Settings(ModelConfig(**({f.name: getattr(base, f.name) for f in fields(ModelConfig)} | {k: v for k, v in model.items() if k in known})), Path(raw.get("data_dir", "~/.mnemospark")).expanduser())
