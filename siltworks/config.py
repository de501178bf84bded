"""Strict configurations: unknown keys are errors, quantities are checked when they are read."""

from __future__ import annotations

import dataclasses
import json
import re
from typing import Any


class EngineError(Exception):
    """Base of all errors of the engine."""


class ConfigurationError(EngineError, ValueError):
    """A configuration can't be used."""


class DataFormatError(EngineError, ValueError):
    """A record or dataset isn't in the format it claims."""


_UNITS = {"": 1, "K": 10**3, "M": 10**6, "B": 10**9, "T": 10**12}


def token_count(value: Any) -> int:
    """4_000, "100M", "1.5B": a positive whole number of tokens."""
    if isinstance(value, bool):
        raise ConfigurationError("a token count isn't a truth value")
    m = re.fullmatch(r"\s*([\d_]*\.?\d+)\s*([KMBT]?)\s*", str(value), re.I)
    if not m:
        raise ConfigurationError(f"not a token count: {value!r}")
    n = float(m[1].replace("_", "")) * _UNITS[m[2].upper()]
    if n != int(n) or n <= 0:
        raise ConfigurationError(f"not a positive whole number of tokens: {value!r}")
    return int(n)


def ratios(items: list[str]) -> dict[str, float]:
    """["web=0.5", ...] to {source: ratio}."""
    out: dict[str, float] = {}
    for item in items:
        name, sep, number = item.partition("=")
        if not sep or not name.strip():
            raise ConfigurationError(f"not SOURCE=RATIO: {item!r}")
        out[name.strip()] = float(number)
    return out


def build(kind: type, raw: dict[str, Any]) -> Any:
    """A dataclass from a mapping; unknown keys are an error, nested dataclasses are built too."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(raw) - set(fields):
        raise ConfigurationError(f"unknown keys of {kind.__name__}: {sorted(unknown)}")
    values = {k: build(f.default_factory, v) if isinstance(v, dict) and (f := fields[k]).default_factory is not dataclasses.MISSING and dataclasses.is_dataclass(f.default_factory) else v for k, v in raw.items()}
    return kind(**values)


@dataclasses.dataclass(frozen=True)
class Windows:
    size: int = 2046
    overlap: int = 128
    least: int = 32

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ConfigurationError("overlap must be below size")


@dataclasses.dataclass(frozen=True)
class Dedup:
    shingle: int = 13
    hashes: int = 128
    bands: int = 16
    similar: float = 0.8

    def __post_init__(self):
        if self.hashes % self.bands:
            raise ConfigurationError("hashes must be a multiple of bands")


@dataclasses.dataclass(frozen=True)
class Splits:
    train: float = 0.9
    validation: float = 0.05
    diagnostic: float = 0.05
    seed: int = 42

    def __post_init__(self):
        if abs(self.train + self.validation + self.diagnostic - 1) > 1e-9:
            raise ConfigurationError("split ratios must sum to 1")


@dataclasses.dataclass(frozen=True)
class Preparation:
    windows: Windows = dataclasses.field(default_factory=Windows)
    dedup: Dedup = dataclasses.field(default_factory=Dedup)
    splits: Splits = dataclasses.field(default_factory=Splits)
    target_tokens: int = 0

    def __post_init__(self):
        if self.target_tokens:
            object.__setattr__(self, "target_tokens", token_count(self.target_tokens))


def read(path: str) -> dict[str, Any]:
    """A mapping from a JSON file, or from YAML where its parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("reading YAML needs its parser; use JSON") from e
        raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ConfigurationError(f"{path} holds no mapping")
    return raw


def _one_of(name: str, value: Any, allowed: tuple) -> None:
    if value not in allowed:
        raise ConfigurationError(f"{name} must be one of {allowed}, not {value!r}")


def _at_least(name: str, value: float, least: float) -> None:
    if isinstance(value, bool) or value < least:
        raise ConfigurationError(f"{name} must be at least {least}")


@dataclasses.dataclass(frozen=True)
class Storage:
    """Where the splits of a dataset are. Parquet is the only format."""

    format: str = "parquet"
    train_path: str = ""
    validation_path: str | None = None
    verify_checksums: bool = False

    def __post_init__(self):
        _one_of("format", self.format.strip().lower(), ("parquet",))
        if not self.train_path:
            raise ConfigurationError("train_path is missing")

    def path_for(self, split: str) -> str:
        _one_of("split", split, ("train", "validation"))
        path = self.train_path if split == "train" else self.validation_path
        if not path:
            raise ConfigurationError(f"there is no path for {split}")
        return path


@dataclasses.dataclass(frozen=True)
class Sampling:
    strategy: str = "distributed"
    shuffle: bool = True
    seed: int = 42
    drop_last: bool = False
    pad_to_world_size: bool = True

    def __post_init__(self):
        _one_of("sampling strategy", self.strategy, ("distributed", "random", "sequential"))


@dataclasses.dataclass(frozen=True)
class Packing:
    enabled: bool = True
    strategy: str = "stream"
    max_seq_length: int = 4096
    pad_to_multiple_of: int = 1
    drop_last_remainder: bool = True

    def __post_init__(self):
        _one_of("packing strategy", self.strategy, ("stream", "sample_isolated"))
        _at_least("max_seq_length", self.max_seq_length, 1)
        _at_least("pad_to_multiple_of", self.pad_to_multiple_of, 1)


@dataclasses.dataclass(frozen=True)
class Batching:
    strategy: str = "fixed_length"
    micro_batch_size: int = 8
    pad_to_multiple_of: int = 1

    def __post_init__(self):
        _one_of("batching strategy", self.strategy, ("fixed_length", "padding_free", "preference_pair", "reward_pair", "trajectory"))
        _at_least("micro_batch_size", self.micro_batch_size, 1)
        _at_least("pad_to_multiple_of", self.pad_to_multiple_of, 1)


@dataclasses.dataclass(frozen=True)
class Data:
    """What a run reads, and how it samples, packs and batches it."""

    task: str
    dataset_id: str
    storage: Storage = dataclasses.field(default_factory=lambda: Storage(train_path="?"))
    sampling: Sampling = dataclasses.field(default_factory=Sampling)
    packing: Packing = dataclasses.field(default_factory=Packing)
    batching: Batching = dataclasses.field(default_factory=Batching)
    pad_id: int = 0

    @staticmethod
    def from_mapping(raw: dict[str, Any]) -> Data:
        parts = {"storage": Storage, "sampling": Sampling, "packing": Packing, "batching": Batching}
        if missing := {"task", "dataset_id", "storage"} - set(raw):
            raise ConfigurationError(f"missing keys: {sorted(missing)}")
        return build(Data, {k: build(parts[k], v) if k in parts else v for k, v in raw.items()})

    def check(self) -> Data:
        """Strategies must go with the task."""
        from siltworks.operators.tasks import task

        t = task(self.task)
        if self.packing.enabled and self.packing.strategy not in t.packing:
            raise ConfigurationError(f"{self.task} can't be packed by {self.packing.strategy}")
        if self.batching.strategy not in t.batching:
            raise ConfigurationError(f"{self.task} can't be batched as {self.batching.strategy}")
        return self


@dataclasses.dataclass(frozen=True)
class Conversations:
    """Conversation data: gates, quotas and holdout. A profile overrides single values and writes into a folder of its own."""

    output: str
    min_chars: int = 1
    max_chars: int = 200_000
    min_user_chars: int = 1
    min_assistant_tokens: int = 1
    max_assistant_tokens: int = 4096
    max_seq_length: int = 4096
    reasoning_ratio: float = 1.0
    validation_ratio: float = 0.05
    seed: int = 42
    quotas: dict = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        if not (0 <= self.reasoning_ratio <= 1 and 0 <= self.validation_ratio < 1):
            raise ConfigurationError("ratios lie between 0 and 1")
        if self.min_chars > self.max_chars or self.min_assistant_tokens > self.max_assistant_tokens:
            raise ConfigurationError("a lower bound is above its upper bound")

    @staticmethod
    def from_mapping(raw: dict[str, Any], profile: str | None = None) -> Conversations:
        base = {k: v for k, v in raw.items() if k != "profiles"}
        if profile is None:
            return build(Conversations, base)
        profiles = raw.get("profiles", {})
        if profile not in profiles:
            raise ConfigurationError(f"unknown profile {profile!r}, known are {sorted(profiles)}")
        merged = {**base, **profiles[profile]}
        if "output" not in profiles[profile]:
            merged["output"] = f"{base['output'].rstrip('/')}/{profile}"
        return build(Conversations, merged)


@dataclasses.dataclass(frozen=True)
class SourceSampling:
    """Sampling of raw sources to a total size."""

    target_total_gb: float
    sources: tuple = ()
    min_chars: int = 1
    max_chars: int = 200_000
    validation_fraction: float = 0.0
    seed: int = 42

    def __post_init__(self):
        if not self.target_total_gb > 0:
            raise ConfigurationError("target_total_gb must be positive")
        if not 0 <= self.validation_fraction < 1 or self.min_chars > self.max_chars:
            raise ConfigurationError("bounds don't fit")
        names = [str(s.get("name", "")).strip() for s in self.sources]
        if not names or "" in names or len(set(names)) < len(names):
            raise ConfigurationError("sources need distinct names")
        if any(not float(s.get("weight_gb", 0)) > 0 for s in self.sources):
            raise ConfigurationError("every source needs a positive weight_gb")

    @property
    def weights(self) -> dict[str, float]:
        return {s["name"].strip(): float(s["weight_gb"]) for s in self.sources}
