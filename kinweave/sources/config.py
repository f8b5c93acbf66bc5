"""Configuration: typed defaults, overridden by a YAML file. Unknown keys are refused."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from kinweave.operators.clustering import ClusterConfig
from kinweave.operators.refine import RefineConfig
from kinweave.operators.thresholds import ThresholdConfig


@dataclass(frozen=True)
class DetectionConfig:
    det_thresh: float = 0.5
    max_faces: int = 50
    det_size: tuple[int, int] = (640, 640)


@dataclass(frozen=True)
class QualityConfig:
    min_face_size: int = 40
    blur_threshold: float = 50.0
    max_pose_angle: float = 75.0
    gate: float = 0.2


@dataclass(frozen=True)
class EmbeddingConfig:
    #: What vectors must have; None takes what the model gives.
    dimension: int | None = None
    use_flip: bool = True
    num_perturbations: int = 2
    rotation_range: float = 5.0
    scale_jitter: float = 0.05


@dataclass(frozen=True)
class ReducerConfig:
    #: none, pca or umap; the last two settings are umap's.
    kind: str = "none"
    n_components: int = 50
    n_neighbors: int = 15
    min_dist: float = 0.0


@dataclass(frozen=True)
class IdentityConfig:
    enabled: bool = True
    classification_threshold: float = 0.4
    merge_threshold: float = 0.3


@dataclass(frozen=True)
class EngineConfig:
    input_dir: str = "./photos"
    output_dir: str = "./output"
    recursive: bool = True
    save_crops: bool = True
    detection: DetectionConfig = field(default_factory=DetectionConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    reducer: ReducerConfig = field(default_factory=ReducerConfig)
    clustering: ClusterConfig = field(default_factory=ClusterConfig)
    adaptive_threshold: ThresholdConfig = field(default_factory=ThresholdConfig)
    refinement: RefineConfig = field(default_factory=RefineConfig)
    identities: IdentityConfig = field(default_factory=IdentityConfig)


def build(base: Any, changes: dict) -> Any:
    """base (a dataclass) with changes merged into it, level by level."""
    known = {f.name: getattr(base, f.name) for f in dataclasses.fields(base)}
    new = {}
    for key, value in changes.items():
        if key not in known:
            raise ValueError(f"unknown setting {key!r} in {type(base).__name__}")
        old = known[key]
        new[key] = build(old, value or {}) if dataclasses.is_dataclass(old) else tuple(value) if isinstance(old, tuple) else value
    return dataclasses.replace(base, **new)


def load(path: str | None = None) -> EngineConfig:
    """Defaults, overridden by the file if there is one."""
    if path is None or not Path(path).exists():
        return EngineConfig()
    import yaml

    return build(EngineConfig(), yaml.safe_load(Path(path).read_text()) or {})


def save(config: EngineConfig, path: str) -> None:
    import yaml

    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else list(x) if isinstance(x, tuple) else x
    Path(path).write_text(yaml.safe_dump(plain(dataclasses.asdict(config)), sort_keys=False))
