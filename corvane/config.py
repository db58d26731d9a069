"""Job settings: YAML documents checked on the driver before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml


def load_yaml(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


@dataclass(frozen=True)
class SplitRatios:
    train: float
    val: float
    test: float

    def __post_init__(self):
        total = self.train + self.val + self.test
        if abs(total - 1.0) > 1e-6:
            raise ValueError(f"split ratios must sum to 1, not {total}")

    @property
    def val_of_rest(self) -> float:
        return self.val / (self.val + self.test)


@dataclass(frozen=True)
class DatasetConfig:
    dataset_name: str
    raw_root: str
    processed_root: str
    manifest_dir: str
    audit_dir: str
    seed: int
    split: SplitRatios
    image_extensions: tuple[str, ...]
    class_map: dict[str, str]
    copy_mode: str = "hardlink"
    overwrite_processed: bool = False
    exclude_cross_class_duplicates: bool = True

    @classmethod
    def from_dict(cls, raw: dict) -> DatasetConfig:
        known = {k: raw[k] for k in cls.__dataclass_fields__ if k in raw}
        ratios = {k: float(v) for k, v in raw["split"].items()}
        out = cls(**known | {"split": SplitRatios(**ratios), "seed": int(raw["seed"]), "image_extensions": tuple(x.lower() for x in raw["image_extensions"])})
        if out.copy_mode not in ("hardlink", "copy"):
            raise ValueError(f"unsupported copy_mode: {out.copy_mode}")
        return out

    @property
    def class_to_idx(self) -> dict[str, int]:
        """Indexes by first mention; codes may share a name."""
        return {name: i for i, name in enumerate(dict.fromkeys(self.class_map.values()))}


@dataclass(frozen=True)
class EnsembleConfig:
    ensemble_name: str
    output_root: str
    class_to_idx: str
    manifest_dir: str
    members: list[dict] = field(default_factory=list)

    @classmethod
    def from_dict(cls, raw: dict) -> EnsembleConfig:
        out = cls(**{k: raw[k] for k in cls.__dataclass_fields__ if k in raw})
        for m in out.members:
            if "REPLACE_WITH" in str(m["run_dir"]):
                raise ValueError("a member's run_dir is still a placeholder")
        return out

    @property
    def weights(self) -> list[float]:
        return [float(m.get("weight", 1.0)) for m in self.members]


#: The names that training settings have in a document, and here.
FIT_NAMES = {
    "epochs": "epochs", "lr": "lr", "optimizer": "optimizer", "weight_decay": "weight_decay", "scheduler": "scheduler",
    "label_smoothing": "smoothing", "class_weighted_loss": "weighted", "early_stopping_patience": "patience", "best_metric": "best_metric",
    "steps": "steps",
}


@dataclass(frozen=True)
class TrainConfig:
    run_name: str
    processed_root: str
    manifest_dir: str
    class_to_idx: str
    output_root: str
    seed: int
    fit: dict
    features: str = "bytes"

    @classmethod
    def from_dict(cls, raw: dict) -> TrainConfig:
        given, data = raw["train"], raw["dataset"]
        fit = {FIT_NAMES[k]: v for k, v in given.items() if k in FIT_NAMES}
        for k in ("lr", "weight_decay", "smoothing"):
            if k in fit:
                fit[k] = float(fit[k])
        return cls(
            raw["run_name"], data["processed_root"], data["manifest_dir"], data["class_to_idx"], raw["output_root"], int(raw["seed"]), fit,
            raw.get("model", {}).get("features", "bytes"),
        )


def check_inference_arguments(images: list[str], run_dir: str | None, ensemble: str | None, top_k: int) -> None:
    if not images:
        raise ValueError("give an image or a folder of images")
    if not (run_dir or ensemble):
        raise ValueError("give a run folder or an ensemble configuration")
    if top_k < 1:
        raise ValueError("top_k is 1 at least")
