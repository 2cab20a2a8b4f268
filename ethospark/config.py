"""Settings as one immutable value, and the readers of configuration files.

Readers run on the driver: a configuration is one small file. Defaults are those of batch processing and analytics.
"""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, fields, replace

import yaml


@dataclass(frozen=True)
class Settings:
    clips_dir: str = "clips"
    input_dir: str = "input"
    output_dir: str = "output"
    primary_static_classes: tuple[str, ...] = ()
    primary_motion_classes: tuple[str, ...] = ()
    secondary_static_classes: tuple[str, ...] = ()
    secondary_motion_classes: tuple[str, ...] = ()
    ignore_secondary: tuple[str, ...] = ()
    dominant_source: str = "confidence"
    strategy: str = "exponential"
    expA: float = 0.5
    expB: float = 0.8
    lum_weight: float = 0.7
    rgb_multipliers: tuple[float, float, float] = (2.0, 2.0, 2.0)
    motion_threshold: int = 0
    chromatic_tail_only: bool = False
    scale_factor: float = 1.0
    frame_skip: int = 0
    primary_conf_thresh: float = 0.5
    secondary_conf_thresh: float = 0.5
    match_distance_thresh: float = 200.0
    delete_after_missed: float = 5.0
    centroid_merge_thresh: float = 50.0
    iou_thresh: float = 0.95
    process_noise_pos: float = 0.01
    process_noise_vel: float = 0.1
    measurement_noise: float = 0.1
    val_frequency: float = 0.1
    motion_blocks_static: bool = False
    static_blocks_motion: bool = False
    save_empty_frames: bool = False
    ab_min_presence_ratio: float = 0.10
    ab_border_zone_ratio: float = 0.15
    ab_group_type_separator: str = "_"
    ab_group_type_field_index: int = 4
    ab_analysis_duration_s: float = 0.0

    def __post_init__(self):
        if self.strategy not in ("exponential", "sequential"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.dominant_source not in ("confidence", "static", "motion"):
            raise ValueError(f"unknown dominant_source {self.dominant_source!r}")

    @property
    def hierarchical(self) -> bool:
        return len(self.secondary_static_classes) > 1 or len(self.secondary_motion_classes) > 1

    def updated(self, **changes) -> Settings:
        """The same settings with some changed; nothing that isn't named is lost."""
        return replace(self, **changes)


def listed(value: str | None) -> tuple[str, ...]:
    """A comma list; blank entries and a lone ``0`` mean none."""
    items = tuple(x.strip() for x in (value or "").split(",") if x.strip())
    return () if items == ("0",) else items


def read_ini(path: str) -> Settings:
    """Settings of an INI file; keys keep their case, absent ones their defaults, a single secondary class is none."""
    parser = configparser.ConfigParser()
    parser.optionxform = str
    if not parser.read(path):
        raise FileNotFoundError(path)
    raw = dict(parser["DEFAULT"]) | {k: v for s in parser.sections() for k, v in parser[s].items()}
    made: dict = {}
    for f in fields(Settings):
        if (value := raw.get(f.name)) is None:
            continue
        default = f.default
        if isinstance(default, bool):
            made[f.name] = value.strip().lower() == "true"
        elif f.name == "rgb_multipliers":
            made[f.name] = tuple(float(x) for x in value.split(","))
        elif isinstance(default, tuple):
            made[f.name] = listed(value)
        else:
            made[f.name] = type(default)(value)
    for key in ("secondary_static_classes", "secondary_motion_classes"):
        if len(made.get(key, ())) == 1:
            made[key] = ()
    return Settings(**made)


def read_class_map(path: str) -> dict[str, int]:
    """Class names of a dataset file, by index."""
    with open(path, encoding="utf-8") as f:
        names = (yaml.safe_load(f) or {}).get("names") or []
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return {str(n): int(i) for i, n in pairs}


def write_dataset_yaml(path: str, train: str, val: str, classes: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"train": train, "val": val, "nc": len(classes), "names": list(classes)}, f, sort_keys=False)


def resolve_path(project: str, value: str | None, fallback: str) -> str:
    """Blank: the fallback in the project; absolute: kept; else joined to the project."""
    value = (value or "").strip() or fallback
    return os.path.normpath(value if os.path.isabs(value) else os.path.join(project, value))


#: Characters that no project name may have.
DISALLOWED = '<>:"/\\|?*'


def project_problems(name: str, taken: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a new project's name; nothing: an empty list."""
    out = [] if name.strip() else ["the name is blank"]
    out += [f"{c!r} is not allowed" for c in DISALLOWED if c in name]
    return out + (["the name is taken"] if name.strip().lower() in {t.lower() for t in taken} else [])


def class_problems(s: Settings) -> list[str]:
    """At least one primary class; secondary classes are none or at least two of a kind."""
    out = [] if s.primary_static_classes or s.primary_motion_classes else ["there is no primary class"]
    for kind, classes in (("static", s.secondary_static_classes), ("motion", s.secondary_motion_classes)):
        if len(classes) == 1:
            out.append(f"a single secondary {kind} class")
    return out
