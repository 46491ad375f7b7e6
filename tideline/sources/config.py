"""Configuration files."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

try:
    import yaml
except ImportError:  # an optional dependency of the command line only
    yaml = None


def load_config(path: str, required: Iterable[str] = ()) -> dict:
    """A YAML mapping with the required keys; anything else is a ValueError."""
    if yaml is None:
        raise ValueError("reading YAML needs PyYAML")
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path} isn't a mapping")
    missing = sorted(set(required) - set(data))
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return data


def load_settings(config_path: str, topics_path: str, required: Iterable[str] = ()) -> tuple[dict, dict]:
    """A configuration and a taxonomy {category: {keywords: [...]}}; categories are named by letters, digits and
    underscores. Anything else is a ValueError."""
    settings, topics = load_config(config_path, required), load_config(topics_path)
    if not topics:
        raise ValueError(f"{topics_path} has no categories")
    for name, topic in topics.items():
        if not isinstance(name, str) or not re.fullmatch(r"\w*[^\W_]\w*", name):
            raise ValueError(f"{name!r} can't name a category")
        if not isinstance(topic, dict) or not isinstance(topic.get("keywords"), list):
            raise ValueError(f"{name} needs a list of keywords")
    return settings, topics


def bounded(settings: Mapping, key: str, default: float, least: float, most: float = math.inf, whole: bool = False) -> float:
    """The number at ``key``, or the default: finite, from ``least`` to ``most``, and an integer if ``whole``."""
    value = settings.get(key, default)
    kinds = int if whole else int | float
    if isinstance(value, bool) or not isinstance(value, kinds) or not math.isfinite(value) or not least <= value <= most:
        raise ValueError(f"{key} must be {'an integer' if whole else 'a number'} from {least} to {most}, not {value!r}")
    return value if whole else float(value)
