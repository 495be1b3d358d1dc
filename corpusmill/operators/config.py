"""Checks and overrides of training configurations, on the driver."""

from __future__ import annotations

from copy import deepcopy
from pathlib import Path
from typing import Any

# The keys a configuration needs, and where each override goes.
REQUIRED = ("base_model", "lora", "output_dir", "stage", "train_file", "training")
TOP_LEVEL = ("base_model", "train_file", "eval_file", "output_dir", "init_adapter")
IN_TRAINING = ("max_steps", "resume_from_checkpoint")


class ConfigError(ValueError):
    """A configuration that is incomplete or contradicts itself."""


def validate(config: Any) -> None:
    if not isinstance(config, dict):
        raise ConfigError("the root of a configuration must be an object")
    if missing := [k for k in REQUIRED if k not in config]:
        raise ConfigError(f"missing keys: {', '.join(missing)}")
    stage, training = config["stage"], config["training"]
    if stage not in ("cpt", "sft"):
        raise ConfigError("stage must be cpt or sft")
    if stage == "sft":
        modes = [m for m in ("assistant_only_loss", "completion_only_loss") if training.get(m)]
        if len(modes) != 1:
            raise ConfigError("sft needs exactly one of assistant_only_loss and completion_only_loss")
        if modes == ["completion_only_loss"] and not training.get("prompt_completion"):
            raise ConfigError("completion_only_loss needs prompt_completion")


def load(path: str | Path) -> dict[str, Any]:
    """A configuration from YAML, or from JSON where no YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8-sig")
    try:
        import yaml
    except ImportError:
        import json

        config = json.loads(text)
    else:
        config = yaml.safe_load(text)
    validate(config)
    return config


def overridden(config: dict[str, Any], **changes: Any) -> dict[str, Any]:
    """A copy with `changes`. Empty values change nothing, but `max_steps` may be 0."""
    if unknown := set(changes) - {*TOP_LEVEL, *IN_TRAINING}:
        raise ConfigError(f"unknown overrides: {', '.join(sorted(unknown))}")
    out = deepcopy(config)
    for name, value in changes.items():
        if value or (name == "max_steps" and value is not None):
            (out["training"] if name in IN_TRAINING else out)[name] = value
    return out


def verified_model(config: dict[str, Any], marker: str = "VERIFIED.sha256") -> Path:
    """The local model folder, which must hold the marker of a finished verification."""
    folder = Path(str(config["base_model"])).expanduser()
    for path in (folder, folder / marker):
        if not path.exists():
            raise FileNotFoundError(f"no verified base model: {path} is missing")
    return folder


def effective_batch(world_size: int, per_device: int, accumulation: int) -> int:
    return world_size * per_device * accumulation


def sampling_strategy(group_by_length: bool) -> str:
    return "group_by_length" if group_by_length else "random"
