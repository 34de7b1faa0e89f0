"""Run configuration: plain Python, no Spark."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class RunConfig:
    run_id: str = "run"
    model_name: str = ""
    mode: str = "memory-free"
    rollouts: int = 4
    concurrency: int = 8
    metric: str = "brier"
    question_start: int | None = None
    question_end: int | None = None

    @classmethod
    def from_dict(cls, values: dict, **overrides) -> RunConfig:
        """Known keys of ``values``; overrides that are not None win; unknown keys raise."""
        names = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(values) - names:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**(values | {k: v for k, v in overrides.items() if v is not None}))

    @classmethod
    def load(cls, path: str, **overrides) -> RunConfig:
        """From a JSON file, or YAML where a YAML reader is installed."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {}, **overrides)
        return cls.from_dict(json.loads(text), **overrides)


def prompt_source(explicit: str | None, variant: str | None, shared: str | None) -> str | None:
    """The first of an explicit prompt, the variant's and the shared one."""
    return next((p for p in (explicit, variant, shared) if p), None)
