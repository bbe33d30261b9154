"""Settings: a call's own value, then the environment, then a file, then the default."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from . import schemas as S


class ConfigError(ValueError):
    """A value that cannot be read as its kind."""


DEFAULTS: dict[str, Any] = {"fusion.k_rrf": S.RRF_K, "fusion.graph_weight": S.GRAPH_WEIGHT, "rerank.top_k": S.RERANK_TOP_K, "rerank.min_coverage": S.RERANK_MIN_COVERAGE, "rerank.blend_curve": "0.75,0.6,0.4", "expand.enabled": False, "rerank.enabled": False, "graph.rank_curve": "linear", "graph.depth": 2, "queue.retention_days": S.RETENTION_DAYS}


def coerce(value: Any, like: Any) -> Any:
    try:
        if isinstance(like, bool):
            if isinstance(value, bool):
                return value
            if str(value).strip().lower() in ("1", "true", "yes", "on"):
                return True
            if str(value).strip().lower() in ("0", "false", "no", "off", ""):
                return False
            raise ValueError
        return type(like)(value) if like is not None else value
    except (TypeError, ValueError):
        raise ConfigError(f"{value!r} is no {type(like).__name__}") from None


def blend_curve(raw: str) -> tuple[float, float, float]:
    parts = [float(x) for x in raw.split(",")]
    if len(parts) != 3:
        raise ConfigError(f"a blend curve has 3 numbers, {raw!r} has {len(parts)}")
    return parts[0], parts[1], parts[2]


@dataclass
class Config:
    path: str | None = None
    prefix: str = "STRATASEEK_"
    aliases: dict[str, str] = field(default_factory=dict)  # older names of variables
    _file: dict[str, Any] | None = None

    def _read(self) -> dict[str, Any]:
        if self._file is None:
            self._file = {}
            if self.path and os.path.exists(self.path):
                with open(self.path, encoding="utf-8") as f:
                    text = f.read()
                try:
                    self._file = json.loads(text)
                except ValueError:
                    try:
                        import yaml
                    except ImportError:
                        raise ConfigError("only JSON can be read here") from None
                    self._file = yaml.safe_load(text) or {}
        return self._file

    def get(self, key: str, value: Any = None) -> Any:
        like = DEFAULTS[key]
        if value is not None:
            return coerce(value, like)
        name = self.prefix + key.upper().replace(".", "_")
        for n in (name, *(a for a, k in self.aliases.items() if k == key)):
            if n in os.environ:
                return coerce(os.environ[n], like)
        at: Any = self._read()
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return like if at is None else coerce(at, like)

    def get_all(self) -> dict[str, Any]:
        return {k: self.get(k) for k in DEFAULTS}

    def reload(self) -> None:
        self._file = None
