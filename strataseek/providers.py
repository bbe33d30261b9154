"""Hooks for outside models: expansion, reranking, extraction, confirmation.

No provider ships here. A hook is any callable; what it returns is checked, and what
fails is handled by mode.
"""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger(__name__)
MODES = ("warn", "silent", "error")


class NotConfigured(RuntimeError):
    """A stage was asked for and has no provider."""


class ExtractionFailed(RuntimeError):
    """Two answers in a row could not be read."""


@dataclass
class Registry:
    hooks: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def is_configured(self, stage: str) -> bool:
        return stage in self.hooks

    def enabled(self, stage: str, asked: bool | None) -> bool:
        """None and False are off; True without a provider warns and is off."""
        if asked and not self.is_configured(stage):
            log.warning("%s was asked for, but no provider is set", stage)
        return bool(asked) and self.is_configured(stage)

    def call(self, stage: str, *args: Any, mode: str = "warn", default: Any = None, **more: Any) -> Any:
        if stage not in self.hooks:
            raise NotConfigured(stage)
        try:
            return self.hooks[stage](*args, **more)
        except Exception as e:
            if mode == "error":
                raise
            if mode == "warn":
                log.warning("%s failed: %s", stage, e)
            return default


class Retry(Exception):
    def __init__(self, after: float | None = None):
        super().__init__("try again")
        self.after = after


def with_retry(call: Callable[[], Any], tries: int = 3, wait: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls again after Retry: as long as it says, up to ``most``, or else doubling."""
    for n in range(tries):
        try:
            return call()
        except Retry as e:
            if n == tries - 1:
                raise
            sleep(min(e.after, most) if e.after is not None else wait * 2**n)


def parse_json(answer: str) -> Any:
    """JSON from a model's answer, in a code fence or bare."""
    m = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    return json.loads((m[1] if m else answer).strip())


def variants(raw: Any, query: str) -> dict[str, Any]:
    """A checked expansion: up to five more queries, a text to embed, perhaps an answer."""
    if not isinstance(raw, dict):
        return {"lex": [], "vec": query, "hyde": None}
    lex = [x for x in raw.get("lex") or [] if isinstance(x, str) and x.strip() and x != query]
    vec = raw.get("vec")
    hyde = raw.get("hyde")
    return {"lex": list(dict.fromkeys(lex))[:5], "vec": vec if isinstance(vec, str) and vec.strip() else query, "hyde": hyde if isinstance(hyde, str) and hyde.strip() else None}


def extract(hook: Callable[[str], Any], content: str) -> tuple[list[dict], list[dict]]:
    for _ in range(2):
        try:
            made = hook(content)
            return list(made["entities"]), list(made["relations"])
        except (KeyError, TypeError, ValueError):
            continue
    raise ExtractionFailed(content[:80])
