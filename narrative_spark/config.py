"""Settings of a run: explicit values win over the environment, which is read when asked."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    model: str = ""
    fallback_length: int = 3000
    chapter_length: int = 6000
    passage_chars: int = 5000
    top_n: int = 15
    api_key: str = field(default="", repr=False)  # never shown

    @classmethod
    def load(cls, environment: Callable[[str], str | None] = os.environ.get, **given) -> "Settings":
        """Fields that aren't given come from ``NARRATIVE_<FIELD>``, else from the defaults."""
        values = {}
        for name, one in cls.__dataclass_fields__.items():
            if given.get(name) is not None:
                values[name] = given[name]
            elif (found := environment(f"NARRATIVE_{name.upper()}")) not in (None, ""):
                values[name] = int(found) if one.type == "int" else found
        return cls(**values)

    def require_key(self) -> str:
        """The key of the model's service; without one no call can be made, which is an error at once."""
        if not self.api_key.strip():
            raise RuntimeError("no key for the model's service: give api_key or set NARRATIVE_API_KEY")
        return self.api_key.strip()
