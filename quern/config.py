"""Settings of an engine, from arguments or environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass
class Settings:
    """``repo_name`` defaults to the folder's name; lists are given with commas."""

    repo_path: str = "."
    repo_name: str | None = None
    storage_path: str | None = None
    include_dirs: tuple[str, ...] = ()
    encoder: str = "hash"
    dimensions: int = 768
    collection: str = "code_embeddings"
    debounce_seconds: float = 5.0
    watch: bool = True
    class_hash: str = "header"
    log_level: str = "INFO"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        path = Path(self.repo_path)
        if not path.exists():
            raise ValueError(f"no such path: {self.repo_path}")
        if not path.is_dir():
            raise ValueError(f"not a folder: {self.repo_path}")
        self.repo_path = str(path.resolve())
        self.repo_name = self.repo_name or Path(self.repo_path).name
        self.storage_path = self.storage_path or str(Path(self.repo_path) / ".embeddings")
        if isinstance(self.include_dirs, str):
            self.include_dirs = tuple(x.strip() for x in self.include_dirs.split(",") if x.strip())
        self.log_level = self.log_level.upper()
        if self.log_level not in LEVELS:
            raise ValueError(f"log level must be one of {', '.join(LEVELS)}")
        if self.dimensions < 1 or self.debounce_seconds < 0:
            raise ValueError("dimensions and debounce must be positive")

    @classmethod
    def from_environment(cls, **given) -> "Settings":
        """Settings from variables named as the fields in upper case; arguments win."""
        found = {}
        for f in fields(cls):
            value = os.environ.get(f.name.upper())
            if value is not None and f.name != "extra":
                kind = type(f.default)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value) if kind in (int, float) else value
        return cls(**(found | given))
