"""Options of the chat-record plan, with their defaults, and where they may be set beside the call: the environment and a file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "MILLRACE_"


def environment(file: str = ".env", env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """The environment, and below it what a file of NAME=value lines says; blank lines and those that begin with # say nothing."""
    said: dict[str, str] = {}
    path = Path(file)
    for line in path.read_text().splitlines() if path.is_file() else ():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            said[name.strip()] = value.strip().strip("\"'")
    return {**said, **env}


def _read(kind: str, value: str) -> bool | int | float:
    if kind == "bool":
        if value.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"{value!r} is neither true nor false")
        return value.lower() in ("1", "true", "yes", "on")
    return int(value) if kind == "int" else float(value)


@dataclass(frozen=True)
class ChatConfig:
    allow_llm: bool = False  # accepted; undocumented code is never labelled by a model
    max_tokens: int = 4096
    min_tokens: int = 48
    file_cap: int = 15
    md_max_questions: int = 4
    md_window_tokens: int = 800
    md_overlap_tokens: int = 120
    md_max_windows: int = 0  # of a section; 0: all of it
    py_chunking: bool = True
    py_chunk_max: int = 5
    py_chunk_min_lines: int = 6
    include_validation: bool = True
    include_errors: bool = True
    include_config: bool = True
    include_logging: bool = True
    valid_ratio: float = 0.1
    seed: int = 17
    prune_excluded: bool = False

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> ChatConfig:
        """Defaults, but for fields that a variable of their name sets, such as MILLRACE_MAX_TOKENS."""
        env = environment() if env is None else env
        return cls(**{f.name: _read(str(f.type), env[PREFIX + f.name.upper()]) for f in fields(cls) if env.get(PREFIX + f.name.upper())})


@dataclass(frozen=True)
class ClusterConfig:
    min_cluster_size: int = 5
    min_samples: int = 3
