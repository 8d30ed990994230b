"""Configuration from properties text and command-line pairs; errors with codes."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from enum import Enum

from tidemark.operators.namespace import split_rules


class ErrorCode(Enum):
    CONFIG = "TM_CONFIG"
    CONNECT = "TM_CONNECT"
    CAPTURE = "TM_CAPTURE"
    HISTORY_LOST = "TM_HISTORY_LOST"
    WRITE = "TM_WRITE"
    STATE = "TM_STATE"
    VERIFY = "TM_VERIFY"


class MigrationError(Exception):
    def __init__(self, code: ErrorCode, message: str):
        super().__init__(f"{code.value}: {message}")
        self.code = code


#: Keys of other engines' configurations that have no counterpart here, and what does their work. They are accepted, and
#: kept in ``SyncConfig.unused``.
NO_COUNTERPART = {
    "buckets": "Spark's shuffle partitions",
    "batch_size": "files or bytes of a trigger, given to the stream",
    "range_mb": "spark.sql.files.maxPartitionBytes",
    "queue_capacity": "what lands waits in the folder",
    "writer_threads": "executor cores",
}


@dataclass
class SyncConfig:
    source_path: str = ""
    target_path: str = ""
    mode: str = "FULL_AND_INCREMENTAL"
    capture_mode: str = "AUTO"
    write_mode: str = "UPSERT"
    on_conflict: str = "FAIL"
    white: list[str] = field(default_factory=list)
    black: list[str] = field(default_factory=list)
    transform: dict[str, str] = field(default_factory=dict)
    commit_max_lag_ms: int = 10_000
    verify_samples: int = 50
    ignore_fields: list[str] = field(default_factory=list)
    dead_letters: str = ""
    unused: dict[str, str] = field(default_factory=dict)

    def validate(self) -> SyncConfig:
        if self.white and self.black:
            raise MigrationError(ErrorCode.CONFIG, "white and black exclude each other")
        for name, allowed in (("mode", ("FULL", "INCREMENTAL", "FULL_AND_INCREMENTAL")), ("capture_mode", ("AUTO", "OPLOG", "CHANGE_STREAM")), ("write_mode", ("UPSERT", "STRICT")), ("on_conflict", ("FAIL", "SKIP", "UPSERT"))):
            if getattr(self, name) not in allowed:
                raise MigrationError(ErrorCode.CONFIG, f"{name} must be one of {', '.join(allowed)}")
        if min(self.commit_max_lag_ms, self.verify_samples) < 1:
            raise MigrationError(ErrorCode.CONFIG, "commit_max_lag_ms and verify_samples must be positive")
        return self


def parse_properties(text: str) -> dict[str, str]:
    """``key=value`` or ``key: value`` lines; # and ! begin comments."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            cut = min((k for k in (line.find("="), line.find(":")) if k >= 0), default=len(line))
            out[line[:cut].strip()] = line[cut + 1 :].strip()
    return out


def load(text: str = "", arguments: list[str] = ()) -> SyncConfig:
    """A configuration from properties text, then ``--key=value`` arguments over it; dots and dashes in keys are underscores."""
    pairs = parse_properties(text) | dict(a[2:].split("=", 1) for a in arguments if a.startswith("--") and "=" in a)
    known = {f.name: f for f in fields(SyncConfig) if f.name != "unused"}
    values = {"unused": {}}
    for key, value in pairs.items():
        name = key.replace(".", "_").replace("-", "_")
        if name in NO_COUNTERPART:
            values["unused"][name] = NO_COUNTERPART[name]
            continue
        if name not in known:
            raise MigrationError(ErrorCode.CONFIG, f"unknown key {key}")
        kind = str(known[name].type)
        try:
            if kind == "int":
                values[name] = int(value)
            elif kind.startswith("list"):
                values[name] = split_rules(value.replace(",", ";") if name == "ignore_fields" else value)
            elif kind.startswith("dict"):
                values[name] = {a.strip(): b.strip() for a, b in (rule.split(":", 1) for rule in split_rules(value))}
            else:
                values[name] = value
        except ValueError:
            raise MigrationError(ErrorCode.CONFIG, f"{key} can't be {value!r}") from None
    return SyncConfig(**values).validate()
