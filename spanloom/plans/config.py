"""Configuration and logging: defaults, local file, dotenv, environment; JSON lines on a stream."""

from __future__ import annotations

import json
import logging
import os
import sys
from pathlib import Path

PREFIX = "SPANLOOM__"


def _merge(into: dict, new: dict) -> dict:
    for k, v in new.items():
        into[k] = _merge(dict(into[k]), v) if isinstance(v, dict) and isinstance(into.get(k), dict) else v
    return into


def _file(path: Path) -> dict:
    if not path.is_file():
        return {}
    if path.suffix == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    import yaml  # optional: only YAML files need it

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def dotenv(path: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines and quotes around a value are dropped."""
    out = {}
    where = Path(path)
    for line in where.read_text(encoding="utf-8").splitlines() if where.is_file() else ():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out


def _typed(value: str, old):
    """An entry of the environment in the type of what it replaces."""
    if isinstance(old, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(old, (int, float)):
        return type(old)(value)
    return json.loads(value) if isinstance(old, (list, dict)) else value


def load(defaults: dict, folder: str | None = None, env: dict | None = None, env_file: str | None = None, prefix: str = PREFIX, local: bool = True) -> dict:
    """Defaults, then default and local files of a folder, then dotenv, then the environment, where
    PREFIX__SECTION__KEY names a nested entry."""
    out = json.loads(json.dumps(defaults))
    for name in ("default", *(["local"] if local else [])):
        for end in (".yaml", ".json"):
            if folder:
                out = _merge(out, _file(Path(folder) / f"{name}{end}"))
    for k, v in {**(dotenv(env_file) if env_file else {}), **(os.environ if env is None else env)}.items():
        if k.startswith(prefix):
            node, *path = [out, *k[len(prefix) :].lower().split("__")]
            for part in path[:-1]:
                node = node.setdefault(part, {})
            node[path[-1]] = _typed(v, node.get(path[-1]))
    return out


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"level": record.levelname, "logger": record.name, "message": record.getMessage(), "time": self.formatTime(record), **getattr(record, "fields", {})}
        return json.dumps({**row, **({"error": self.formatException(record.exc_info)} if record.exc_info else {})}, default=str)


def configure_logging(level: str = "INFO", stream=None) -> logging.Logger:
    """The library's logger with one JSON handler, however often it is called."""
    log, handler = logging.getLogger("spanloom"), logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonLines())
    log.handlers, log.propagate = [handler], False
    log.setLevel(level.upper())
    return log


def trace(log: logging.Logger, stage: str, **fields) -> None:
    """One event of a stage."""
    log.info(stage, extra={"fields": {"stage": stage, **fields}})
