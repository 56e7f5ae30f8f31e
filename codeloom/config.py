"""The project file: which source trees, how they are read, where results go."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

FILE = "codeloom.yaml"


@dataclass
class Project:
    name: str
    path: str
    framework: str | None = None
    ignore: list[str] = field(default_factory=list)


@dataclass
class Config:
    projects: list[Project]
    output: str = ".codeloom"
    wiki: bool = True
    vault: bool = False
    context_map: list[str] = field(default_factory=list)
    doc_references: bool = False


def find(start: str | Path) -> Path | None:
    """The project file in a folder or the nearest one above."""
    at = Path(start).resolve()
    return next((p / FILE for p in (at, *at.parents) if (p / FILE).is_file()), None)


def load(path: str | Path) -> Config:
    """Read a project file; its version is 1, it names at least one project, relative paths start at its folder."""
    path = Path(path)
    said = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if said.get("version") != 1:
        raise ValueError(f"{path}: version must be 1")
    if not said.get("projects"):
        raise ValueError(f"{path}: at least one project is needed")
    base = path.resolve().parent
    projects = [Project(p.get("name") or Path(p["path"]).name, str((base / p["path"]).resolve()), p.get("type"), list(p.get("ignore") or [])) for p in said["projects"]]
    output = said.get("output") or {}
    return Config(projects, str((base / output.get("dir", ".codeloom")).resolve()), bool(output.get("wiki", True)), bool(output.get("vault", False)), list(output.get("context_map") or []), bool((said.get("semantic") or {}).get("enabled", False)))


def write(path: str | Path, projects: list[Project]) -> None:
    Path(path).write_text(yaml.safe_dump({"version": 1, "projects": [{"name": p.name, "path": p.path} | ({"type": p.framework} if p.framework else {}) for p in projects]}, sort_keys=False), encoding="utf-8")
