"""Settings: dataclasses with defaults, merged from nested dictionaries (as JSON files give them); unknown keys are errors."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Retrieval:
    k: int = 10
    rerank_depth: int = 50
    rrf_constant: int = 60
    statement_bonus: float = 0.1
    min_n_rows: int = 0
    recall_max_add: int = 4
    recall_weight: float = 0.5


@dataclass
class Answering:
    score_min: float = 0.5
    tolerance: float = 0.01
    max_program_chars: int = 4000
    default_answer: float = 0.0


@dataclass
class Quirks:
    """Behaviours that can be chosen: what counts as a repeat of a code, and what identifies a row without code."""

    blank_code_by_label: bool = True
    use_number_format: bool = True


@dataclass
class Config:
    data_dir: str = "data"
    derived_dir: str = "derived"
    retrieval: Retrieval = field(default_factory=Retrieval)
    answering: Answering = field(default_factory=Answering)
    quirks: Quirks = field(default_factory=Quirks)


def merge(base: dict, over: dict) -> dict:
    """over in base, dictionaries within them merged in turn."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def build(values: dict, kind: type = Config):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    default = kind()
    return kind(**{k: build(v, type(getattr(default, k))) if dataclasses.is_dataclass(getattr(default, k)) else v for k, v in values.items()})


def load(*paths: str | Path) -> Config:
    """Later files override earlier ones."""
    values: dict = {}
    for p in paths:
        values = merge(values, json.loads(Path(p).read_text(encoding="utf-8")))
    return build(values)
