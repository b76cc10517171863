"""Settings: defaults, then a JSON file in the home folder, then one in the working folder, then the command line."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..operators.lexicon import INCLUDED


@dataclass(frozen=True)
class Config:
    data: str = "data"
    input_format: str = "raw"
    output_format: str = "tkn"
    strategy: str = "simple"
    lex_dist: int = 2
    phon_dist: int = 1
    post_rank_cutoff: int = 10
    dict_include: tuple = INCLUDED
    dict_exclude: tuple = ()
    nmd_cutoff: int = 30
    nmd_min_freq: int = 10
    nmd_min_length: int = 4
    nmd_pairs: int = 40000
    nmd_order: int = 2
    nmd_window: int = 3
    nmd_measure: str = "lin"
    dpb_num_sents: int | None = None
    lksm_num_tweets: int = 10_000_000
    lksm_eps: float = 0.01
    lksm_c: float = 1.0
    lksm_solver: str = "L2R_LR"
    lksm_num_candidates: int = 1
    lksm_use_score: bool = True
    lksm_negatives: str = "unseen"
    clean_filters: tuple = field(default=("english", "duplicates"))


def merged(base: dict, *others: dict) -> dict:
    """Nested dictionaries joined key by key; the last wins."""
    out = dict(base)
    for o in others:
        for k, v in o.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(overrides: dict | None = None, files: tuple[str, ...] = ("~/.plainword.json", "plainword.json")) -> Config:
    found = [json.loads(p.read_text()) for f in files if (p := Path(f).expanduser()).exists()]
    values = merged({}, *found, overrides or {})
    known = {f.name: f for f in fields(Config)}
    unknown = set(values) - set(known)
    if unknown:
        raise ValueError(f"no setting {sorted(unknown)[0]!r}")
    return replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
