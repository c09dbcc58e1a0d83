"""Settings: defaults, overridden by the first YAML file there is and by the environment."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from ravelin.functions import rules


@dataclass(frozen=True)
class Endpoint:
    host: str = "127.0.0.1"
    port: int = 0


@dataclass(frozen=True)
class Retrieval:
    """Retrieval settings. None for max_per_file, mmr_lambda or max_chunks_per_file means off; 0 means the default, as it always did."""

    embed_model: str = "hashed"
    rerank_pool: int = 12
    context_chunks: int = 8
    chunk_size: int = 1500
    chunk_overlap: int = 150
    max_chunks_per_file: int | None = 50
    min_score: float = 0.30
    rrf_constant: float = 60.0
    fts_weight: float = 2.0
    fts_tech_weight: float = 5.0
    reranker_timeout_ms: int = 500
    #: Approximate vector search from so many vectors on, if approximate is set: the exact search is one scan either way.
    ann_threshold: int = 2000
    approximate: bool = False
    max_per_file: int | None = 2
    mmr_lambda: float | None = 0.7
    core_file_patterns: tuple[str, ...] = ()
    ignored_dirs: tuple[str, ...] = tuple(rules.IGNORED_DIRECTORIES)
    ignored_file_patterns: tuple[str, ...] = ()
    technical_terms: tuple[str, ...] = tuple(rules.TECHNICAL_TERMS)
    stop_words: tuple[str, ...] = tuple(rules.STOP_WORDS)
    #: "reference": of the full-text hits those with the weakest match rank first; "best_first": the strongest.
    fts_rank_order: str = "reference"
    #: Whether a term with signs that the full-text syntax doesn't allow makes its stage fail, or is split at them.
    strict_fts: bool = True
    word_boundary_small_talk: bool = False


@dataclass(frozen=True)
class Config:
    model: Endpoint = Endpoint(port=11434)
    reranker: Endpoint = Endpoint(port=8765)
    web: Endpoint = Endpoint(port=8080)
    retrieval: Retrieval = field(default_factory=Retrieval)


#: Names of the settings in a file, where they differ.
SECTIONS = {"ollama": "model", "model": "model", "reranker": "reranker", "web": "web", "rag": "retrieval", "search_rules": "retrieval"}
NAMES = {"hnsw_threshold": "ann_threshold"}
#: Settings for which a zero in a file is a value.
ZERO_COUNTS = {"min_score", "chunk_overlap"}
CANDIDATES = ("configs/config.yaml", "~/.ravelin/config.yaml")


def bare_host(host: str) -> str:
    """A host name without scheme and port."""
    return re.sub(r":[^:]*$", "", re.sub(r"^https?://", "", host))


def load(candidates: tuple[str, ...] = CANDIDATES, env: dict[str, str] | None = None) -> Config:
    """Defaults, then the first file that exists (an unreadable one is skipped, an invalid one leaves the defaults), then OLLAMA_HOST and OLLAMA_PORT."""
    config, env = Config(), dict(os.environ if env is None else env)
    for name in candidates:
        try:
            text = Path(name).expanduser().read_text(encoding="utf-8")
        except OSError:
            continue
        config = merged(config, text)
        break
    if host := env.get("OLLAMA_HOST"):
        config = replace(config, model=replace(config.model, host=bare_host(host)))
    if (port := env.get("OLLAMA_PORT", "")).isdigit():
        config = replace(config, model=replace(config.model, port=int(port)))
    return config


def merged(config: Config, text: str) -> Config:
    """config with what a YAML text sets. Empty and zero values leave the default, unknown settings are ignored."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading a configuration file needs PyYAML") from e
    try:
        raw = yaml.safe_load(text) or {}
    except yaml.YAMLError:
        return config
    for section, values in raw.items() if isinstance(raw, dict) else ():
        target = SECTIONS.get(section)
        if not target or not isinstance(values, dict):
            continue
        part = getattr(config, target)
        known = asdict(part)
        new = {}
        for key, value in values.items():
            key = NAMES.get(key, key)
            if key not in known or (not value and not (key in ZERO_COUNTS and value == 0)) or (key == "min_score" and value < 0):
                continue
            new[key] = tuple(map(str, value)) if isinstance(value, list) else value
        config = replace(config, **{target: replace(part, **new)})
    return config
