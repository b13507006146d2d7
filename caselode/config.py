"""Engine parameters (fixed values of the retrieval pipeline are the defaults)."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    alpha: float = 0.4
    beta: float = 0.9
    prefetch: int = 100
    pool_fast: int = 30
    depth: int = 50
    penalty: float = 0.25
    bonus: float = 0.05
    rrf_k: int = 60
    snippet_chars: int = 300
    rerank_chars: int = 1600
    context_chars: int = 4500
    cache_ttl_s: int = 3600
    min_words: int = 60
    short_words: int = 50
    seed: int = 42
    k: int = 10
    prompt_version: str = "v1"
    embedding_version: str = "lex-v1"


def configured(conf: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None) -> EngineConfig:
    """Defaults, then environment variables CASELODE_<NAME>, then settings caselode.<name> (of a session, say).

    A value that is not of its parameter's type raises ValueError; unknown names are ignored.
    """
    env = os.environ if env is None else env
    found = {}
    for f in dataclasses.fields(EngineConfig):
        told = (conf or {}).get(f"caselode.{f.name}", env.get(f"CASELODE_{f.name.upper()}"))
        if told is not None:
            found[f.name] = type(f.default)(told)
    return EngineConfig(**found)


DEFAULT = EngineConfig()
