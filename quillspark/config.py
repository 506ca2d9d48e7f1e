"""Tunables, with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: What a field holds when the text says nothing about it.
NOT_FOUND = "Not Found in Retrieved Context"
NOT_REPORTED = "Not Reported"


@dataclass(frozen=True)
class Config:
    results_per_source: int = 200
    top_k: int = 500
    title_duplicate: float = 0.88
    title_borderline: float = 0.75
    retry_attempts: int = 3
    retry_delay: float = 1.0
    claim_similarity: float = 0.50
    claim_pairs: int = 20
    claims_per_paper: int = 6
    gap_cluster: float = 0.70
    problem_cluster: float = 0.75
    chunk_tokens: int = 480
    chunk_overlap: int = 96
    context_chunks: int = 9
    min_words: int = 1000
    min_unique: int = 100
    min_abstract_words: int = 80
    min_abstract_unique: int = 30
    max_papers: int = 15
    daily_tokens: int = 170_000
    cache_version: str = "v1"
    #: Prefix of queries, not of passages, for the first-stage ranking.
    query_instruction: str = "Represent this sentence for searching relevant passages: "


def from_env(prefix: str = "QUILLSPARK_", path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The defaults, over them a file of NAME=value lines (blank lines, # comments and quotes allowed), over both the
    environment. Names are the fields' in capitals after the prefix."""
    held: dict[str, str] = {}
    if path and os.path.exists(path):
        for line in open(path):
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                held[name.strip()] = value.strip().strip("\"'")
    held |= dict(os.environ if env is None else env)
    default = Config()
    given = {f.name: type(getattr(default, f.name))(held[prefix + f.name.upper()]) for f in fields(Config) if prefix + f.name.upper() in held}
    return Config(**given)


DEFAULT = Config()
