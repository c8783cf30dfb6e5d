"""Run settings: defaults, keyword overrides, then ``TALKWEAVE_<NAME>`` environment values."""
from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

_TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    # retrieval
    retrieval_mode: str = "hybrid"        # hybrid | dense | bm25
    first_stage_n: int = 30
    rrf_k: int = 60
    rerank: bool = True
    rerank_candidates: int = 10
    hedge_candidates: int = 5
    sentence_chunks: int = 3
    sentences_per_chunk: int = 8
    evidence_per_query: int = 4
    superseded_penalty: float = 4.0
    bm25_k1: float = 1.4
    bm25_b: float = 0.75
    window_words: int = 180
    embed_dim: int = 64
    # turn control
    controller: str = "rule"              # rule | model | hybrid
    max_subqueries: int = 4
    dedup_cosine: float = 0.90
    reuse_cosine: float = 0.93
    # answers
    evidence_threshold: float = -99.0
    aspect_threshold: float = -1.0
    max_sentences_per_intent: int = 3
    support_threshold: float = 0.7
    # cost model
    threads: int = 4
    cpu_usd_per_vcpu_hour: float = 0.0447
    usd_per_mtok_in: float = 0.0
    usd_per_mtok_out: float = 0.0

    @property
    def hits_kept(self) -> int:
        return max(2 * self.evidence_per_query, 8)

    def with_overrides(self, **kw) -> "Settings":
        return replace(self, **{k: v for k, v in kw.items() if v is not None})


def load_settings(**overrides) -> Settings:
    values = {}
    for f in fields(Settings):
        raw = os.environ.get(f"TALKWEAVE_{f.name.upper()}")
        if raw is None:
            continue
        kind = type(f.default)
        values[f.name] = raw.lower() in _TRUE if kind is bool else kind(raw)
    return Settings(**values).with_overrides(**overrides)
