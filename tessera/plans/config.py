"""Retrieval settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

# The default weights of the ranking features.
DEFAULT_WEIGHTS = {
    "rrf": 0.45, "bm25": 0.20, "dense": 0.15, "reranker": 0.10, "coverage": 0.07, "metadata": 0.02, "graph": 0.01,
    "graph_expansion": 0.08, "enrichment": 0.06, "reliability": 0.01, "importance": 0.02, "contradiction_penalty": 0.04,
}


# Names and defaults of the settings; files of settings rely on them.
@dataclass(frozen=True)
class Settings:
    candidate_k: int = 80
    rerank_k: int = 40
    top_k: int = 10
    max_subqueries: int = 4
    rrf_k: int = 60
    use_dense: bool = True
    use_reranker: bool = True
    use_graph: bool = False
    use_graph_expansion: bool = False
    use_enrichment: bool = True
    use_generated_questions: bool = True
    use_semantic_summaries: bool = True
    use_entity_enrichment: bool = True
    use_inferred_edges: bool = True
    use_edge_importance: bool = True
    use_contradiction_penalty: bool = True
    strict_models: bool = False
    embedding_model: str = "BAAI/bge-small-en-v1.5"
    reranker_model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"
    abstention_threshold: float = 0.30
    graph_expansion_seed_k: int = 10
    iterative_seed_k: int = 5
    iterative_bridge_k: int = 8
    iterative_bridge_weight: float = 1.50
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))

    def uses(self, flag: str) -> bool:
        """Whether an enrichment signal is on: enrichment as a whole and its own flag."""
        return self.use_enrichment and getattr(self, flag)

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """Defaults, overridden by the known keys of a JSON file; weights are merged one by one."""
        if not path:
            return cls()
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        known = {k: v for k, v in found.items() if k in cls.__dataclass_fields__ and k != "weights"}
        weights = found.get("weights")
        extra = {str(k): float(v) for k, v in weights.items()} if isinstance(weights, dict) else {}
        return cls(**known, weights=DEFAULT_WEIGHTS | extra)

    def with_signals(self, signals: tuple[str, ...]) -> Settings:
        """This configuration with just the named enrichment signals on."""
        flags = {
            "questions": "use_generated_questions", "summaries": "use_semantic_summaries", "entities": "use_entity_enrichment",
            "inferred_edges": "use_inferred_edges", "importance": "use_edge_importance", "contradiction_penalty": "use_contradiction_penalty",
        }
        return replace(self, use_enrichment=bool(signals), **{flag: name in signals for name, flag in flags.items()})

    def as_dict(self) -> dict:
        return asdict(self)
