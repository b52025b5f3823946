"""Model-backed similarity and reranking, with the hashed and lexical fallbacks that need no model.

A model is named by the settings and loaded where it is used, once per Python worker, from the optional
package sentence_transformers.  Without the package the fallbacks take its place, unless the settings are
strict.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import numpy as np

from ..operators import scoring
from .config import Settings

PACKAGE = "sentence_transformers"
#: Scores of (query, document) pairs, in any range; None stands for lexical similarity.
Reranker = Callable[[list[str], list[str]], np.ndarray]
_loaded: dict[tuple[str, str], object] = {}


def load(kind: str, name: str):
    """The model of class ``kind``, kept for this process."""
    if (kind, name) not in _loaded:
        _loaded[kind, name] = getattr(importlib.import_module(PACKAGE), kind)(name)
    return _loaded[kind, name]


class ModelEmbedder:
    """Unit vectors of texts by a sentence model."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, token_lists: list[list[str]], texts: list[str]) -> np.ndarray:
        return np.asarray(load("SentenceTransformer", self.name).encode(list(texts), normalize_embeddings=True, show_progress_bar=False), np.float64)


class ModelReranker:
    """Scores of pairs by a cross encoder."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, queries: list[str], documents: list[str]) -> np.ndarray:
        return np.asarray(load("CrossEncoder", self.name).predict(list(zip(queries, documents, strict=True))), np.float64)


def usable(kind: str, name: str, strict: bool) -> bool:
    """Whether the model can be used here; RuntimeError if it can't and the settings are ``strict``."""
    try:
        if importlib.util.find_spec(PACKAGE) is not None:
            load(kind, name)
            return True
        why: Exception = ImportError(f"no package {PACKAGE}")
    except (ImportError, OSError, RuntimeError, ValueError) as e:
        why = e
    if strict:
        raise RuntimeError(f"the model {name} is not available") from why
    return False


def embedder(config: Settings) -> scoring.Embedder:
    """What the settings name, or hashed token vectors."""
    return ModelEmbedder(config.embedding_model) if usable("SentenceTransformer", config.embedding_model, config.strict_models) else scoring.hashed_embedder


def reranker(config: Settings) -> Reranker | None:
    """What the settings name, or None for lexical similarity."""
    if not config.use_reranker:
        return None
    return ModelReranker(config.reranker_model) if usable("CrossEncoder", config.reranker_model, config.strict_models) else None
