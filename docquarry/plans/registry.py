"""Named components; duplicate and unknown names are errors."""

from __future__ import annotations

from typing import Any

from docquarry.operators import backends, chunking, context, embedding, hybrid, keyword, search


class Registry:
    def __init__(self, kind: str) -> None:
        self.kind, self._made = kind, {}

    def register(self, name: str, made: Any) -> Any:
        if name in self._made:
            raise ValueError(f"{self.kind} {name!r} is there already")
        self._made[name] = made
        return made

    def get(self, name: str) -> Any:
        if name not in self._made:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.names())}")
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._made)


CHUNKERS, EMBEDDERS, INDEXES, RETRIEVERS, RERANKERS, PACKERS = (Registry(x) for x in ("chunker", "embedder", "index", "retriever", "reranker", "context"))
CHUNKERS.register("regulation", chunking.chunk_regulation)
CHUNKERS.register("fixed_window", chunking.chunk_fixed_window)
EMBEDDERS.register("hashing", embedding.hash_vectors)
try:
    import sentence_transformers  # noqa: F401
except ImportError:
    pass
else:
    EMBEDDERS.register("minilm", lambda df, key, text, dim: embedding.neural_vectors(df, key, text))
INDEXES.register("exact", backends.EXACT)
INDEXES.register("quantised", backends.QUANTISED)
INDEXES.register("graph", backends.GRAPH)
RETRIEVERS.register("vector", search.vector_topk)
RETRIEVERS.register("bm25", keyword.bm25_topk)
RETRIEVERS.register("hybrid", hybrid.fuse)
RERANKERS.register("none", hybrid.rerank_identity)
PACKERS.register("greedy", context.pack_context)
ALL = (CHUNKERS, EMBEDDERS, INDEXES, RETRIEVERS, RERANKERS, PACKERS)
