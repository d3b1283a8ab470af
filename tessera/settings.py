"""Settings by environment variables, and the parts of a pipeline by name."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame

from tessera.operators.generate import Generator, first_sentence
from tessera.operators.ranking import fuse
from tessera.operators.sharded_search import search_texts

Retriever = Callable[[DataFrame, int], DataFrame]


def truth(value: str | None, default: bool = False) -> bool:
    """Whether a setting is on: 1, true, yes and on in any case, with blanks around; absent means the default."""
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


@dataclass
class Settings:
    """What a pipeline is made of. A threshold without a re-ranker is dropped."""

    method: str = "bm25"
    generator: str = "first_sentence"
    context_k: int = 3
    candidates: int = 30
    rerank: bool = True
    threshold: float | None = None

    def __post_init__(self) -> None:
        if not self.rerank:
            self.threshold = None

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """From TESSERA_METHOD, TESSERA_GENERATOR, TESSERA_CONTEXT_K, TESSERA_CANDIDATES, TESSERA_RERANK and TESSERA_THRESHOLD."""
        get = lambda name, default: env.get(f"TESSERA_{name}", default)
        threshold = get("THRESHOLD", "")
        return cls(
            get("METHOD", cls.method), get("GENERATOR", cls.generator), int(get("CONTEXT_K", cls.context_k)), int(get("CANDIDATES", cls.candidates)),
            truth(env.get("TESSERA_RERANK"), True), float(threshold) if threshold else None,
        )


GENERATORS: dict[str, Callable[[], Generator]] = {"first_sentence": first_sentence}


def generator(name: str) -> Callable[[], Generator]:
    """The maker of a model by name; an unknown name raises."""
    if name not in GENERATORS:
        raise ValueError(f"no generator {name!r}; there are {sorted(GENERATORS)}")
    return GENERATORS[name]


@dataclass
class Retrievers:
    """Retrievers over (doc, text) by method name, each made once: bm25, bm25_bigram and hybrid, and any that is added."""

    docs: DataFrame
    made: dict[str, Retriever] = field(default_factory=dict)

    def get(self, method: str) -> Retriever:
        """A function of queries (query, text) and k that gives ranked hits; an unknown method raises."""
        if method not in self.made:
            own = {"bm25": partial(self._bm25, False), "bm25_bigram": partial(self._bm25, True), "hybrid": self._hybrid}
            if method not in own:
                raise ValueError(f"no retriever {method!r}; there are {sorted({*own, *self.made})}")
            self.made[method] = own[method]
        return self.made[method]

    def _bm25(self, bigrams: bool, queries: DataFrame, k: int) -> DataFrame:
        return search_texts(self.docs, queries, k, bigrams=bigrams)

    def _hybrid(self, queries: DataFrame, k: int, depth: int = 100) -> DataFrame:
        return fuse([self.get(m)(queries, max(k, depth)) for m in ("bm25", self.second)], k)

    @property
    def second(self) -> str:
        """What is fused with BM25: the dense retriever where one was added."""
        return "dense" if "dense" in self.made else "bm25_bigram"
