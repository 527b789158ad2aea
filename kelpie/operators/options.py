"""Options of a recall, resolved against the settings."""

from __future__ import annotations

from dataclasses import dataclass

from kelpie.sources.files import Settings

SOURCE_TYPES = ("fact", "decision", "task", "doc_chunk", "note")


@dataclass(frozen=True)
class RecallOptions:
    """What a caller asks for; None, 0 and () leave it to the settings."""

    query: str
    mode: str | None = None
    max_results: int = 0
    source_types: tuple[str, ...] = ()
    include_stale: bool | None = None
    accepted_only: bool | None = None
    use_reranker: bool | None = None
    min_rerank_score: float | None = None


@dataclass(frozen=True)
class Resolved:
    """Options with every choice made."""

    query: str
    mode: str
    max_results: int
    source_types: tuple[str, ...]
    include_stale: bool
    accepted_only: bool
    use_reranker: bool
    pool: int
    min_rerank_score: float
    doc_min_rerank_score: float
    docs_via_default: bool


def resolve(options: RecallOptions, settings: Settings) -> Resolved:
    """ValueError for an empty query, no results or an unknown source type.

    Documents join the default types only where the settings say so and the caller named none; they
    then have a floor of their own. The pool that is reranked is never smaller than the results.
    """
    query = options.query.strip()
    if not query:
        raise ValueError("a recall needs a query")
    most = options.max_results or settings.max_results
    if most <= 0:
        raise ValueError("max_results must be above 0")
    if unknown := set(options.source_types) - set(SOURCE_TYPES):
        raise ValueError(f"unknown source types: {', '.join(sorted(unknown))}")
    default = not options.source_types
    types = SOURCE_TYPES[: 4 if settings.docs_by_default else 3] if default else tuple(dict.fromkeys(options.source_types))
    given = lambda value, other: other if value is None else value
    return Resolved(
        query=query, mode=given(options.mode, settings.mode), max_results=most, source_types=types,
        include_stale=given(options.include_stale, settings.include_stale), accepted_only=given(options.accepted_only, settings.accepted_only),
        use_reranker=given(options.use_reranker, settings.use_reranker), pool=max(settings.pool, most),
        min_rerank_score=given(options.min_rerank_score, settings.min_rerank_score), doc_min_rerank_score=settings.doc_min_rerank_score,
        docs_via_default=default and settings.docs_by_default,
    )
