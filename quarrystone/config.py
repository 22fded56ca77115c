"""Settings that change results, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from math import isfinite


#: The least and the greatest value that a text may set a number to.
BOUNDS = {
    "chunk_size": (50, 20_000), "chunk_overlap": (0, 10_000), "top_k": (1, 100), "fusion_candidates": (1, 1_000), "rerank_top_n": (1, 200), "min_score": (0.0, 1.0),
    "max_context_chars": (500, 1_000_000), "max_citations": (0, 50), "deep_iterations": (1, 20), "deep_queries": (0, 20), "deep_good_score": (0.0, 1.0), "deep_pool": (1, 1_000), "bm25_b": (0.0, 1.0),
}


@dataclass(frozen=True)
class Settings:
    """Defaults of the retrieval engine.  ``with_changes`` checks everything before anything is applied."""

    chunk_size: int = 500
    chunk_overlap: int = 50
    min_chunk_chars: int = 50
    structural_max_chars: int = 1200
    structural_min_chars: int = 80
    strikethrough: str = "mark"
    top_k: int = 5
    fusion_candidates: int = 24
    rerank_top_n: int = 20
    rrf_k: int = 60
    rrf_normalizer: float = 0.15
    min_score: float = 0.0
    max_context_chars: int = 90_000
    max_citations: int = 5
    mode: str = "hybrid"
    deep_iterations: int = 3
    deep_queries: int = 3
    deep_good_score: float = 0.55
    deep_pool: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    extensions: tuple[str, ...] = ("html", "htm", "txt", "docx", "xlsx", "pptx")

    def __post_init__(self):
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk size must be positive and the overlap not negative")
        # A sentence cut may end a window right after its middle; a larger overlap would then not move on.
        if self.chunk_overlap > self.chunk_size // 2 + 1:
            raise ValueError("the overlap must not exceed half of the chunk size")
        if self.mode not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown retrieval mode {self.mode!r}")

    @property
    def pool(self) -> int:
        """Candidates that fusion keeps."""
        return max(self.top_k, self.fusion_candidates, self.rerank_top_n)

    def with_changes(self, **changes) -> Settings:
        return replace(self, **changes)

    def from_text(self, told: dict[str, str]) -> Settings:
        """Settings with changes that come as text, each read by the type of its field; a text that can't be read changes nothing at all.

        Truth values are 1/true/yes/on and 0/false/no/off; numbers must be finite and within ``BOUNDS``; lists are divided by commas, and blank
        items drop out.
        """
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        unknown = set(told) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return self.with_changes(**{name: _read(kinds[name], text.strip(), name) for name, text in told.items()})


def _read(kind: type, text: str, name: str):
    if kind is bool:
        if text.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{name}: {text!r} is no truth value")
        return text.lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(part.strip() for part in text.split(",") if part.strip())
    value = kind(text)
    if kind is float and not isfinite(value):
        raise ValueError(f"{name}: {text!r} is not finite")
    least, most = BOUNDS.get(name, (value, value))
    if not least <= value <= most:
        raise ValueError(f"{name}: {text!r} is not between {least} and {most}")
    return value
