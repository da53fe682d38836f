"""Settings of passages and results, reconciled so that they fit together."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Limits:
    """Characters of a passage and of its windows, windows of an object, and hits of a result at most."""

    passage: int = 1350
    window: int = 1100
    overlap: int = 130
    least_body: int = 200
    windows: int = 12
    hits: int = 200

    def reconciled(self) -> Limits:
        """Windows fit into passages, overlaps into half a window, and all numbers are positive."""
        passage = max(200, self.passage)
        window = min(max(100, self.window), passage)
        return replace(self, passage=passage, window=window, overlap=min(max(0, self.overlap), window // 2), least_body=min(max(0, self.least_body), passage // 2), windows=max(1, self.windows), hits=min(max(1, self.hits), 200))


#: Passage sizes for models that read so many tokens.
PRESETS = {n: Limits(passage=round(n * 2.6), window=round(n * 2.1), overlap=round(n * 0.25)).reconciled() for n in (512, 1024, 2048)}


def page_bounds(limit: int, offset: int) -> tuple[int, int]:
    return max(1, limit), max(0, offset)
