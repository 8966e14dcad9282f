"""Named settings: how many cells to probe, how many rows to keep, how far to walk."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed values. Bands of dimension; probes at 65,536 cells and 10 million rows, least pool at 10 million rows, by band;
# graph width, hops and rows reranked.
BANDS = (128, 256, 512)
PROBES = {"fast": (8, 32, 32, 32), "balanced": (8, 40, 64, 64), "accurate": (32, 128, 256, 160)}
FLOORS = {"fast": (250, 500, 600, 250), "balanced": (450, 1000, 1200, 500), "accurate": (1800, 3000, 2500, 1000)}
GRAPH = {"fast": (16, 1, 16), "balanced": (24, 2, 20), "accurate": (48, 3, 48)}
NAMES = {"fast": "fast", "loose": "fast", "balanced": "balanced", "default": "balanced", "accurate": "accurate", "high": "accurate"}
TARGETS = ((0.91, "fast"), (0.96, "balanced"), (1.0, "accurate"))


@dataclass(frozen=True)
class Preset:
    name: str

    @classmethod
    def of(cls, name: str | None = None, target: float | None = None) -> Preset:
        """By name, which comes first, or by the recall that is wanted; balanced without either."""
        if name is not None:
            if (known := NAMES.get(name.strip().lower())) is None:
                raise ValueError(f"no preset is named {name!r}")
            return cls(known)
        if target is None:
            return cls("balanced")
        if not 0 <= target <= 1:
            raise ValueError(f"a recall is between 0 and 1, not {target}")
        return cls(next(n for t, n in TARGETS if target <= t))

    def _band(self, d: int) -> int:
        return sum(d > b for b in BANDS)

    def probe_ladder(self, d: int, n_cells: int, n_rows: int) -> list[int]:
        """Half, once, twice and four times the centre, which keeps the rows scanned constant above 10 million."""
        work = PROBES[self.name][self._band(d)] * n_cells / 65_536 * min(1.0, 1e7 / max(n_rows, 1))
        centre = min(max(math.ceil(work), 1), max(n_cells, 1))
        return list(dict.fromkeys([max(centre // 2, 1), *(min(m * centre, max(n_cells, 1)) for m in (1, 2, 4))]))

    def pool_floor(self, n_rows: int, d: int) -> int:
        scale = min(max(math.sqrt(n_rows / 1e7), 0.5), 1.0)
        return max(math.floor(FLOORS[self.name][self._band(d)] * scale + 0.5), 128)

    @property
    def graph_width(self) -> int:
        return GRAPH[self.name][0]

    @property
    def hops(self) -> int:
        return GRAPH[self.name][1]

    @property
    def keep(self) -> int:
        return GRAPH[self.name][2]
