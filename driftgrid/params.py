"""Parameters of the continuous range query, and a reader for ``key=value`` files."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Parameters; ``eviction`` tells how ``inactivity_ms`` cuts trajectories: at every gap over it, or ``exact``, where a sweep came between."""

    window_ms: int = 60_000
    logical_windows: int = 8
    ratio: int = 150
    radius: float = 20.0
    max_segment: float = 400.0
    eps: float = 1e-5
    region: tuple[float, float, float, float] = (0.0, 0.0, 8626.0, 8872.0)
    grid: int = 128
    partitions: int = 16
    inactivity_ms: int | None = None
    eviction: str = "gap"
    emit_empty: bool = True
    cell: float | None = None

    @property
    def cycle_ms(self) -> int:
        return self.window_ms * self.logical_windows


#: The scale of the test tables' events.
FIXTURE = Params(window_ms=6 * 3_600_000, ratio=10, radius=200.0, max_segment=4000.0)


def read_properties(lines, base: Params = Params()) -> Params:
    """``base`` with the fields named in ``key=value`` lines; others and comments are left out."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)} | {"cell": float, "inactivity_ms": int}
    found = {}
    for line in lines:
        key, sep, value = line.partition("=")
        if sep and not line.lstrip().startswith("#") and kinds.get(key.strip()) in (int, float, str):
            found[key.strip()] = kinds[key.strip()](value.strip())
    return replace(base, **found)
