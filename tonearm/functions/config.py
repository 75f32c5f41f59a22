"""Settings and requests checked on the driver: every problem is told at once, bounds are clamped where they are soft."""

from __future__ import annotations

import ntpath
import posixpath
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

#: Allowed strategies; the first of each is the default.
STRATEGIES = {
    "clustering_method": ("dj_hierarchical", "kmeans", "agglomerative"),
    "ordering_strategy": ("profile_nearest", "center_out", "seeded_shuffle"),
    "diversity_mode": ("balanced", "loose", "strict"),
    "tempo_mode": ("mixable", "raw"),
    "output_scope": ("tree", "leaf_only", "top_only"),
    "feature_profile": ("balanced_v1", "energy_v1", "texture_v1", "harmony_v1"),
}
#: Numbers with their default, least and greatest value.
NUMBERS = {"max_depth": (3, 1, 5), "target_playlist_size": (24, 2, 500), "min_playlist_size": (8, 1, 250), "max_children": (4, 2, 10)}


@dataclass
class Registry:
    """Plug-ins by key: analyzers, providers, matchers. An unknown key is an error."""

    kind: str
    made: dict[str, Callable] = field(default_factory=dict)

    def add(self, key: str) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            self.made[key] = f
            return f

        return put

    def get(self, key: str) -> Callable:
        if key not in self.made:
            raise ValueError(f"unsupported {self.kind}: {key}")
        return self.made[key]


analyzers = Registry("analyzer")
providers = Registry("provider")


def generation_config(raw: Mapping[str, object]) -> dict[str, object]:
    """Numbers clamped, unknown strategies replaced by their default."""
    out: dict[str, object] = {}
    for name, (default, low, high) in NUMBERS.items():
        out[name] = max(low, min(int(raw.get(name, default)), high))
    for name, allowed in STRATEGIES.items():
        out[name] = raw.get(name) if raw.get(name) in allowed else allowed[0]
    out["random_seed"] = int(raw.get("random_seed", 42))
    return out


def bounded_int(raw: str | None, default: int, low: int, high: int, warn: Callable[[str], None] = lambda _: None) -> int:
    """An integer out of the environment: broken means default, out of bounds means the bound, each with a warning."""
    if raw is None or not raw.strip():
        return default
    try:
        n = int(raw)
    except ValueError:
        warn(f"{raw!r} is no integer; using {default}")
        return default
    if not low <= n <= high:
        warn(f"{n} is outside {low} to {high}")
    return max(low, min(n, high))


def preflight(env: Mapping[str, str], required: tuple[str, ...], pairs: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """All problems: missing values, and halves of pairs."""
    out = [f"{n} is required" for n in required if not env.get(n, "").strip()]
    return out + [f"{a} and {b} go together" for a, b in pairs if bool(env.get(a, "").strip()) != bool(env.get(b, "").strip())]


def request_ids(ids: list[int], most: int = 100) -> list[int]:
    """Distinct positive ids, in order; none or too many is an error."""
    out = list(dict.fromkeys(ids))
    if not 1 <= len(out) <= most or any(isinstance(i, bool) or i < 1 for i in out):
        raise ValueError(f"1 to {most} positive ids")
    return out


def export_request(profile_id: int | None, path: str | None, formats: list[str], allowed: tuple[str, ...] = ("m3u", "m3u8")) -> list[str]:
    """Formats of an export that names a profile or a path."""
    if profile_id is None and not (path or "").strip():
        raise ValueError("a profile or a path is required")
    if not formats or len(set(formats)) != len(formats) or set(formats) - set(allowed):
        raise ValueError(f"distinct formats out of {allowed}")
    return formats


def absolute_path(raw: str) -> str:
    """A POSIX, drive or UNC path in its shortest form; a relative one is an error."""
    text = raw.strip()
    if re.match(r"^[A-Za-z]:[\\/]", text) or text.startswith("\\\\"):
        return ntpath.normpath(text)
    if text.startswith("/"):
        return posixpath.normpath(text)
    raise ValueError("not an absolute path")


#: Outcomes of commands and the status that each maps to.
OUTCOME_STATUS = {"not_found": 404, "stale": 409, "conflict": 409, "rejected": 409, "invalid": 422, "unavailable": 503}
