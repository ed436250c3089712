"""The daily run: stages in their fixed order, and its report."""

from __future__ import annotations

from collections.abc import Callable, Iterable

# fixed values: the stages in their order
ORDER = ("etl", "geocode", "cdc", "risk", "snapshot", "g11", "alert")


def run(stages: dict[str, Callable[[], object]], only: Iterable[str] = (), keep_going: bool = False) -> list[tuple[str, str, str]]:
    """(stage, state, message) of each stage that was run, in ORDER whatever the order of ``only``; a failure ends the run unless ``keep_going``."""
    unknown = [s for s in only if s not in ORDER]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    wanted, out = set(only) or set(ORDER), []
    for name in (s for s in ORDER if s in wanted and s in stages):
        try:
            stages[name]()
            out.append((name, "ok", ""))
        except Exception as e:  # noqa: BLE001  what a stage raises is what the report says
            out.append((name, "failed", str(e).splitlines()[0] if str(e) else type(e).__name__))
            if not keep_going:
                break
    return out
