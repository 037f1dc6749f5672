"""What share of a run is done, from the events of its stages."""

from __future__ import annotations

# Stage -> (message, share done at its beginning, share done at its end).
STAGES = {
    "waiting": ("Waiting for the project", 0.0, 0.0),
    "started": ("Getting ready", 0.0, 0.03),
    "prepare": ("Getting ready", 0.03, 0.05),
    "discover": ("Finding files", 0.05, 0.08),
    "read": ("Reading files", 0.08, 0.30),
    "enrich_files": ("Describing files", 0.30, 0.66),
    "enrich_chunks": ("Describing code", 0.66, 0.76),
    "embed": ("Preparing search", 0.76, 0.90),
    "save": ("Saving", 0.88, 0.93),
    "check": ("Checking", 0.93, 0.94),
    "prewarm": ("Warming search", 0.94, 0.98),
    "ready": ("Ready", 1.0, 1.0),
    "finished": ("Complete", 1.0, 1.0),
    "needs_attention": ("Needs attention", 1.0, 1.0),
    "failed": ("Failed", 1.0, 1.0),
    "cancelled": ("Cancelled", 1.0, 1.0),
}


def ratio(done: int, total: int) -> float:
    """`done` of `total` between 0 and 1; 0 of nothing."""
    return min(1.0, max(0.0, done / total)) if total else 0.0


class Progress:
    """The percent of a run. It never falls, but for a failure, which says where it stopped."""

    def __init__(self):
        self.percent = 0.0

    def at(self, event: str, done: int = 0, total: int = 0) -> dict | None:
        """The state after an event with `done` of `total` items; None for events that are no stage."""
        if event not in STAGES:
            return None
        message, low, high = STAGES[event]
        now = low + (high - low) * ratio(done, total)
        if event != "failed":
            now = self.percent = max(self.percent, now)
        return {"stage": event, "message": message, "percent": round(now if event != "failed" else self.percent, 4)}
