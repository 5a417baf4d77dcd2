"""Settings of a summary run."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from .functions.terms import BASE_URI, DEFAULT_SOURCE


@dataclass(frozen=True)
class SummaryConfig:
    """``model`` names an equivalence relation; ``class_signal`` None means no labels, "*" every object a label.

    ``literal_subjects``: undirected edges of literals are turned round too. ``allow_orphans``: secondary summaries that
    nothing points at any more stay in the store. ``resume``: goes on after the last version in ``state_dir``.
    ``keep_versions``: how many of the newest versions stay (None: all).
    """

    model: str = "complex-attribute_class-collection"
    class_signal: str | None = None
    undirected: bool = False
    neighbor_mode: str = "min"
    payload: bool = True
    base_uri: str = BASE_URI
    default_source: str = DEFAULT_SOURCE
    inputs: tuple[str, ...] = ()
    delta: bool = False
    verify_against_batch: bool = False
    dry_run: bool = False
    skip_snapshots: int = 0
    end_early: int | None = None
    state_dir: str | None = None
    report_dir: str | None = None
    export_dir: str | None = None
    schema_stats: bool = False
    track_changes: bool = True
    literal_subjects: bool = False
    allow_orphans: bool = False
    resume: bool = False
    keep_versions: int | None = None

    @staticmethod
    def read(path: str) -> SummaryConfig:
        """From a JSON file; unknown keys raise."""
        with open(path) as f:
            raw = json.load(f)
        names = {f.name for f in dataclasses.fields(SummaryConfig)}
        if wrong := set(raw) - names:
            raise ValueError(f"unknown settings: {sorted(wrong)}")
        return SummaryConfig(**(raw | {"inputs": tuple(raw.get("inputs", ()))}))

    def snapshots(self) -> list[tuple[int, str]]:
        """(number, path) of the snapshots to run, between skip_snapshots and end_early."""
        last = len(self.inputs) - 1 if self.end_early is None else self.end_early
        return [(i, p) for i, p in enumerate(self.inputs) if self.skip_snapshots <= i <= last]
