"""Tables that cut lineage, written to the folder that the cluster shares."""

from __future__ import annotations

from ..sources.shared import shared_folder, staged

__all__ = ["shared_folder", "staged"]
