"""Reading tables, writing snapshots, and the shared folder used between stages."""

from cohortry.sources.deltas import Deltas, Measure
from cohortry.sources.incremental import IncrementalSnapshot
from cohortry.sources.snapshots import (
    Snapshot,
    append,
    as_view,
    drop_view,
    empty,
    replace,
    snapshot,
    union_children,
    update_where,
)
from cohortry.sources.tables import TableFolder, load, load_stream
from cohortry.sources.versions import VersionConflict, VersionedTable
from cohortry.sources.workspace import materialise, new_path, scratch, shared_dir

__all__ = [
    "Deltas", "IncrementalSnapshot", "Measure", "Snapshot", "TableFolder", "VersionConflict", "VersionedTable", "append", "as_view", "drop_view", "empty", "load", "load_stream", "materialise",
    "new_path", "replace", "scratch", "shared_dir", "snapshot", "union_children", "update_where",
]
