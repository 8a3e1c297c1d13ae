"""The persistent table: commit log, sorted runs and manifest in one folder of any Hadoop file system."""

from .store import Options, Snapshot, Store, StoreError

__all__ = ["Options", "Snapshot", "Store", "StoreError"]
