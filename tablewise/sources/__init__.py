"""Sources and sinks."""

from .export import export_csv, export_json, export_latest
from .pages import build_sources, discover
from .records import envelope, envelope_fields, scan_records, tabulate
from .versions import VersionStore

__all__ = [
    "VersionStore",
    "build_sources",
    "discover",
    "envelope",
    "envelope_fields",
    "export_csv",
    "export_json",
    "export_latest",
    "scan_records",
    "tabulate",
]
