"""Sources and sinks by format name, with projection and filter on every reader."""

from tidegauge.sources.registry import FORMATS, fetch, infer_format, merge, ranked, read, register, write

__all__ = ["FORMATS", "fetch", "infer_format", "merge", "ranked", "read", "register", "write"]
