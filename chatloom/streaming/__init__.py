"""Streams whose results are exact: partial results of each batch, merged by keys, in any order and split."""

from __future__ import annotations

from .merged import MergedTable
from .sources import file_stream
from .usage import usage_parts, usage_stream
from .users import UserStream

__all__ = ["MergedTable", "UserStream", "file_stream", "usage_parts", "usage_stream"]
