"""larder - product-knowledge analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns); Catalyst plans the
work.  See README.md for the module map.
"""

from larder.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
