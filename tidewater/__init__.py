"""tidewater: Spark DataFrame analytics for star-schema sales, customer
retention and RFM segmentation, entity-by-year panels and wide-sheet
reshaping.

Every function takes and returns DataFrames; tables, columns, dates,
cutoffs and label rules are parameters.  Sub-packages:

* ``sources``   – table, sheet and boundary readers; dataset sinks
* ``functions`` – column-level helpers (NA algebra, dates, text, bins)
* ``operators`` – reusable relational building blocks (exact order
  statistics at scale, group-attached aggregates, joins, reshape, top-k)
* ``plans``     – the analyses themselves (customers, star, panel,
  affordability, figures, metrics, models)
* ``streaming`` – nothing: the analyses are batch-only (see README)
"""

from tidewater.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
