"""Structured Streaming entry points.

The reference has no streams: it re-runs its batch scripts when new yearly
files arrive. Two re-expressions of that on Structured Streaming:

* :func:`incremental.totals_stream` — the totals builder (C2) as a stateful
  streaming aggregation (its per-key sums and counts are incrementally
  maintainable; the impact builder's global z-score is not);
* :func:`incremental.rebuild_on_arrival` — a ``foreachBatch`` sink that
  appends each micro-batch of raw rows (idempotently, one folder per
  epoch) and rebuilds a derived table from everything received so far.
"""
