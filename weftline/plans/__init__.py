"""Plan-level helpers: materialised cut points, blocked scans and fixpoint loops."""
