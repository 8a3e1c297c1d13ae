"""Analytics over a replicated log: majority commit, matching of logs, canonical export and rebuild."""
