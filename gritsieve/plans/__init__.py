"""Plan-level helpers, the ledger and the facade."""
