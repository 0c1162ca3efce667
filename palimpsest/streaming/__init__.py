"""Incremental forms of the operators: ledger appends, windows with late data, expiry."""
