"""Column-level helpers (scalar functions, HMM emission expressions, statistics)."""
