"""The engine has no stream operators of its own: iteration state lives in a driver loop (hyperloom.plans)."""
