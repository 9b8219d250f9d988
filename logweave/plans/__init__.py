"""Registered queries, their SQL counterparts and the raw logs they run on."""
