"""Keyed counters over event streams, with batch forms of the same semantics."""
