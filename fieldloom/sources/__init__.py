"""Readers: tables as grids, JSON lines, file inventories and packed grids."""
