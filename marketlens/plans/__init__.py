"""Layers above the raw tables: staging, point-in-time visibility, marts."""
