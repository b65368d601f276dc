"""Commerce analytics as Spark jobs: typed staging tables, an identity bridge, marts,
point-in-time snapshots and parameterised business metrics."""

from marketlens.plans.warehouse import Warehouse

__all__ = ["Warehouse"]
