"""All registered queries."""

from sluice.plans import generation, keyed, messages, navigation, publishing, schemas, streams, values  # noqa: F401
from sluice.plans.catalog import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
