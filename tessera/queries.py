"""All queries of the engine: importing this registers them."""

from tessera.plans import candidates, catalog, evaluation, features, rows, texts  # noqa: F401
from tessera.registry import QUERIES, SQL  # noqa: F401
