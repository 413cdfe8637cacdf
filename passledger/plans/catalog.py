"""All registered queries. Importing a module registers its queries."""

from passledger.plans import scans, scoring, joining, ordering, study, scalars, products, estimation, streams  # noqa: F401,I001
from passledger.plans.registry import CHECKS, OPERATORS, QUERIES  # noqa: F401
