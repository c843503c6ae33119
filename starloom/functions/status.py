"""Which orders count for what: one named predicate per policy.

Unless it says otherwise a predicate is NULL (so a filter drops the row) when the status is NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions import fixed_values as fixed


def earns_revenue(status: Column) -> Column:
    return ~status.isin(*fixed.REVENUE_EXCLUDED)


def earns_no_revenue(status: Column) -> Column:
    """Exactly the orders that ``earns_revenue`` does not let through, those without a status too; never NULL."""
    return ~F.coalesce(earns_revenue(status), F.lit(False))


def is_delivered(status: Column) -> Column:
    return status == fixed.DELIVERED
