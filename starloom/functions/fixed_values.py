"""Business constants of the reports."""

# Results are only comparable when these stay exactly as they are.
REVENUE_EXCLUDED = ("canceled", "unavailable")
DELIVERED = "delivered"
CANCELED = "canceled"
NO_CATEGORY = "unknown"
DELAY_EARLY = "1_early"
DELAY_ON_DAY = "2_on_estimated_day"
DELAY_SHORT = "3_late_1to5d"
DELAY_LONG = "4_late_over_5d"
DELAY_SHORT_MAX_DAYS = 5
REVENUE_MONTHS = ("2017-01-01", "2018-08-01")
ZIP_PREFIX_LENGTH = 5
