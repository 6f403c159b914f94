"""Fixed parameters of the registered queries (FIXTURES.md).

`AS_OF` replaces the reference's wall clock so results are reproducible; it is
mid-month on a Thursday, inside the order data (1995-01-01 .. 2001-08-01).
The audit and campaign windows are wider than the reference's 3 and 2 days so
that the test data has hits; the operators default to the reference values.
"""

import datetime as dt

AS_OF = dt.date(2001, 7, 19)
AUDIT_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
AUDIT_DAYS = 30
CAMPAIGN_DAYS = 90

# custom period used by the custom-mode KPI query (spans a year boundary)
CUSTOM_START = dt.date(2000, 11, 10)
CUSTOM_END = dt.date(2001, 2, 3)

# as-of dates of the queries that serve many dates in one plan: the 30 days that end at AS_OF
DATES = tuple(AS_OF - dt.timedelta(days=k) for k in range(29, -1, -1))

# refresh stamp of the queries that read a bundle back
REFRESHED_AT = dt.datetime(2001, 7, 19, 8, 0)
