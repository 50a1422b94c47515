"""What authors of checks need: the contract, the resolvers, parameters and scope.

A module with a CHECK in the folder given by --checks, for example:

    from pyspark.sql import functions as F
    from tidewatch.api import Check, P, R, UPLINK, candidates, finding, told

    def find(ctx):
        limit = P.number(dict(ctx.params), "limit")
        rows = R.latest_readings(ctx.table("event_up"), candidates(ctx), 24, ctx.scope, ctx.as_of)
        return finding(rows.filter(F.col("value") > limit), "warning", told("is at %.1f", "value"), value=F.col("value"))

    CHECK = Check("my-check", "Readings over a limit.", "warning", {"paths": ["a.b"], "limit": 5}, UPLINK, find)
"""

from .functions import geo, payload
from .functions import params as P
from .operators import resolvers as R
from .operators.scope import Scope
from .plans.checks.base import UPLINK, Check, Context, candidates, finding, graded, label, told

__all__ = ["Check", "Context", "P", "R", "Scope", "UPLINK", "candidates", "finding", "geo", "graded", "label", "payload", "told"]
