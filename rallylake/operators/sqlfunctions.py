"""Role checks and the metering answer as SQL functions of the session, over its views of the tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Most minutes of overage that a record may lead to.
BOUND = 6000

FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION is_admin(who STRING) RETURNS BOOLEAN
    RETURN coalesce((SELECT bool_or(p.role IN ('admin', 'super_admin')) FROM user_profiles p WHERE p.id = is_admin.who), false)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION is_super_admin(who STRING) RETURNS BOOLEAN
    RETURN coalesce((SELECT bool_or(p.role = 'super_admin') FROM user_profiles p WHERE p.id = is_super_admin.who), false)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION usage_answer(who STRING, minutes BIGINT, bound BIGINT DEFAULT {bound})
    RETURNS TABLE (success BOOLEAN, minutes_used BIGINT, minutes_remaining BIGINT, overage_minutes BIGINT, reason STRING)
    RETURN SELECT n - s.minutes_included <= usage_answer.bound, IF(n - s.minutes_included <= usage_answer.bound, n, s.minutes_used), greatest(0, s.minutes_included - IF(n - s.minutes_included <= usage_answer.bound, n, s.minutes_used)),
        greatest(0, IF(n - s.minutes_included <= usage_answer.bound, n, s.minutes_used) - s.minutes_included), IF(n - s.minutes_included <= usage_answer.bound, NULL, 'overage limit exceeded')
    FROM (SELECT minutes_included, minutes_used, minutes_used + usage_answer.minutes AS n FROM subscriptions WHERE user_id = usage_answer.who AND status = 'active') s""",
)


def register(spark: SparkSession, bound: int = BOUND) -> None:
    """Make ``is_admin``, ``is_super_admin`` and the table function ``usage_answer`` known to the session's SQL.

    They look into the views ``user_profiles`` (id, role) and ``subscriptions`` (user_id, status, minutes_included,
    minutes_used; one active row a user), which must be there before. A user without a profile is no admin; without an
    active subscription there is no answer.
    """
    for f in FUNCTIONS:
        spark.sql(f.replace("{bound}", str(bound)))
