"""Row visibility and write checks: a table's permissive policies combine with OR into one predicate.

The predicate is an ordinary filter, so Catalyst pushes it to the scan beside the query's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN_ROLES = ("admin", "super_admin")


@dataclass(frozen=True)
class Context:
    """Who asks. ``bypass`` is the service role, which sees and writes all."""

    user: str | int | None = None
    role: str = "user"
    bypass: bool = False

    @property
    def admin(self) -> bool:
        return self.role in ADMIN_ROLES


@dataclass(frozen=True)
class Policy:
    """``owner``: the column with the owner's id; ``hidden``: rows an owner does not see (an SQL
    predicate); ``public``: rows that all see; ``writable``: owners may write their rows."""

    owner: str
    hidden: str | None = None
    public: str | None = None
    writable: bool = True


POLICIES = {
    "user_profiles": Policy("id"),
    "subscriptions": Policy("user_id", writable=False),
    "videos": Policy("user_id", hidden="deleted_at IS NOT NULL"),
    "usage_records": Policy("user_id", writable=False),
    "billing_history": Policy("user_id", writable=False),
    "analysis_shares": Policy("user_id"),
    "blog_posts": Policy("author_id", public="status = 'published'", writable=False),
    "processing_jobs": Policy("user_id"),
}


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def visible(policy: Policy, who: Context) -> Column:
    """Whether ``who`` sees a row."""
    if who.bypass or who.admin:
        return F.lit(True)
    own = F.lit(False) if who.user is None else _truth(F.col(policy.owner) == who.user)
    if policy.hidden:
        own = own & ~_truth(F.expr(policy.hidden))
    return own | _truth(F.expr(policy.public)) if policy.public else own


def secured(df: DataFrame, policy: Policy | str, who: Context) -> DataFrame:
    """The rows of ``df`` that ``who`` sees, by a policy or the name of a table that has one."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    return df if who.bypass or who.admin else df.where(visible(policy, who))


def writable(policy: Policy | str, who: Context) -> Column:
    """Whether ``who`` may write a row: the service role and admins all, owners their own where the table lets them."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    if who.bypass or who.admin:
        return F.lit(True)
    return F.lit(False) if who.user is None or not policy.writable else _truth(F.col(policy.owner) == who.user)


def write_check(df: DataFrame, policy: Policy | str, who: Context) -> DataFrame:
    """``df`` if ``who`` may write all of its rows; raises PermissionError at the first that is refused.

    Only one row is looked for, so the check stops early.
    """
    if who.bypass or who.admin:
        return df
    if df.where(~writable(policy, who)).take(1):
        raise PermissionError("a row belongs to another user or is not writable")
    return df


def role_unchanged(before: DataFrame, after: DataFrame, key: str = "id", role: str = "role") -> DataFrame:
    """Rows of ``after`` that would change a role; users may write their profile but not this column."""
    old = before.select(F.col(key), F.col(role).alias("_old_role"))
    return after.join(old, key).where(~F.col(role).eqNullSafe(F.col("_old_role"))).drop("_old_role")
