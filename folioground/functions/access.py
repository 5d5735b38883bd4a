"""Permission predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioground import constants as C


def text_array(values: list[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def role_permissions(role: Column) -> Column:
    """Permissions of a role from the fixed table; none for anonymous or unknown roles."""
    expr = None
    for name, perms in C.ROLE_PERMISSIONS.items():
        branch = text_array(perms)
        expr = F.when(role == name, branch) if expr is None else expr.when(role == name, branch)
    return expr.otherwise(text_array([]))


def holds_any(permissions: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(permissions, text_array(wanted)), F.lit(False))


def holds_all(permissions: Column, required: Column) -> Column:
    """Every required permission is held, or the holder may do everything."""
    return F.array_contains(permissions, "admin:all") | (
        F.size(F.array_except(required, permissions)) == 0)


def may_read(is_private: Column, owner: Column, user: Column, permissions: Column) -> Column:
    own = F.coalesce(owner == user, F.lit(False))
    return ~F.coalesce(is_private, F.lit(False)) | own | holds_any(permissions, C.PRIVATE_ACCESS)


def may_list(is_private: Column, owner: Column, user: Column, permissions: Column) -> Column:
    own = F.coalesce(owner == user, F.lit(False))
    return ~F.coalesce(is_private, F.lit(False)) | own | holds_any(permissions, C.LISTING_ACCESS)


def history_denied(include_historical: Column, permissions: Column) -> Column:
    """Reason when archived text is asked for without the right to it, else null."""
    return F.when(
        F.coalesce(include_historical, F.lit(False)) & ~holds_any(permissions, C.HISTORY_ACCESS),
        F.lit("FORBIDDEN_HISTORICAL"))
