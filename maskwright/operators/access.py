"""Role-based access control as joins over roles, users and requests.

Tables: ``roles`` (role, is_active, permissions array, inherits array), ``users`` (user_id,
username, email, roles array, permissions array, is_active), ``requests`` (request_id, user_id,
permission, resource_type, resource_id, ts).

Each role's full permission set is worked out first; users and requests are joined to those sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: permissions, default roles, role hierarchy.
PERMISSIONS = [
    "detect_pii", "detect_batch", "view_detection_results",
    "mask_pii", "mask_batch", "view_masked_data",
    "view_policies", "edit_policies", "create_policies", "delete_policies",
    "proxy_requests", "view_proxy_logs",
    "manage_users", "manage_roles", "view_audit_logs", "export_data", "system_config",
    "api_access", "api_admin",
    "generate_reports", "view_analytics",
]
ROLE_PERMISSIONS = {
    "guest": ["api_access", "detect_pii", "view_detection_results"],
    "user": [
        "api_access", "detect_pii", "detect_batch", "view_detection_results", "mask_pii", "mask_batch",
        "view_policies",
    ],
    "analyst": [
        "api_access", "detect_pii", "detect_batch", "view_detection_results", "mask_pii", "mask_batch",
        "view_masked_data", "view_policies", "generate_reports", "view_analytics", "view_audit_logs",
    ],
    "developer": [
        "api_access", "detect_pii", "detect_batch", "view_detection_results", "mask_pii", "mask_batch",
        "view_masked_data", "view_policies", "proxy_requests", "view_proxy_logs",
    ],
    "security_officer": [
        "api_access", "detect_pii", "detect_batch", "view_detection_results", "mask_pii", "mask_batch",
        "view_masked_data", "view_policies", "edit_policies", "create_policies", "view_audit_logs",
        "generate_reports", "view_analytics", "export_data",
    ],
    "admin": PERMISSIONS,
}
ROLE_HIERARCHY = {
    "admin": ["security_officer", "developer", "analyst", "user", "guest"],
    "security_officer": ["analyst", "user", "guest"],
    "developer": ["user", "guest"],
    "analyst": ["user", "guest"],
    "user": ["guest"],
    "guest": [],
}
DEFAULT_USER_ROLES = ["user"]
OVERRIDE_PERMISSION = "api_admin"
OWN_DATA_RESOURCE = "user"
OWN_DATA_PERMISSIONS = ["view_detection_results", "export_data"]
# --- end of fixed values


def default_roles(spark: SparkSession) -> DataFrame:
    rows = [(name, True, list(p), ROLE_HIERARCHY[name]) for name, p in ROLE_PERMISSIONS.items()]
    return spark.createDataFrame(
        rows, "role string, is_active boolean, permissions array<string>, inherits array<string>"
    )


def role_permissions(roles: DataFrame) -> DataFrame:
    """(role, is_active, effective): own permissions and those of active inherited roles.

    ``inherits`` lists all ancestors. The role itself need not be active. Role names are unique.
    """
    none = F.array().cast("array<string>")
    line = F.array_distinct(F.array_append(F.coalesce("inherits", none), F.col("role")))
    named = roles.select("role", "is_active", F.explode(line).alias("giver"))
    givers = roles.select(F.col("role").alias("giver"), F.col("is_active").alias("gives"), F.col("permissions").alias("given"))
    given = named.join(givers, "giver").filter(F.col("gives") | (F.col("giver") == F.col("role")))
    return given.groupBy("role").agg(
        F.any_value("is_active").alias("is_active"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("given")))).alias("effective")
    )


def role_set(roles: Column) -> Column:
    """A user's roles as a key: sorted, each once, null if there are none."""
    own = F.array_sort(F.array_distinct(F.array_compact(roles)))
    return F.when(F.size(own) > 0, own)


def set_permissions(sets: DataFrame, roles: DataFrame) -> DataFrame:
    """(role_set, granted): what each distinct set of roles grants. Inactive and unknown roles grant nothing."""
    known = role_permissions(roles).filter("is_active").select("role", "effective")
    held = sets.filter(F.col("role_set").isNotNull()).distinct().select("role_set", F.explode("role_set").alias("role"))
    return held.join(known, "role").groupBy("role_set").agg(
        F.array_distinct(F.flatten(F.collect_set("effective"))).alias("granted")
    )


def with_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with ``total_permissions``; inactive users have none.

    Users hold few different sets of roles: each is resolved once, and users are joined to their
    set's permissions. A set that many users hold is one row of the small side, which is sent to all
    tasks or whose partition is split by Spark's treatment of skewed joins.
    """
    none = F.array().cast("array<string>")
    named = users.withColumn("__set", F.when(F.col("is_active"), role_set(F.col("roles"))))
    granted = set_permissions(named.select(F.col("__set").alias("role_set")), roles).select(
        F.col("role_set").alias("__set"), F.col("granted").alias("__granted")
    )
    total = F.array_union(F.coalesce("permissions", none), F.coalesce("__granted", none))
    return named.join(granted, "__set", "left").select(
        *[F.col(f"`{c}`") for c in users.columns], F.when(F.col("is_active"), F.array_sort(total)).otherwise(none).alias("total_permissions")
    )


def user_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, permission), one row each."""
    return with_permissions(users, roles).select("user_id", F.explode("total_permissions").alias("permission"))


def holds(total: Column, permission: Column) -> Column:
    """The permission itself, or the administrator's override."""
    return F.array_contains(total, permission) | F.array_contains(total, F.lit(OVERRIDE_PERMISSION))


def require_any(total: Column, permissions: list[str]) -> Column:
    """Any of the permissions, or the override."""
    return F.arrays_overlap(total, F.array(*[F.lit(p) for p in [*permissions, OVERRIDE_PERMISSION]]))


def _owns(user_id: Column, permission: Column, resource_type: Column, resource_id: Column) -> Column:
    return F.coalesce(
        (resource_type == OWN_DATA_RESOURCE)
        & (resource_id == user_id.cast("string"))
        & permission.isin(OWN_DATA_PERMISSIONS),
        F.lit(False),
    )


def authorize(requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests with ``granted`` and ``reason``.

    ``users`` has one row a user. The partition of a user who makes a large share of all requests is
    split by Spark's treatment of skewed joins, which reads its size as it is shuffled.
    """
    known = with_permissions(users, roles).select(
        "user_id", F.col("is_active").alias("__active"), F.col("total_permissions").alias("__total")
    )
    joined = requests.join(known, "user_id", "left")
    permission = F.col("permission")
    reason = (
        F.when(F.col("__active").isNull(), F.lit("user_not_found"))
        .when(~F.col("__active"), F.lit("user_inactive"))
        .when(F.array_contains("__total", permission), F.lit("permission"))
        .when(F.array_contains("__total", F.lit(OVERRIDE_PERMISSION)), F.lit("admin_override"))
        .when(
            _owns(F.col("user_id"), permission, F.col("resource_type"), F.col("resource_id")),
            F.lit("own_resource"),
        )
        .otherwise(F.lit("denied"))
    )
    return (
        joined.withColumn("reason", reason)
        .withColumn("granted", F.col("reason").isin("permission", "admin_override", "own_resource"))
        .drop("__active", "__total")
    )


def last_logins(authorized: DataFrame, ts: str = "ts") -> DataFrame:
    """Time of each user's last granted request."""
    return authorized.filter("granted").groupBy("user_id").agg(F.max(ts).alias("last_login"))


def users_with_permission(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    return (
        with_permissions(users, roles)
        .filter(holds(F.col("total_permissions"), F.lit(permission)))
        .select("user_id")
    )


def access_audit(users: DataFrame, roles: DataFrame) -> DataFrame:
    return with_permissions(users, roles).select(
        "user_id", "username", "email", "is_active", "roles",
        F.col("permissions").alias("direct_permissions"), "total_permissions",
    )


def rbac_stats(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(statistic, value) rows."""
    of_users = users.agg(F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users"))
    of_roles = roles.agg(
        F.count("*").alias("total_roles"),
        F.count_if("is_active").alias("active_roles"),
        F.lit(len(PERMISSIONS)).cast("long").alias("total_permissions"),
        F.coalesce(F.max(F.size("inherits")), F.lit(0)).cast("long").alias("role_hierarchy_depth"),
    )

    def rows(df: DataFrame) -> DataFrame:
        return df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in df.columns]))
        )

    return rows(of_users).unionByName(rows(of_roles))


def deletable_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles that no user holds."""
    held = users.select(F.explode("roles").alias("role")).distinct()
    return roles.select("role").join(held, "role", "left_anti")


def invalid_role_refs(updates: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, role) of updates that name an unknown role: such updates are rejected."""
    named = updates.select("user_id", F.explode("roles").alias("role"))
    known = roles.select("role").distinct()
    return named.join(known, "role", "left_anti").select("user_id", "role")
