"""Permissions by role sets against plain sets."""

import random

from maskwright.operators import access


def test_role_sets_against_brute_force(spark):
    rng = random.Random(9)
    permissions = [f"p{i}" for i in range(12)] + [access.OVERRIDE_PERMISSION]
    names = [f"r{i}" for i in range(15)]
    roles = [(n, rng.random() < 0.8, rng.choice([rng.sample(permissions, 3), [], None]), rng.choice([rng.sample(names + ["gone"], 3), [], None])) for n in names]
    by = {n: (active, set(p or []), set(i or [])) for n, active, p, i in roles}
    draws = [None, [], ["r1", "r1", None], ["gone"], [None], names]
    users = [(f"u{i}", rng.choice(draws) if i % 5 == 0 else rng.sample(names, 2) if i % 3 else ["r2"], rng.choice([None, ["p0", "own"]]), rng.random() < 0.9, "x") for i in range(400)]

    def of_role(n):
        return by[n][1] | {p for i in by[n][2] if i in by and by[i][0] for p in by[i][1]}

    df = spark.createDataFrame(roles, "role string, is_active boolean, permissions array<string>, inherits array<string>")
    assert {r["role"]: set(r["effective"]) for r in access.role_permissions(df).collect()} == {n: of_role(n) for n in names}
    people = spark.createDataFrame(users, "user_id string, roles array<string>, permissions array<string>, is_active boolean, granted string")
    found = access.with_permissions(people, df)
    assert found.columns == [*people.columns, "total_permissions"]
    want = {}
    for u, held, own, active, _ in users:
        got = set(own or []).union(*[of_role(r) for r in held or [] if r in by and by[r][0]])
        want[u] = sorted(got) if active else []
    assert {r["user_id"]: r["total_permissions"] for r in found.collect()} == want


def test_authorize_moves_requests_once(spark):
    """Where no side is small enough to be sent to all tasks: one exchange of the requests, two of the
    users, and those of the sets and roles."""
    roles = access.default_roles(spark)
    users = spark.createDataFrame([("u1", ["admin"], None, True)], "user_id string, roles array<string>, permissions array<string>, is_active boolean")
    requests = spark.createDataFrame([(1, "u1", "detect_pii", "x", "y")], "request_id int, user_id string, permission string, resource_type string, resource_id string")
    plan = access.authorize(requests, users, roles)
    assert plan.first()["reason"] == "permission"
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hash") <= 9 and text.count("request_id#") and text.count("SortMergeJoin") <= 4
