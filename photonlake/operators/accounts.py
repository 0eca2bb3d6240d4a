"""Account tables: users with live sessions, invites, sessions and the sliding failure limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.text import name_key
from photonlake.operators.ordering import dense_number

#: Roles in rising order.
ROLES = ("viewer", "editor", "admin")


def users_with_sessions(users: DataFrame, sessions: DataFrame, now: int) -> DataFrame:
    live = sessions.filter(F.col("expires_at") > now).groupBy("user_id").agg(F.count("*").alias("sessions"))
    return users.join(live, users["id"] == live["user_id"], "left").drop("user_id").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def usable_invites(invites: DataFrame, now: int) -> DataFrame:
    return invites.filter(F.col("used_at").isNull() & (F.col("expires_at") > now))


def session_user(sessions: DataFrame, users: DataFrame, token_hash: str, now: int) -> DataFrame:
    """The enabled user of a live session."""
    live = sessions.filter((F.col("token_hash") == token_hash) & (F.col("expires_at") > now)).select("user_id")
    return users.filter("disabled_at is null").join(live, users["id"] == live["user_id"], "left_semi")


def set_role(users: DataFrame, user: int, role: str) -> DataFrame:
    """Change a role; the last enabled admin stays one."""
    if role not in ROLES:
        raise ValueError("no such role")
    out = users.withColumn("role", F.when(F.col("id") == user, F.lit(role)).otherwise(F.col("role")))
    if not out.filter("role = 'admin' and disabled_at is null").limit(1).count():
        raise ValueError("the last admin stays an admin")
    return out


def recent_failures(attempts: DataFrame, keys: list[str], window_s: int = 900) -> DataFrame:
    """Attempts (keys, at) with the failures of their key in the window before them, themselves included."""
    span = W.partitionBy(*keys).orderBy("at").rangeBetween(-window_s + 1, 0)
    return attempts.withColumn("failures", F.count("*").over(span))


def pending_invites(invites: DataFrame, now: int) -> DataFrame:
    """Usable invites, newest first."""
    return usable_invites(invites, now).orderBy(F.col("created_at").desc(), F.col("token_hash").asc())


def create_invite(invites: DataFrame, users: DataFrame, token_hash: str, now: int, ttl: int, name: str = "", role: str = "viewer", user: int | None = None, by: str = "") -> DataFrame:
    """Invites with a new one: for a free name and a known role, or for an enabled account that is to set a new password."""
    if user is None:
        clean = " ".join(name.split())
        if not clean or role not in ROLES:
            raise ValueError("an invite needs a name and a known role")
        taken = users.filter(name_key(F.col("name")) == name_key(F.lit(clean)))
        if taken.limit(1).count():
            raise ValueError("that name is in use")
    else:
        owner = users.filter((F.col("id") == user) & F.col("disabled_at").isNull()).select("name", "role").first()
        if owner is None:
            raise ValueError("no enabled account to invite")
        clean, role = owner
    row = {"token_hash": token_hash, "name": clean, "role": role, "user_id": user, "created_by": by, "created_at": now, "expires_at": now + ttl, "used_at": None}
    return invites.unionByName(invites.sparkSession.createDataFrame([tuple(row[c] for c in invites.columns)], invites.schema))


def revoke_invites(invites: DataFrame, tokens: DataFrame) -> DataFrame:
    """Invites without the unused ones among tokens (token_hash)."""
    gone = invites.filter("used_at is null").join(tokens.select("token_hash"), "token_hash", "left_semi").select("token_hash")
    return invites.join(gone, "token_hash", "left_anti").select(*invites.columns)


def accept_invites(invites: DataFrame, users: DataFrame, sessions: DataFrame, accepted: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invites, users, sessions) after accepted (token_hash, pw_hash): each usable invite once. One for a name makes an
    account, unless the name is in use meanwhile; one for an account sets its password and ends its sessions."""
    first = accepted.groupBy("token_hash").agg(F.min("pw_hash").alias("_pw"))
    hit = usable_invites(invites, now).join(first, "token_hash")
    resets = hit.filter("user_id is not null").join(users.filter("disabled_at is null").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    one = resets.groupBy("user_id").agg(F.max_by(F.struct("token_hash", "_pw"), "created_at").alias("x")).select("user_id", "x.*")
    known = users.select(name_key(F.col("name")).alias("_key"))
    fresh = hit.filter("user_id is null").withColumn("_key", name_key(F.col("name"))).join(known, "_key", "left_anti")
    fresh = fresh.groupBy("_key").agg(F.min_by(F.struct("token_hash", "name", "role", "_pw"), F.struct("created_at", "token_hash")).alias("x")).select("x.*")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    fresh = dense_number(fresh, ["token_hash"], "_nth")
    made = {"id": top + F.col("_nth") + 1, "name": F.col("name"), "role": F.col("role"), "pw_hash": F.col("_pw"), "created_at": F.lit(now), "disabled_at": F.lit(None)}
    added = fresh.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in users.schema])
    used = resets.join(one.select("token_hash"), "token_hash", "left_semi").select("token_hash").unionByName(fresh.select("token_hash")).withColumn("_used", F.lit(now))
    out = users.join(one.select(F.col("user_id").alias("id"), "_pw"), "id", "left").withColumn("pw_hash", F.coalesce("_pw", "pw_hash")).select(*users.columns)
    marked = invites.join(used, "token_hash", "left").withColumn("used_at", F.coalesce("used_at", F.col("_used").cast(invites.schema["used_at"].dataType))).select(*invites.columns)
    return marked, out.unionByName(added), sessions.join(one.select("user_id"), "user_id", "left_anti").select(*sessions.columns)
