"""Who made a call: session, cached principal, directory, then the ARN itself."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.common import blank_to_null
from spendloom.functions.identity import (
    directory_display_name,
    directory_email,
    principal_parts,
    session_name,
)
from spendloom.operators.joins import hashed_join

MODES = ("iam", "sso", "auto")
_FIELDS = ["resolved", "reason", "display_name", "email", "user_id", "iam_user_name", "iam_role_name", "source"]


def resolve_principals(
    principals: DataFrame,
    cache: DataFrame | None = None,
    directory: DataFrame | None = None,
    mode: str = "iam",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Resolve distinct (`principalarn`, `sessionname`) rows; adds one `identity` struct.

    Order: cached principal, then by mode: `iam` reads the ARN, `sso` looks the session name
    up in the directory by user name and then by user id, `auto` does both in that order.
    `sessionname` may be NULL, then it comes from the ARN.  A directory miss in `sso` mode is
    an unresolved placeholder.

    `cache` has one row per principal (`identity_mappings` columns), `directory` one per user.
    Both may be large, so no join is hinted.  `keep` names columns that stay beside the identity; rows may also be
    those of a stream.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    arn = F.col("principalarn")
    if "sessionname" not in principals.columns:
        principals = principals.withColumn("sessionname", F.lit(None).cast("string"))
    rows = principals.withColumn("_lookup", F.coalesce("sessionname", session_name(arn)))

    choices = []
    if cache is not None:
        rows = rows.join(_cached(cache), "principalarn", "left")
        choices.append(F.col("_cached"))
    if mode != "iam" and directory is not None:
        rows = rows.join(_by_name(directory), "_lookup", "left").join(_by_id(directory), "_lookup", "left")
        choices.append(F.coalesce("_named", "_numbered"))
    if mode == "sso":
        choices.append(_identity(resolved=F.lit(False), reason=F.lit("sso_no_match"), source="placeholder"))
    else:
        parts = principal_parts(arn)
        choices.append(
            _identity(
                iam_user_name=parts["iam_user_name"], iam_role_name=parts["iam_role_name"], source="iam"
            )
        )
    return rows.select("principalarn", "sessionname", *keep, F.coalesce(*choices).alias("identity"))


def first_identity_per_key(resolved: DataFrame, key: str = "accesskeyid", order: tuple[str, ...] = ("timestamp",)):
    """First resolved identity of each session key, in time order."""
    rows = resolved.where(F.col("identity.resolved") & blank_to_null(F.col(key)).isNotNull())
    first = F.min(F.struct(F.struct(*order).alias("since"), "identity")).alias("first")
    return rows.groupBy(key).agg(first).select(key, "first.since", F.col("first.identity").alias("session_identity"))


def resolve_requests(
    requests: DataFrame,
    cache: DataFrame | None = None,
    directory: DataFrame | None = None,
    mode: str = "iam",
    order: tuple[str, ...] = ("timestamp", "requestid"),
) -> DataFrame:
    """Identity of each request (`requestid`, `timestamp`, `principalarn`, `accesskeyid`, `guardrailid`).

    Principals are resolved once each, not once per request.  A request takes the identity its
    access key first resolved to, from that request on; earlier unresolved ones keep their own
    result.  A guardrail request served from the session is marked `cache`.
    """
    own = own_identities(requests, cache, directory, mode)
    return in_sessions(own, first_identity_per_key(own, "accesskeyid", order), order)


def own_identities(
    requests: DataFrame, cache: DataFrame | None = None, directory: DataFrame | None = None, mode: str = "iam"
) -> DataFrame:
    """Each request with the identity its own principal resolves to."""
    if "sessionname" not in requests.columns:
        requests = requests.withColumn("sessionname", F.lit(None).cast("string"))
    who = ["principalarn", "sessionname"]
    keyed = requests.withColumns({name: F.coalesce(name, F.lit("")) for name in (*who, "accesskeyid")})

    principals = keyed.select("principalarn", blank_to_null(F.col("sessionname")).alias("sessionname")).distinct()
    identities = resolve_principals(principals, cache, directory, mode)
    identities = identities.withColumn("sessionname", F.coalesce("sessionname", F.lit("")))
    return hashed_join(keyed, identities, who, "left")


def in_sessions(own: DataFrame, sessions: DataFrame, order: tuple[str, ...] = ("timestamp", "requestid")) -> DataFrame:
    """Requests with the identity of their session; `sessions` has `accesskeyid`, `since`, `session_identity`."""
    joined = hashed_join(own, sessions, ["accesskeyid"], "left")
    in_session = F.col("since").isNotNull() & (F.struct(*order) >= F.col("since"))
    is_first = in_session & (F.struct(*order) == F.col("since"))
    guarded = ~is_first & blank_to_null(F.col("guardrailid")).isNotNull()
    session = F.when(
        guarded, F.col("session_identity").withField("source", F.lit("cache"))
    ).otherwise(F.col("session_identity"))
    return joined.withColumn("identity", F.when(in_session, session).otherwise(F.col("identity"))).drop(
        "since", "session_identity"
    )


def _cached(cache: DataFrame) -> DataFrame:
    """One cached identity per principal; the newest wins."""
    newest = F.max_by(
        F.struct("displayname", "email", "userid"), F.coalesce("resolvedat", F.lit(""))
    ).alias("c")
    rows = cache.groupBy("principalarn").agg(newest)
    identity = _identity(
        display_name=F.col("c.displayname"), email=F.col("c.email"), user_id=F.col("c.userid"), source="cache"
    )
    return rows.select("principalarn", identity.alias("_cached"))


def _by_name(directory: DataFrame) -> DataFrame:
    """Directory users by user name; of several with one name the lowest id."""
    user = F.struct(*[F.col(c) for c in directory.columns])
    rows = directory.where(F.col("UserName").isNotNull()).groupBy(F.col("UserName").alias("_lookup"))
    return rows.agg(F.min_by(user, F.coalesce("UserId", F.lit(""))).alias("u")).select(
        "_lookup", _directory_identity(F.col("u"), found_by_id=False).alias("_named")
    )


def _by_id(directory: DataFrame) -> DataFrame:
    user = F.struct(*[F.col(c) for c in directory.columns])
    rows = directory.where(F.col("UserId").isNotNull()).groupBy(F.col("UserId").alias("_lookup"))
    return rows.agg(F.min_by(user, F.coalesce("UserName", F.lit(""))).alias("u")).select(
        "_lookup", _directory_identity(F.col("u"), found_by_id=True).alias("_numbered")
    )


def _directory_identity(user: Column, found_by_id: bool) -> Column:
    return _identity(
        display_name=directory_display_name(user, found_by_id),
        email=directory_email(user),
        user_id=F.coalesce(user["UserId"], F.lit("")),
        source="sso",
    )


def _identity(source: str, resolved: Column | None = None, **known: Column) -> Column:
    """The identity struct with absent fields NULL."""
    values = {"resolved": F.lit(True) if resolved is None else resolved, "source": F.lit(source), **known}
    fields = []
    for name in _FIELDS:
        kind = "boolean" if name == "resolved" else "string"
        fields.append(values.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*fields)
