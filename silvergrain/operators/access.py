"""Signed tokens of access, checked as columns: ``header.claims.signature`` in base64url, signed by HMAC-SHA-256.

The header names the key, the claims hold ``sub``, ``aud``, ``exp`` (seconds) and ``groups``. The HMAC is two SHA-256 digests over a key's two paddings,
which the driver works out once for the few keys there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import governance

BLOCK = 64
CLAIMS = "sub string, aud string, exp long, groups array<string>"


def key_table(spark: SparkSession, secrets: dict[str, bytes]) -> DataFrame:
    """(kid, inner, outer): the paddings of each key, for ``signature``."""
    import hashlib

    def padded(secret: bytes, byte: int) -> bytearray:
        short = hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret
        return bytearray(x ^ byte for x in short.ljust(BLOCK, b"\0"))

    return spark.createDataFrame([(k, padded(s, 0x36), padded(s, 0x5C)) for k, s in secrets.items()], "kid string, inner binary, outer binary")


def url64(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), r"[=\s]", "")


def from_url64(text: Column) -> Column:
    """The bytes; null if it is not base64url."""
    return F.when(text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1), F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))))


def signature(message: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA-256 of a text, in base64url."""
    digest = lambda data: F.unhex(F.sha2(data, 256))
    return url64(digest(F.concat(outer, digest(F.concat(inner, F.encode(message, "utf-8"))))))


def signed(df: DataFrame, keys: DataFrame, kid: Column, claims: Column) -> DataFrame:
    """df with ``token``: claims (a struct) signed by the key of that name; null where there is no such key."""
    head = url64(F.encode(F.to_json(F.struct(F.lit("HS256").alias("alg"), kid.alias("kid"))), "utf-8"))
    message = F.concat(head, F.lit("."), url64(F.encode(F.to_json(claims), "utf-8")))
    own = df.withColumns({"_kid": kid, "_message": message})
    joined = own.join(F.broadcast(keys.withColumnRenamed("kid", "_kid")), "_kid", "left")
    return joined.withColumn("token", F.concat("_message", F.lit("."), signature(F.col("_message"), F.col("inner"), F.col("outer")))).drop("_kid", "_message", "inner", "outer")


def checked(tokens: DataFrame, keys: DataFrame, now: Column, audience: str) -> DataFrame:
    """tokens (token, ...) with ``status`` and, of valid ones, sub and groups.

    status: malformed (not three parts, or a header or claims that can't be read), unknown key, forged, expired, audience (meant for another), valid; the first that holds.
    """
    part = F.split("token", r"\.")
    text = lambda i: F.decode(from_url64(F.get(part, F.lit(i))), "utf-8")
    # only well-formed UTF-8 is decoded: other bytes are no JSON
    fine = lambda i: F.is_valid_utf8(from_url64(F.get(part, F.lit(i))).cast("string"))
    head = F.from_json(F.when(fine(0), text(0)), "alg string, kid string")
    claims = F.from_json(F.when(fine(1), text(1)), CLAIMS)
    own = tokens.withColumns({"_h": head, "_c": claims, "_m": F.concat(F.get(part, F.lit(0)), F.lit("."), F.get(part, F.lit(1))), "_s": F.get(part, F.lit(2)), "_n": F.size(part)})
    joined = own.withColumn("_kid", F.col("_h.kid")).join(F.broadcast(keys.withColumnRenamed("kid", "_kid")), "_kid", "left")
    status = (
        F.when(F.col("token").isNull() | (F.col("_n") != 3) | F.col("_kid").isNull() | F.coalesce(F.col("_h.alg") != "HS256", F.lit(True)) | F.col("_c.exp").isNull() | F.col("_c.sub").isNull(), "malformed")
        .when(F.col("inner").isNull(), "unknown key")
        .when(F.col("_s") != signature(F.col("_m"), F.col("inner"), F.col("outer")), "forged")
        .when(F.col("_c.exp") <= now, "expired")
        .when(~F.col("_c.aud").eqNullSafe(F.lit(audience)), "audience")
        .otherwise("valid")
    )
    done = joined.withColumn("status", status)
    valid = F.col("status") == "valid"
    return done.withColumns({"sub": F.when(valid, F.col("_c.sub")), "groups": F.when(valid, F.coalesce(F.col("_c.groups"), F.array().cast("array<string>")))}).drop("_h", "_c", "_m", "_s", "_n", "_kid", "inner", "outer")


def namespaces(found: DataFrame, acl: DataFrame) -> DataFrame:
    """(user, namespaces) of checked tokens: what the groups of each valid one may read; a user of several tokens has what all of them allow."""
    users = found.where("status = 'valid'").select(F.col("sub").alias("user"), F.explode_outer("groups").alias("g")).groupBy("user").agg(F.collect_set("g").alias("groups"))
    return governance.allowed_namespaces(users, acl)


def authorised(requests: DataFrame, keys: DataFrame, acl: DataFrame, now: Column, audience: str, api_keys: DataFrame | None = None, shared_key: str | None = None) -> DataFrame:
    """requests (request_id, header) with ``code`` (200, 401 or 403), ``user`` and ``namespaces``.

    The header is ``Bearer`` and a token. A signed one that is valid counts first, and its groups must allow some namespace (else 403); then a key of
    ``api_keys`` (api_key, namespaces); then the one shared key, which allows everything. A token that none of them knows is refused.
    """
    words = F.split("header", " ")
    bearer = (F.size(words) == 2) & (F.lower(words[0]) == "bearer")
    own = requests.select("request_id", F.when(F.coalesce(bearer, F.lit(False)), F.get(words, F.lit(1))).alias("token"))
    found = checked(own, keys, now, audience)
    groups = found.where("status = 'valid'").select("request_id", F.explode("groups").alias("grp"))
    read = groups.join(acl.select("grp", F.explode("namespaces").alias("ns")), "grp").groupBy("request_id").agg(F.sort_array(F.collect_set("ns")).alias("_ns"))
    known = requests.sparkSession.createDataFrame([], "api_key string, namespaces array<string>") if api_keys is None else api_keys
    joined = found.join(read, "request_id", "left").join(F.broadcast(known.select(F.col("api_key").alias("token"), F.col("namespaces").alias("_static"))), "token", "left")
    valid, every = F.col("status") == "valid", F.array(F.lit(governance.ALL))
    shared = F.col("token") == F.lit(shared_key) if shared_key else F.lit(False)
    everything = F.array_contains("_ns", governance.ALL)
    allowed = F.when(valid, F.when(everything, every).otherwise(F.col("_ns"))).when(F.col("_static").isNotNull(), F.col("_static")).when(shared, every)
    code = F.when(valid & F.col("_ns").isNull(), 403).when(valid | F.col("_static").isNotNull() | F.coalesce(shared, F.lit(False)), 200).otherwise(401)
    return joined.select("request_id", code.alias("code"), F.when(valid, F.col("sub")).alias("user"), F.when(code == 200, allowed).alias("namespaces"))

