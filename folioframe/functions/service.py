"""Rules at the service's edge that are plain expressions: paths, provider errors, keys and addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that may be called and their methods.
NAME = "[A-Za-z0-9_-]+"
ROUTES = (
    ("health", ("GET",)),
    ("convert", ("POST",)),
    ("convert/bulk", ("POST",)),
    (f"convert/{NAME}", ("GET",)),
    (f"convert/{NAME}/report", ("GET",)),
    (f"convert/{NAME}/result", ("GET",)),
    ("settings/llm", ("GET", "POST", "DELETE")),
    ("settings/llm/test", ("POST",)),
)
#: What a provider says when it rejects a key.
REJECTIONS = (
    "api key not valid", "api_key_invalid", "api key expired", "invalid api key", "permission denied", "unauthenticated",
    "status code 401", "status code 403", " 401 unauthorized", " 403 forbidden",
)
#: IPv4 networks that aren't globally reachable.
LOCAL_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24",
    "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def route_status(path: Column, method: Column) -> Column:
    """404 for a path that no route has, 405 for a method its first route hasn't, else 200."""
    out = F.lit(404)
    for pattern, methods in reversed(ROUTES):
        out = F.when(path.rlike(f"^{pattern}$"), F.when(F.upper(method).isin(*methods), F.lit(200)).otherwise(F.lit(405))).otherwise(out)
    return out


def rejects_key(code: Column, message: Column) -> Column:
    """A provider's error that means a bad key, by code or by wording."""
    text = F.lower(F.coalesce(message, F.lit("")))
    said = F.lit(False)
    for marker in REJECTIONS:
        said = said | F.contains(text, F.lit(marker))
    return F.coalesce(code.isin(401, 403), F.lit(False)) | said


def vision_settings(text: Column) -> Column:
    """Struct (provider, model, apiKey) from JSON; null if anything in it is missing or of another kind."""
    kind = lambda key: F.schema_of_variant(F.variant_get(F.try_parse_json(text), f"$.{key}", "variant"))
    got = F.from_json(text, "provider string, model string, apiKey string")
    strings = (kind("model") == "STRING") & (kind("apiKey") == "STRING")
    return F.when(strings & (got["provider"] == "gemini") & (got["model"] != "") & (got["apiKey"] != ""), got)


def token_hash(token: Column) -> Column:
    return F.sha2(token.cast("binary"), 256)


def sealed(text: Column, key: Column) -> Column:
    """AES-GCM with a random start value; value and tag are part of the result."""
    return F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM")))


def opened(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


def is_global_ipv4(address: Column) -> Column:
    """An ordinary reachable address; false for anything that isn't four numbers up to 255."""
    parts = F.transform(F.split(address, "\\."), lambda p: F.when(p.rlike("^\\d{1,3}$"), p.cast("long")))
    good = F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255)), F.lit(False))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    local = F.lit(False)
    for network in map(ipaddress.ip_network, LOCAL_NETWORKS):
        local = local | value.between(int(network.network_address), int(network.broadcast_address))
    return F.when(good, ~local).otherwise(F.lit(False))
