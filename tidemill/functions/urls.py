"""Canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["ref", "referrer", "source", "fbclid", "gclid", "igshid", "spm", "cmpid", "_hsenc", "_hsmi", "mkt_tok", "sh", "share", "at_medium", "at_campaign"]
TRACKING_PREFIXES = ["utm_", "mc_", "pk_", "hsa_", "vero_"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def canonical_url(url: Column) -> Column:
    """``https`` for ``http``, host in lower case without ``www.``, no default port, fragment, closing slashes or tracking
    parameters; the others sorted by key. '' for blank; what is no absolute URL is only trimmed."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda k: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", k)
    scheme, host, port, path, query = (part(k) for k in range(1, 6))
    scheme = F.lower(scheme)
    default = F.coalesce(*[F.when(scheme == s, p) for s, p in DEFAULT_PORTS.items()], F.lit(""))
    key = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(F.locate("=", p) > 0, F.substr(p, F.locate("=", p) + 1)).otherwise("")
    tracks = lambda p: F.lower(key(p)).isin(TRACKING) | F.lower(key(p)).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracks(p))
    pairs = F.array_sort(F.transform(kept, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), value(p).alias("v"))))  # stable by key
    params = F.array_join(F.transform(pairs, lambda x: F.when(x["v"] == "", x["k"]).otherwise(F.concat_ws("=", x["k"], x["v"]))), "&")
    bare_host = F.regexp_replace(F.lower(host), r"^www\.", "")
    bare_path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(F.when(path == "", "/").otherwise(path))
    made = F.concat(
        F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), bare_host, F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)),
        bare_path, F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)),
    )
    return F.when(host == "", u).otherwise(made)
