"""Normal forms of addresses, digests and states, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track visitors, and the digest of zero bytes.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|dclid|gbraid|wbraid|yclid|mc_eid|mc_cid|igshid|_ga|_gl)(=|$)"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _decoded(c: Column) -> Column:
    plain = F.regexp_replace(c, r"\+", "%2B")
    return F.coalesce(F.try_url_decode(plain), c)


def normal_url(url: Column) -> Column:
    """The address with scheme, host case, default port, closing slash, fragment, order of parameters,
    tracking parameters and percent-coding set aside. Null stays null; what is no address is trimmed only."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    port = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443")).otherwise(F.lit(":-"))
    host = F.when(host.endswith(port), F.regexp_replace(host, r":\d+$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    params = F.array_join(F.sort_array(F.transform(params, _decoded)), "&")
    whole = F.concat(host, _decoded(path), F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit("")))
    return F.when(u.isNull(), None).when(scheme == "", u).otherwise(whole)


def normal_digest(sha256: Column) -> Column:
    """The 64 hexadecimal digits in lower case; null where there is no digest."""
    s = F.regexp_replace(F.lower(sha256), r"^\s*sha-?256\s*[:=]?", "")
    s = F.regexp_replace(s, r"[\s:_-]+", "")
    return F.when(s.rlike("^[0-9a-f]{64}$") & (s != EMPTY_SHA256), s)


def normal_status(status: Column) -> Column:
    """Lower case without blanks around it; null and blank mean todo."""
    s = F.lower(F.regexp_replace(status, r"^\s+|\s+$", ""))
    return F.when(s.isNull() | (s == ""), F.lit("todo")).otherwise(s)


def normal_key(c: Column) -> Column:
    """A key with stray blanks and letter case set aside."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))
