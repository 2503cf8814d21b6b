"""URLs: canonical form, tracking-insensitive key, joining."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Host endings that are never public, and query names that only track.
PRIVATE_ENDINGS = (".local", ".internal")
TRACKING_PREFIX, TRACKING = "utm_", {"fbclid", "gclid"}


def canonical(url: str | None) -> str | None:
    """Scheme and host in lower case, host in IDNA without its last dot, path at least "/", no fragment; None for
    what is no public HTTP(S) URL or holds credentials, outer white space or control characters."""
    if url is None or url.strip() != url or any(c < " " for c in url):
        return None
    try:
        p = urlsplit(url)
        port = p.port
        host = (p.hostname or "").encode("idna").decode("ascii").lower().rstrip(".")
    except (ValueError, UnicodeError):
        return None
    if p.scheme.lower() not in ("http", "https") or p.username or p.password or not host or host.endswith(PRIVATE_ENDINGS):
        return None
    # an IPv6 host stands in brackets, and then without its port
    place = f"[{host}]{f':{port}' if port else ''}" if ":" in host else host + (f":{port}" if port else "")
    return urlunsplit((p.scheme.lower(), place, p.path or "/", p.query, ""))


def without_tracking(url: str | None) -> str | None:
    clean = canonical(url)
    if clean is None:
        return None
    p = urlsplit(clean)
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith(TRACKING_PREFIX) and k.lower() not in TRACKING]
    return urlunsplit((p.scheme, p.netloc, p.path, urlencode(kept), ""))


def absolute(base: str | None, href: str | None) -> str | None:
    try:
        return canonical(urljoin(base or "", href or ""))
    except ValueError:
        return None


def host_of(url: str | None) -> str | None:
    return urlsplit(url).hostname if url else None


def path_of(url: str | None) -> str | None:
    """Path without its last slashes, at least "/"."""
    try:
        return (urlsplit(url).path.rstrip("/") or "/") if url else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(canonical)


@F.pandas_udf(T.StringType())
def tracking_key(url: pd.Series) -> pd.Series:
    return url.map(without_tracking)


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([absolute(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def url_host(url: pd.Series) -> pd.Series:
    return url.map(lambda u: quiet(host_of, u))


@F.pandas_udf(T.StringType())
def url_path(url: pd.Series) -> pd.Series:
    return url.map(path_of)


def quiet(f, url: str | None) -> str | None:
    try:
        return f(url)
    except ValueError:
        return None
