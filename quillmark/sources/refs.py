"""References to stored objects, as column expressions: parse, describe, resolve, classify, and the address guard."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import strip

#: How object stores name their hosts.
VIRTUAL_HOST = r"(?i)^([a-z0-9.\-]{3,63})\.s3[.-](?:([a-z0-9-]+)\.)?amazonaws\.com$"
PATH_HOST = r"(?i)^s3[.-](?:([a-z0-9-]+)\.)?amazonaws\.com$"
REF = "struct<kind:string,raw:string,bucket:string,key:string,version_id:string,url:string,path:string,region:string,error:string>"


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _split(c: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme (lower case), authority, path and query of a URL."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), "#.*$", "")
    authority = F.regexp_extract(rest, r"^//([^/?]*)", 1)
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?]*", ""), r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return scheme, authority, path, query


def parse_ref(ref: Column) -> Column:
    """A typed reference; error says why there is none.  s3://, http(s)://, file:// and plain paths are known."""
    text = strip(ref)
    scheme, authority, path, query = _split(text)
    key = F.regexp_replace(path, "^/+", "")
    version = _some(unquote(F.regexp_extract(query, r"(?:^|&)versionId=([^&]*)", 1)))
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    decoded = unquote(key)
    virtual, by_path = F.regexp_like(host, F.lit(VIRTUAL_HOST)), F.regexp_like(host, F.lit(PATH_HOST))
    bucket = F.when(virtual, F.regexp_extract(host, VIRTUAL_HOST, 1)).when(by_path, _some(F.substring_index(decoded, "/", 1)))
    object_key = F.when(virtual, _some(decoded)).when(by_path, _some(F.when(F.contains(decoded, F.lit("/")), F.regexp_replace(decoded, "^[^/]*/", "")).otherwise("")))
    region = F.when(virtual, _some(F.regexp_extract(host, VIRTUAL_HOST, 2))).when(by_path, _some(F.regexp_extract(host, PATH_HOST, 1)))
    is_s3, is_http, is_file = scheme == "s3", scheme.isin("http", "https"), scheme == "file"
    other = (F.length(scheme) > 1) & ~is_s3 & ~is_http & ~is_file
    error = (
        F.when(text.isNull() | (text == ""), "empty object reference")
        .when(is_s3 & ((authority == "") | (key == "")), F.concat(F.lit("s3 reference needs a bucket and a key: "), ref))
        .when(other, F.concat(F.lit("unsupported reference scheme "), scheme))
    )
    fine = error.isNull()
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(fine, F.when(is_s3, "s3").when(is_http, "http").otherwise("file")).alias("kind"),
        F.when(fine, text).alias("raw"),
        F.when(fine, F.when(is_s3, authority).when(is_http, bucket)).alias("bucket"),
        F.when(fine, F.when(is_s3, decoded).when(is_http, object_key)).alias("key"),
        F.when(fine & (is_s3 | is_http), version).alias("version_id"),
        F.when(fine & is_http, text).alias("url"),
        F.when(fine & ~is_s3 & ~is_http, F.when(is_file, unquote(path)).otherwise(text)).alias("path"),
        F.when(fine & is_http, region).otherwise(none).alias("region"),
        error.alias("error"),
    )


def describe(r: Column) -> Column:
    """A reference for a log: a signed URL without its query."""
    suffix = F.when(r["version_id"].isNotNull(), F.concat(F.lit("?versionId="), r["version_id"])).otherwise("")
    return F.when(r["kind"] == "s3", F.concat(F.lit("s3://"), r["bucket"], F.lit("/"), r["key"], suffix)).when(r["kind"] == "http", F.regexp_replace(r["url"], "[?#].*$", "")).otherwise(r["path"])


def resolve(ref: Column, bucket: str = "", prefix: str = "") -> Column:
    """A bare key becomes one in the configured bucket, below its prefix; null if the reference is empty."""
    text = strip(ref)
    key = F.regexp_replace(text, "^/+", "")
    key = F.when(F.lit(prefix != "") & ~F.startswith(key, F.lit(prefix)), F.concat(F.lit(prefix), key)).otherwise(key)
    return F.when(text == "", None).when(F.contains(text, F.lit("://")) | F.lit(not bucket), text).otherwise(F.concat(F.lit(f"s3://{bucket}/"), key))


def clean_media_type(c: Column) -> Column:
    """A declared type without parameters; the placeholder for none is none."""
    cleaned = F.lower(strip(F.substring_index(c, ";", 1)))
    return F.when((cleaned != "") & (cleaned != "binary/octet-stream"), cleaned)


def http_failure(status: Column) -> Column:
    return F.when(status == 404, "not_found").when(status.isin(408, 429) | (status >= 500), "storage_unavailable").when(status >= 300, "access_denied")


def address_problem(address: str) -> str | None:
    """Why an address must not be fetched from, or None; an address that wraps another is judged by that one."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return "not an IP address"
    inner = getattr(ip, "ipv4_mapped", None) or getattr(ip, "sixtofour", None)
    if inner is not None:
        return address_problem(str(inner))
    tests = (("link-local", ip.is_link_local or address == "fd00:ec2::254"), ("loopback", ip.is_loopback), ("private", ip.is_private), ("reserved", ip.is_reserved or ip.is_multicast or ip.is_unspecified))
    return next((name for name, bad in tests if bad), None)


def url_problem(url: Column, addresses: Column, suffixes: tuple[str, ...] = (), schemes: tuple[str, ...] = ("https",), private: bool = False) -> Column:
    """Why a URL is blocked, or null.  addresses: all that its host resolves to; every one has to be public."""
    scheme, authority, _, _ = _split(url)
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")), r"\.+$", "")
    listed = F.lit(not suffixes)
    for s in suffixes:
        listed = listed | (host == s.lstrip(".")) | F.endswith(host, F.lit(s))

    @F.pandas_udf("string")
    def problem(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: next((f"{a} is {p}" for a in (x if x is not None else []) if (p := address_problem(a))), None))

    return (
        F.when(~scheme.isin(*schemes), "scheme is not permitted")
        .when(host == "", "no host")
        .when(~listed, "host is not in the allowlist")
        .when(F.coalesce(F.size(addresses), F.lit(0)) <= 0, "host resolves to no addresses")
        .when(F.lit(not private), problem(addresses))
    )
