"""Repository addresses, ref names and synthetic branch ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.text import BLANK, is_blank, longer_than, trim

NAME = r"^[A-Za-z0-9_.-]+\z"
REF = r"^[A-Za-z0-9._/-]+\z"
HEX = r"^[0-9a-fA-F]+\z"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)([^?#]*)"
HOST = "github.com"


def parse_repository(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add owner, repo, canonical url and name, or the reason of a rejection."""
    raw = trim(F.coalesce(F.col(url), F.lit("")))
    parts = urls.withColumns(
        {
            "raw_url": raw,
            "scheme": F.lower(F.regexp_extract(raw, URL, 1)),
            "authority": F.regexp_extract(raw, URL, 2),
            "path": F.translate(F.regexp_extract(raw, URL, 3), "\\", "/"),
        }
    )
    host_port = F.substring_index("authority", "@", -1)
    pieces = F.filter(F.split("path", "/"), lambda p: p != "")
    parts = parts.withColumns(
        {
            "host": F.lower(F.substring_index(host_port, ":", 1)),
            "port": F.regexp_extract(host_port, r":(\d+)\z", 1),
            "pieces": pieces,
            "owner": F.try_element_at(pieces, F.lit(1)),
            "repo": F.regexp_replace(F.try_element_at(pieces, F.lit(2)), r"\.git\z", ""),
        }
    )
    shown_path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    readable = F.rlike("raw_url", F.lit(URL)) & ((F.col("scheme") != "https") | (F.col("host") != ""))

    def say(*parts_: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts_))

    error = (
        F.when(F.col("raw_url") == "", "repository is required — provide a public GitHub URL")
        .when(
            ~readable,
            say('invalid repository URL "', F.col("raw_url"), '" — expected https://github.com/<owner>/<repo>'),
        )
        .when(
            F.col("scheme") != "https",
            say('unsupported repository scheme "', F.col("scheme"), ':" — only https://github.com URLs are supported'),
        )
        .when(
            F.col("host") != HOST,
            say('unsupported repository host "', F.col("host"), '" — only github.com is supported in this MVP'),
        )
        .when(
            F.contains(F.col("authority"), F.lit("@")) & (F.substring_index("authority", "@", 1) != ""),
            "repository URLs containing credentials are not allowed",
        )
        .when(~F.col("port").isin("", "443"), "repository URLs containing a port are not allowed")
        .when(
            F.size("pieces") != 2,
            say('invalid GitHub repository path "', shown_path, '" — expected /<owner>/<repo>'),
        )
        .when(
            ~(F.rlike("owner", F.lit(NAME)) & F.rlike("repo", F.lit(NAME))),
            say(
                'invalid GitHub repository "', F.col("owner"), "/", F.col("repo"),
                "\" — owner and repo may only contain letters, numbers, '.', '_' and '-'",
            ),
        )
    )
    named = F.concat("owner", F.lit("/"), "repo")
    checked = parts.withColumn("error", error)
    return checked.select(
        *urls.columns,
        "error",
        *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("owner", "repo")),
        F.when(F.col("error").isNull(), F.concat(F.lit(f"https://{HOST}/"), named)).alias("canonical_url"),
        F.when(F.col("error").isNull(), named).alias("name"),
    )


def ref_error(ref: Column, field: str) -> Column:
    """Why a branch name or commit hash is refused; null if it is fine."""
    value = trim(F.coalesce(ref, F.lit("")))

    def say(text: str) -> Column:
        return F.concat(F.lit(f'{field} "'), value, F.lit(f'" {text}'))

    forbidden = (
        F.contains(value, F.lit("..")) | F.contains(value, F.lit("@{")) | F.rlike(value, F.lit(BLANK))
    )
    return (
        F.when(value == "", f"{field} is required — provide a branch name or commit SHA")
        .when(longer_than(value, 255), say("is too long (max 255 characters)"))
        .when(F.rlike(value, F.lit("^[-/]")), say("must not start with '-' or '/'"))
        .when(forbidden, say("contains a forbidden sequence"))
        .when(
            F.rlike(value, F.lit(HEX)),
            F.when(~F.length(value).between(4, 64), say("is not a valid commit SHA")),
        )
        .when(
            ~F.rlike(value, F.lit(REF)),
            say("contains invalid characters — use letters, numbers, '.', '_', '/' and '-' only"),
        )
    )


def is_branch_name(ref: Column) -> Column:
    """True unless the ref reads as a commit hash of 4 to 64 digits."""
    value = trim(ref)
    return ~(F.rlike(value, F.lit(HEX)) & F.length(value).between(4, 64))


def synthetic_sha(name: Column) -> Column:
    """Stable 40-digit id of a name: its 31-polynomial over UTF-16 units mod 2^32,
    as eight hex digits five times."""
    units = F.regexp_extract_all(F.hex(F.encode(name, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    modulus = F.lit(2**32).cast("long")
    value = F.aggregate(
        units,
        F.lit(0).cast("long"),
        lambda total, unit: (total * 31 + F.conv(unit, 16, 10).cast("long")) % modulus,
    )
    return F.repeat(F.lpad(F.lower(F.hex(value)), 8, "0"), 5)


def default_path(path: Column, change_id: Column) -> Column:
    """File path of a pasted text: as given, else ``<change_id>.diff``."""
    return F.when(is_blank(path), F.concat(change_id, F.lit(".diff"))).otherwise(trim(path))
