"""Names of users, computers and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Authentication types that texts may name.
AUTHENTICATION_TYPES = ["NTLM", "Kerberos", "Negotiate", "MICROSOFT_AUTHENTICATION_PACKAGE_V1_0"]


def is_machine(user: Column) -> Column:
    """The part before @ ends with $."""
    return F.substring_index(user, "@", 1).endswith("$")


def clean_user(user: Column) -> Column:
    """A user name as it appears in incident ids."""
    return F.regexp_replace(F.translate(user, "@", "_"), r"\$", "")


def reference(prefix: str, line: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), line.cast("string"))


def reference_line(ref: Column, prefix: str = "auth.txt") -> Column:
    """The positive line number of a reference; null if it is not one."""
    return F.regexp_extract(ref, rf"^{prefix.replace('.', '[.]')}:([1-9][0-9]*)$", 1).try_cast("long")


def mentioned(text: Column) -> Column:
    """Entities named in a text: computers, users, clock times and authentication types (in any case), each once, sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (r"\bC\d+\b", r"\bU\d+@DOM\d+\b", r"\b\d{2}:\d{2}:\d{2}\b")]
    types = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{t}\b"), t) for t in AUTHENTICATION_TYPES]))
    return F.array_sort(F.array_distinct(F.concat(*found, types)))
