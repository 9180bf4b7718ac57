"""One spelling for file paths that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_path(path: Column) -> Column:
    """Scheme s3a/s3n becomes s3, percent escapes are decoded, ``//``, ``/./`` and ``/x/../`` are folded."""
    text = F.regexp_replace(F.trim(path), r"^(?i)s3[an]?:/+", "s3://")
    text = F.when(text.contains("%"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)
    text = F.coalesce(text, path)
    scheme = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):/+", 1)
    lead = F.when(scheme != "", F.concat(F.lower(scheme), F.lit("://"))).when(text.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*:/+", ""), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when((p == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p))))
    return F.concat(lead, F.array_join(F.when(text.contains(".."), folded).otherwise(parts), "/"))
