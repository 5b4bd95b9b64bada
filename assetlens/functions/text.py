"""Text helpers: canonical ids, redaction, sanitising and look-alike folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlens.functions.scalar import as_col

# URL parameters that carry a secret, the mask, and the shortest literal masked.
SECRET_PARAM_PATTERN = r"(?i)([?&](?:api[-_]?key|key|token|secret|password|access[-_]?token)=)([^&\s]+)"
MASK = "***"
MIN_LITERAL = 8

# Characters read as another letter when comparing names.
LOOK_ALIKES = {
    "0": "o", "о": "o", "1": "l", "|": "l", "і": "l", "3": "e", "е": "e",
    "5": "s", "$": "s", "4": "a", "7": "t",
}


def canonical_id(kind: str | Column, *parts) -> Column:
    """Stable 32-hex id of a record. Nulls count as empty text, so positions never shift."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    texts = [F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", kind, *texts), 256), 1, 32)


def redact(c, literals: tuple[str, ...] = ()) -> Column:
    """Mask query-string secrets and any known literal secret in a text column."""
    out = as_col(c)
    for secret in literals:
        if len(secret) >= MIN_LITERAL:
            out = F.replace(out, F.lit(secret), F.lit(MASK))
    return F.regexp_replace(out, SECRET_PARAM_PATTERN, f"$1{MASK}")


def sanitize(c, max_len: int) -> Column:
    """Control characters to spaces, whitespace collapsed, trimmed, cut; empty gives null."""
    flat = F.regexp_replace(as_col(c), r"[\x00-\x1F\x7F-\x9F]", " ")
    flat = F.trim(F.regexp_replace(flat, r"\s+", " "))
    return F.nullif(F.substring(flat, 1, max_len), F.lit(""))


def fold_ticker(c) -> Column:
    """Lower-case, map look-alike characters, keep a-z only."""
    mapped = F.translate(F.lower(as_col(c)), "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))
    return F.regexp_replace(mapped, "[^a-z]", "")
