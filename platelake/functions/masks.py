"""PII masking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_email(email: Column) -> Column:
    """First letter, stars, then the domain; '***' when there is no local part."""
    at = F.instr(email, "@")
    masked = F.concat(
        F.substring(email, 1, 1),
        F.repeat(F.lit("*"), F.greatest(at - 2, F.lit(0))),
        F.substr(email, at),
    )
    return F.when(email.isNull(), F.lit(None).cast("string")).when(at > 1, masked).otherwise("***")


def mask_phone(phone: Column) -> Column:
    """Digits only, all but the last four starred."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.concat(
        F.repeat(F.lit("*"), F.greatest(F.length(digits) - 4, F.lit(0))),
        F.right(digits, F.lit(4)),
    )
