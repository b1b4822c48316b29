"""What notices of public sales say, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How notices say that a share is sold, and which round of sale it is, the latest first.
SHARE = r"(?iuU)(?:(\d+)\s*/\s*(\d+)\s*(?:\([^)]{0,40}\))?\s*)?(?:идеален|идеални|ид\.)\s*дел"
ROUNDS = ((3, r"(?iuU)трет|3[\s-]*(?:та)?\s*усна"), (2, r"(?iuU)втор|2[\s-]*(?:ра)?\s*усна"), (1, r"(?iuU)прв|1[\s-]*(?:ва)?\s*усна"))


def ownership_share(note: Column) -> Column:
    """The share that is sold, such as 1/6; ``partial`` where its size is not given, null where the whole is sold."""
    over = F.nullif(F.regexp_extract(note, SHARE, 1), F.lit(""))
    return F.when(note.rlike(SHARE), F.coalesce(F.concat(over, F.lit("/"), F.regexp_extract(note, SHARE, 2)), F.lit("partial")))


def grouped_number(text: Column) -> Column:
    """9.424.800 and 52.924,00: dots and blanks group digits, a comma is the decimal point; null where that is no plain number."""
    plain = F.replace(F.regexp_replace(F.trim(text), "[. ]", ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def sale_round(*texts: Column) -> Column:
    """1, 2 or 3; null where no text says so."""
    said = F.concat_ws(" ", *texts)
    return F.coalesce(*[F.when(said.rlike(pattern), no) for no, pattern in ROUNDS])
