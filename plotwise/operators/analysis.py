"""The full analysis: references worked out once, all models of a registry on the same rows, one long table of deals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.operators import scoring
from plotwise.operators.market import market_refs
from plotwise.scratch import write_table


@dataclass(frozen=True)
class Inputs:
    """What models may read: eligible listings, the written references, settings, and the least samples of a reference by level."""

    rows: DataFrame
    refs: DataFrame
    settings: scoring.Settings
    mins: tuple[int, int, int]


@dataclass(frozen=True)
class Model:
    """UD2: ``run`` gives (id, score) and whatever else the model works out; ``qualified`` is true where it gives no such column."""

    name: str
    title: str
    run: Callable[[Inputs], DataFrame]


MODELS: dict[str, Model] = {}


def register(model: Model) -> Model:
    MODELS[model.name] = model
    return model


register(Model("land", "Building land", lambda x: scoring.score_land(x.rows, x.refs, x.settings, x.mins)))
register(Model("weekend", "High-altitude plots", lambda x: scoring.score_high_plots(x.rows, x.settings)))
register(Model("flip", "Fix and flip", lambda x: scoring.score_flip(x.rows, x.refs, x.settings, x.mins)))
register(Model("motivated", "Motivated sellers", lambda x: scoring.score_motivated(x.rows, x.refs, x.settings, x.mins)))


def eligible(rows: DataFrame, max_age: int) -> DataFrame:
    """Not wanted, sold or gone, and listed for ``max_age`` days at most; auctions of any age."""
    fine = rows.where("deal <> 'wanted' and not coalesce(sold, false)" + (" and gone_at is null" if "gone_at" in rows.columns else ""))
    return fine.where((F.col("deal") == "auction") | (F.col("days_listed") <= max_age))


def analyse(rows: DataFrame, settings: scoring.Settings, mins: tuple[int, int, int], models: dict[str, Model] | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(researcher, id, score, qualified) of all models.

    The references are worked out once and written, whatever the number of models; the rows are written once, so that models read them instead of
    working them out again.
    """
    refs = market_refs(rows) if refs is None else refs
    given = Inputs(write_table(rows, "eligible"), refs, settings, mins)
    made = []
    for m in (MODELS if models is None else models).values():
        found = m.run(given)
        qualified = F.col("qualified") if "qualified" in found.columns else F.lit(True)
        made.append(found.select(F.lit(m.name).alias("researcher"), "id", "score", qualified.alias("qualified")))
    return reduce(lambda a, b: a.unionByName(b), made)
