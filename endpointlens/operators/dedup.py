"""Version and first-wins folds; all of them combine on the map side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scope import DAY


def latest_version(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` per key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, "_top.*").select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: list[Column], newest: bool = False) -> DataFrame:
    """First row per key in the given order (last with `newest`)."""
    rest = [c for c in df.columns if c not in keys]
    cand = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                    F.struct(*rest).alias("_row"))
    pick = F.max(cand) if newest else F.min(cand)
    return df.groupBy(*keys).agg(pick["_row"].alias("_row")).select(*keys, "_row.*")


def latest_alerts(alerts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Current version of every stored alert; every alert read goes through this.

    The id is made of tenant, host, rule and time, so time and day are keys as well, and filters on
    them pass through the fold to the scan. `columns` are those the caller needs.
    """
    keys = [k for k in ("tenant_id", "host", "id", "ts", DAY) if k in alerts.columns]
    order = ["created_at", "seq"]
    wanted = alerts if columns is None else alerts.select(*dict.fromkeys([*keys, *order, *columns]))
    return latest_version(wanted, keys, order)
