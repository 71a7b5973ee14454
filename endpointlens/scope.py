"""Tenant lock, argument guards and paging."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_OFFSET = 10_000

# Fixed values: (default, greatest) page sizes.
PAGE_SIZES = {
    "events": (100, 1000), "alerts": (100, 1000), "correlate": (500, 2000),
    "topology": (200, 1000), "search": (5, 20), "incidents": (100, 1000),
}


#: Partition column of the event and alert tables.
DAY = "event_date"


def day_of(ts: Column) -> Column:
    return F.to_date(F.timestamp_millis(ts))


def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    """Rows of one tenant; applied before anything else, a blank tenant is an error."""
    if tenant_id is None or not tenant_id.strip():
        raise ValueError("tenant_id is required")
    return df.where(F.col("tenant_id") == tenant_id.strip())


def tenant_sql(spark: SparkSession, text: str, tenant_id: str, params: dict[str, object],
               **tables: DataFrame) -> DataFrame:
    """SQL with `:name` parameters; every `{table}` it names sees the tenant's rows only."""
    scoped = {name: tenant_scope(df, tenant_id) for name, df in tables.items()}
    return spark.sql(text, args=params, **scoped)


def has_text(value: str | None) -> bool:
    return value is not None and bool(value.strip())


def text_filter(df: DataFrame, column: str, value: str | None, fold: bool = False) -> DataFrame:
    """Blank means no filter."""
    if not has_text(value):
        return df
    value = value.strip()
    return df.where(F.col(column) == (value.lower() if fold else value))


def exact_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Null means no filter, but the empty text is one: "not observed"."""
    return df if value is None else df.where(F.col(column) == value.strip().lower())


def time_range(df: DataFrame, start: int | None, end: int | None, *, closed: bool,
               column: str = "ts") -> DataFrame:
    """`start <= ts <= end` when closed, `start <= ts < end` otherwise; null is unbounded. On a
    table with its day as a partition only the days in question are opened."""
    by_day = column == "ts" and DAY in df.columns
    if start is not None:
        df = df.where(F.col(column) >= start)
        df = df.where(F.col(DAY) >= day_of(F.lit(start))) if by_day else df
    if end is not None:
        df = df.where(F.col(DAY) <= day_of(F.lit(end))) if by_day else df
        df = df.where(F.col(column) <= end) if closed else df.where(F.col(column) < end)
    return df


def id_filter(df: DataFrame, ids: DataFrame, *, keep: bool) -> DataFrame:
    return df.join(ids.select("tenant_id", "id").distinct(), ["tenant_id", "id"],
                   "left_semi" if keep else "left_anti")


def clamp_limit(kind: str, limit: int | None) -> int:
    default, top = PAGE_SIZES[kind]
    return default if limit is None or limit <= 0 else min(limit, top)


def resolve_offset(offset: int | None, top: int = MAX_OFFSET) -> int:
    if offset is None:
        return 0
    if offset < 0 or offset > top:
        raise ValueError(f"offset must lie between 0 and {top}: {offset}")
    return offset


def search_term(term: str | None) -> str:
    if not has_text(term) or not 2 <= len(term.strip()) <= 200:
        raise ValueError("search terms have 2 to 200 characters")
    return term.strip()


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """`size` rows after `offset`, with `has_more` decided by reading one row more."""
    probed = df.orderBy(*order).offset(offset).limit(size + 1)
    # The window holds at most the page and that one row.
    counted = probed.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > size)
    return counted.orderBy(*order).limit(size)


def top_per(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """The first rows of every key and `has_more`; ranks are cut before the shuffle as well."""
    by_key = Window.partitionBy(*keys)
    probed = df.withColumn("_rank", F.row_number().over(by_key.orderBy(*order))).where(F.col("_rank") <= size + 1)
    counted = probed.withColumn("has_more", F.count("*").over(by_key) > size)
    return counted.where(F.col("_rank") <= size).drop("_rank")


def newest_first(df: DataFrame, tie: str = "id") -> list[Column]:
    return [F.desc("ts"), F.col(tie)]
