"""Reading the type-specific JSON of an event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DETAIL


def parse_detail(detail: Column) -> Column:
    """Fixed struct; unknown keys are ignored, broken JSON gives nulls."""
    return F.from_json(detail, DETAIL)


def detail_text(detail: Column, field: str) -> Column:
    return F.get_json_object(detail, f"$.{field}")


def detail_number(detail: Column, field: str) -> Column:
    """Integer only where the JSON value is a number, so quoted digits stay unobserved."""
    value = F.try_variant_get(F.try_parse_json(detail), f"$.{field}", "variant")
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(value, "$", "int"))
