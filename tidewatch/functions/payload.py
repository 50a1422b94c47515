"""Expressions over decoded payloads: a JSON string column, parsed once to VARIANT.

Paths compile to literals, so candidate lists need no join. Numbers keep their decimal text: a
reading is taken if the leaf is a JSON number, or a string that is a plain decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plain decimals, as strings in payloads may have them.
DECIMAL_TEXT = r"\A-?[0-9]+(\.[0-9]+)?\z"
#: Type of readings inside plans.
READING = "decimal(38,12)"

Path = tuple[str, ...]


def parsed(column: str = "object") -> Column:
    return F.try_parse_json(F.col(column))


def _quoted(segment: str) -> str:
    if '"' not in segment:
        return f'["{segment}"]'
    if "'" not in segment:
        return f"['{segment}']"
    raise ValueError(f"a path segment can't hold both kinds of quotes: {segment!r}")


def _spellings(path: Path) -> list[str]:
    """Variant paths for a list of segments: a number may be a key or an array's index."""
    out = ["$"]
    for segment in path:
        forms = [_quoted(segment)] + ([f"[{int(segment)}]"] if segment.isdigit() else [])
        out = [a + b for a in out for b in forms]
    return out


def _get(payload: Column, path: Path, kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(payload, p, kind) for p in _spellings(path)])


def leaf_text(payload: Column, path: Path) -> Column:
    """The leaf as text; null where it is absent or JSON null."""
    return _get(payload, path, "string")


def leaf_number(payload: Column, path: Path) -> Column:
    """The leaf as a decimal; null where it isn't a number or plain decimal text."""
    leaf = _get(payload, path, "variant")
    kind = F.schema_of_variant(leaf)
    text = leaf_text(payload, path)
    numeric = kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.when(numeric, _get(payload, path, READING)).when(
        (kind == "STRING") & text.rlike(DECIMAL_TEXT), text.try_cast(READING)
    )


def first_of(values: list[Column], labels: list[str]) -> tuple[Column, Column]:
    """The first value that isn't null, and its label."""
    which = F.lit(None).cast("string")
    for value, name in reversed(list(zip(values, labels))):
        which = F.when(value.isNotNull(), F.lit(name)).otherwise(which)
    return F.coalesce(*values), which


def is_undecoded(column: str = "object", v: Column | None = None) -> Column:
    """SQL null, JSON null, {} and text that isn't JSON. v: the parsed payload, if it is there."""
    v = parsed(column) if v is None else v
    return F.col(column).isNull() | F.coalesce(F.is_variant_null(v), F.lit(False)) | (F.schema_of_variant(v) == "OBJECT<>")


def readings(uplinks: DataFrame, paths: dict[str, Path], *columns: str) -> DataFrame:
    """columns, path, num: every numeric reading of every path of uplinks with a payload."""
    rows = uplinks.select(*columns, parsed().alias("_v"))
    each = F.array(*[F.struct(F.lit(n).alias("path"), leaf_number(F.col("_v"), p).alias("num")) for n, p in paths.items()])
    return rows.select(*columns, F.inline(F.filter(each, lambda x: x["num"].isNotNull())))
