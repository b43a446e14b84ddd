"""Bit fields of cell ids as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    width: int
    signed: bool


def parse_encoding(text: str) -> dict[str, Field]:
    """Fields of `name:width` (after the one before) and `name:offset:width` items; a negative width is signed."""
    fields: dict[str, Field] = {}
    end = 0
    for token in filter(None, (t.strip() for t in text.split(","))):
        name, *numbers = token.split(":")
        if not name or len(numbers) not in (1, 2):
            raise ValueError(f"cannot read the field {token!r}")
        width, offset = int(numbers[-1]), int(numbers[0]) if len(numbers) == 2 else end
        end = offset + abs(width)
        fields[name] = Field(name, offset, abs(width), width < 0)
    return fields


def field(cell_id: Column | str, spec: str | dict[str, Field], name: str, *, signed: bool | None = None) -> Column:
    """A field's value; by default with its sign, signed=False never extends the sign."""
    fields = parse_encoding(spec) if isinstance(spec, str) else spec
    if name not in fields:
        raise ValueError(f"the encoding has no field {name!r}")
    f = fields[name]
    cell = F.col(cell_id) if isinstance(cell_id, str) else cell_id
    if f.signed if signed is None else signed and f.signed:
        return F.shiftright(F.shiftleft(cell, 64 - f.offset - f.width), 64 - f.width)
    if f.offset == 0 and f.width == 64:
        return cell
    return F.shiftrightunsigned(cell, f.offset).bitwiseAND(F.lit((1 << f.width) - 1).cast("bigint"))


def decode(cell_id: Column | str, spec: str) -> Column:
    """Struct of all fields, with signs."""
    fields = parse_encoding(spec)
    return F.struct(*[field(cell_id, fields, n).alias(n) for n in fields])


def unsigned_order(cell_id: Column | str) -> Column:
    """Sorts BIGINT cell ids as the unsigned numbers they stand for."""
    cell = F.col(cell_id) if isinstance(cell_id, str) else cell_id
    return cell.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
