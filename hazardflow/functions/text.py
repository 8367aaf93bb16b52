"""Text and digest helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_HEX_PIECE = 15  # 60 bits: the longest hex run that fits a signed 64-bit value


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space; plain ``trim`` would only remove blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(hex_text: Column, digits: int) -> list[Column]:
    """The digest as integers, least significant piece first."""
    pieces = []
    end = digits
    while end > 0:
        start = max(end - _HEX_PIECE, 0)
        pieces.append(F.conv(F.substring(hex_text, start + 1, end - start), 16, 10).cast("bigint"))
        end = start
    return pieces


def digest_mod(hex_text: Column, digits: int, modulus: int) -> Column:
    """A hex digest of ``digits`` characters modulo a small number, without big integers.

    Each piece is weighted by the power of 16 it stands for, taken modulo ``modulus``.
    """
    total = F.lit(0).cast("bigint")
    for position, piece in enumerate(_pieces(hex_text, digits)):
        weight = pow(16, _HEX_PIECE * position, modulus)
        total = total + (piece % F.lit(modulus)) * F.lit(weight)
    return total % F.lit(modulus)
