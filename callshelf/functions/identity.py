"""Content and interface identifiers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callshelf.functions.fixed_values import BASE32, CID_PREFIX_HEX
from callshelf.functions.text import strip

_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_CID_CHARS = 58  # 36 bytes in base32 without padding


def cid(text: Column) -> Column:
    """CIDv1 of a text: ``b`` plus base32 of prefix and SHA-256.

    ``conv`` writes base 32 for up to 64 bits, so the 288 bits are taken as five
    groups of 60 bits (15 hex digits, 12 base32 digits), zero-padded on the right.
    """
    digits = F.concat(F.lit(CID_PREFIX_HEX), F.sha2(text, 256), F.lit("000"))
    groups = [
        F.lpad(F.conv(F.substring(digits, 15 * i + 1, 15), 16, 32), 12, "0") for i in range(5)
    ]
    encoded = F.translate(F.concat(*groups), _CONV_DIGITS, BASE32)
    return F.concat(F.lit("b"), F.substring(encoded, 1, _CID_CHARS))


def code_text(signature: Column, docstring: Column, source_code: Column) -> Column:
    """The text a content identifier covers."""
    return F.concat(signature, F.coalesce(docstring, F.lit("")), source_code)


def signature_shape(signature: Column) -> Column:
    """The signature without keyword and name: ``(x: int) -> int:``.

    A class without bases has no shape; a text that is no signature is its own.
    """
    paren, colon = F.instr(signature, "("), F.instr(signature, ":")
    from_paren = F.substring(signature, paren, F.length(signature))
    is_def = signature.startswith("def ") | signature.startswith("async def ")
    is_class = signature.startswith("class ")
    has_bases = (paren > 0) & ((colon == 0) | (paren < colon))
    return (
        F.when(is_def & (paren > 0), from_paren)
        .when(is_class & has_bases, from_paren)
        .when(is_class & (colon > 0), F.lit(""))
        .otherwise(signature)
    )


def first_line(docstring: Column) -> Column:
    return F.coalesce(strip(F.substring_index(docstring, "\n", 1)), F.lit(""))


def interface_text(
    signature: Column, docstring: Column, code_type: Column, file_path: Column
) -> Column:
    """The text an interface identifier covers: stable when only the body changes."""
    return F.concat(signature_shape(signature), first_line(docstring), code_type, file_path)


def short_id(identifier: Column) -> Column:
    return F.substring(identifier, 1, 12)
