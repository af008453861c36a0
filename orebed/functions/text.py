"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters of a token, letters and digits of ASCII and the common CJK block.
TOKEN_CHARS = "0-9A-Za-z一-龥"


def flip_name(name: Column) -> Column:
    """`Last, First` as `First Last`, trimmed; a name without a comma is only trimmed."""
    parts = F.split(name, ",")
    return F.when(F.size(parts) > 1, F.concat_ws(" ", F.trim(F.get(parts, 1)), F.trim(F.get(parts, 0)))).otherwise(F.trim(name))


def parse_chat_line(line: Column) -> dict[str, Column]:
    """Fields of `date . . . hh:mm AM from A to B: message`; null where the line has no such field.

    The message is the text between the second and any third colon after the time's own, as the fields are
    counted by colons.
    """
    token = F.split(line, " ")
    sender = F.trim(F.nullif(F.regexp_extract(line, "from (.*?) to", 1), F.lit("")))
    receiver = F.trim(F.nullif(F.regexp_extract(line, " to(.*?):", 1), F.lit("")))
    return {
        "date": F.get(token, 0),
        "time": F.concat(F.get(token, 4), F.get(token, 5)),
        "sender": sender,
        "receiver": receiver,
        "message": F.trim(F.get(F.split(line, ":"), 2)),
    }


def is_integer(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def tokens(text: Column) -> Column:
    """Tokens in order: integers lose one trailing comma or point, other items are cut at every other character.

    Line breaks and tabs are taken out first, so words join across them.
    """
    items = F.split(F.translate(text, "\n\t", ""), " ")

    def of(item: Column) -> Column:
        bare = F.regexp_replace(item, "[,.]$", "")
        return F.when(is_integer(bare), F.array(bare)).otherwise(F.split(item, f"[^{TOKEN_CHARS}]+"))

    return F.filter(F.flatten(F.transform(items, of)), lambda t: t != "")


def ascii_lower(text: Column) -> Column:
    """Lower case without any character outside ASCII."""
    return F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def title_of_words(text: Column) -> Column:
    return F.initcap(text)


def list_text(items: Column) -> Column:
    """An array as `'a', 'b'`."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")


def dotted_path(parts: Column) -> Column:
    return F.array_join(parts, ".")


def xpath_of(path: Column) -> Column:
    """A dotted path as an XPath; an `@key` segment becomes an attribute step."""
    return F.concat(F.lit("/"), F.replace(path, F.lit("."), F.lit("/")))


def utf8_mod(text: Column, modulus: int) -> Column:
    """The number that the UTF-8 bytes of a text spell in base 256, modulo `modulus`, by Horner's rule."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, b: (h * 256 + b) % modulus)


def trailing_zeros(value: Column) -> Column:
    """Trailing zeros of the binary form; 1 for zero, whose form is one digit."""
    return F.length(F.bin(value)) - F.length(F.rtrim(F.bin(value), F.lit("0")))
