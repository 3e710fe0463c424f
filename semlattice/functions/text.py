"""Column functions that the mapping and search jobs share. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that Python's float() takes and Spark's cast may not, and the other way round.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(c, F.lit(WHITE))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (strip(c.cast("string")) != "")


def slug(c: Column) -> Column:
    """Percent-encodes the trimmed value but for letters, digits and _ . ~ -"""
    encoded = F.url_encode(strip(c.cast("string")))
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unslug(c: Column) -> Column:
    """The value that slug() encoded; null if it isn't well formed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def from_template(template: str, value: Column) -> Column:
    """The template with {id} replaced by the value's slug."""
    before, _, after = template.partition("{id}")
    return F.concat(F.lit(before), slug(value), F.lit(after))


def as_list(c: Column, kind: str, split: bool = True) -> Column:
    """array<string>: null gives none; arrays and JSON lists give their non-blank items; a value with ';' is split if asked; else one item."""
    if kind.startswith("array"):
        return F.filter(F.transform(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), strip), not_blank)
    text = strip(c.cast("string"))
    none = F.array().cast("array<string>")
    listed = text.startswith("[") & text.endswith("]")
    json = F.when(listed, F.from_json(text, "array<string>"))
    parts = F.split(text, ";") if split else F.array(text)
    items = F.filter(F.transform(F.coalesce(json, parts, none), strip), not_blank)
    # most values are plain: no list is parsed or walked for them
    plain = ~listed & ~F.contains(text, F.lit(";")) if split else ~listed
    return F.when(text.isNull() | (text == ""), none).when(plain, F.array(text)).otherwise(items)


def integer_form(c: Column) -> Column:
    """Lexical form of int(float(x)); null for what isn't a number."""
    number = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return number.try_cast("bigint").cast("string")


def decimal_form(c: Column) -> Column:
    """Lexical form of float(x), whole numbers with one decimal, zero with its sign; null for what isn't a number."""
    number = F.when(c.rlike(NUMBER), c.try_cast("double"))
    signed_zero = (number == 0) & F.ltrim(c).startswith("-")
    decimal = number.try_cast("decimal(38,10)")
    # ten decimals must hold the number, as they don't hold a negative zero
    plain = F.when((decimal.cast("double") == number) & ~signed_zero, decimal)
    trimmed = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"0+$", ""), r"\.$", ".0")
    return F.coalesce(trimmed, number.cast("string"))


def typed_form(c: Column, datatype: str) -> tuple[Column, str | None]:
    """The literal's lexical form and datatype; a null form leaves the value out."""
    text = c.cast("string")
    if datatype in ("integer", "int"):
        return integer_form(text), "integer"
    if datatype in ("decimal", "float"):
        return decimal_form(text), "decimal"
    return text, None


def last_segment(c: Column) -> Column:
    """What follows the last slash; null stays null."""
    return F.element_at(F.split(c, "/"), -1)


def holds(text: Column, part: Column) -> Column:
    """Whether text contains part, upper and lower case alike."""
    return F.contains(F.lower(text), F.lower(part))


def stable_bucket(c: Column, buckets: int) -> Column:
    """First ten hexadecimal digits of SHA-256 modulo the number of buckets."""
    return (F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 10), 16, 10).cast("bigint") % buckets).cast("bigint")


def owner_key(c: Column) -> Column:
    """Lower-case ASCII names stay; others become a hash. Null or empty: guest."""
    name = F.coalesce(F.nullif(c, F.lit("")), F.lit("guest"))
    return F.when(name.rlike("^[0-9a-z_-]+$"), name).otherwise(F.concat(F.lit("~uid-"), F.sha2(name, 256)))
