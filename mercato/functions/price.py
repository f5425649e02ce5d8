"""Price expressions: locale parsing, sanity bounds, discounts, tiers, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies without decimals, and those that write the comma as decimal sign.
NO_DECIMALS = ("CLP", "COP")
COMMA_DECIMALS = ("BRL", "ARS")


def parse_price(raw: Column, currency: Column) -> Column:
    """A number from a price text by the currency's own rules; null where there is none. Full-width digits and marks are read as plain ones.

    Where points and commas both stand and group by thousands, the last one is the decimal sign in any currency. Else: without decimals every separator groups thousands. With a comma as decimal sign points group. Else commas group, but one comma
    before at most two final digits is a decimal sign, as is a single point.
    """
    digits = F.regexp_extract(F.translate(raw, "０１２３４５６７８９．，", "0123456789.,"), r"[0-9]+(?:[.,][0-9]+)*", 0)
    point_last, comma_last = digits.rlike(r"^[0-9]{1,3}(,[0-9]{3})+[.][0-9]{1,2}$"), digits.rlike(r"^[0-9]{1,3}([.][0-9]{3})+,[0-9]{1,2}$")
    plain = F.regexp_replace(digits, "[.,]", "")
    comma = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    point = F.when(digits.rlike(r"^\d+,\d{1,2}$"), F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    return F.when(point_last, F.replace(digits, F.lit(","), F.lit(""))).when(comma_last, comma).when(currency.isin(*NO_DECIMALS), plain).when(currency.isin(*COMMA_DECIMALS), comma).otherwise(point).try_cast("double")


def is_sane(price: Column, low: Column, high: Column) -> Column:
    return price.isNotNull() & (price >= low) & (price <= high)


def discount(list_price: Column, sale_price: Column) -> Column:
    """Percent off the list price: null if either is unknown, 0 if the sale is not below."""
    return F.when(list_price.isNull() | sale_price.isNull() | (list_price <= 0), None).when(sale_price >= list_price, 0.0).otherwise((list_price - sale_price) / list_price * 100)


def price_scope(text: Column) -> Column:
    """``card`` if the price holds for holders of a card only."""
    return F.when(F.lower(text).rlike(r"\b(with|con|com) (the |la |o )?(card|tarjeta|cart[aã]o)\b"), "card").otherwise("public")


def installments(text: Column) -> Column:
    """months and amount of "12 x 99.90" and the like."""
    m = lambda g: F.regexp_extract(F.lower(text), r"(\d{1,2})\s*(?:x|meses de|cuotas de)\s*\$?\s*([\d.,]+)", g)
    return F.when(m(1) != "", F.struct(m(1).cast("int").alias("months"), F.replace(m(2), F.lit(","), F.lit("")).try_cast("double").alias("amount")))


def band_of(pct: Column) -> Column:
    """Five half-open bands of a deviation in percent."""
    return F.when(pct < -15, "much_lower").when(pct < -5, "lower").when(pct < 5, "level").when(pct < 15, "higher").otherwise("much_higher")


#: The storage steps of one price level each.
ROM_STEPS = (32, 64, 128, 256, 512, 1024, 2048)


def rom_bucket(rom: Column) -> Column:
    """The storage step a size falls in; an unknown size is a bucket of its own."""
    out = F.when(rom.isNull() | (rom <= 0), "unknown")
    for size in ROM_STEPS:
        out = out.when(rom <= size, f"<={size}")
    return out.otherwise(f">{ROM_STEPS[-1]}")


#: From which percentage a move is suspect, and from which implausible, by category.
TIER_BANDS = {"phone": (8, 20), "tablet": (8, 20), "pc": (8, 20), "wearable": (12, 30), "audio": (15, 40)}
OTHER_BAND = (10, 25)


def move_tier(pct: Column, category: Column, bands: dict[str, tuple[int, int]] = TIER_BANDS, other: tuple[int, int] = OTHER_BAND) -> Column:
    """Credible, suspect or implausible by half-open bands of the category."""
    edge = lambda i: F.coalesce(*[F.when(category == c, F.lit(b[i])) for c, b in bands.items()], F.lit(other[i]))
    return F.when(F.abs(pct) < edge(0), "credible").when(F.abs(pct) < edge(1), "suspect").otherwise("implausible")


def money(amount: Column, currency: Column) -> Column:
    return F.concat(currency, F.lit(" "), F.format_number(amount, 2))


def percent(pct: Column) -> Column:
    """Signed, one decimal; unknown is a dash."""
    return F.when(pct.isNull(), "-").otherwise(F.format_string("%+.1f%%", pct.cast("double")))
