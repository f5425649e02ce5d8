"""What a listing's title says: device or accessory, category, bundle, stock, a clean name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

#: Words that name a device, an accessory, a bundle; in the languages of the listings.
DEVICE_WORDS = ("phone", "smartphone", "celular", "tablet", "laptop", "notebook", "smartwatch", "earbuds", "audifonos")
ACCESSORY_WORDS = ("case", "funda", "capa", "protector", "mica", "cover", "charger", "cargador", "carregador", "cable", "cabo", "strap", "correa", "pulseira")
FOR_WORDS = ("for", "para", "compatible with", "compatible con", "compativel com")
BUNDLE_WORDS = ("bundle", "combo", "kit", "pack")
CATEGORY_WORDS = {
    "phone": ("phone", "smartphone", "celular"), "tablet": ("tablet",), "pc": ("laptop", "notebook"), "wearable": ("smartwatch", "watch"), "audio": ("earbuds", "headphones", "audifonos"),
}
CHROME_WORDS = ("add to cart", "free shipping", "sign in", "see more", "compare", "wishlist", "sponsored")
OUT_OF_STOCK = ("out of stock", "sold out", "agotado", "sin stock", "esgotado")


def _any(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def place_of(text: Column, words) -> Column:
    """Where the first of the words stands, from 1; null if none does."""
    at = F.regexp_instr(text, F.lit(_any(words)))
    return F.when(at > 0, at)


def product_kind(title: Column) -> Column:
    """device, accessory or unknown, by the order of the words.

    An accessory word before "for" and before any device word makes an accessory; a device for a device is a look-alike and unknown. Else
    the kind whose word comes first; a title without either is unknown, never guessed.
    """
    t = fold(title)
    guard = place_of(t, FOR_WORDS)
    head = F.substring(t, F.lit(1), guard - 1)
    tail = F.substring(t, guard, F.length(t))
    device, accessory = place_of(t, DEVICE_WORDS), place_of(t, ACCESSORY_WORDS)
    head_device, head_accessory = place_of(head, DEVICE_WORDS), place_of(head, ACCESSORY_WORDS)
    return (
        F.when(guard.isNotNull() & head_accessory.isNotNull() & (head_device.isNull() | (head_accessory < head_device)), "accessory")
        .when(guard.isNotNull() & head_device.isNotNull() & head_accessory.isNull() & place_of(tail, DEVICE_WORDS).isNotNull(), "unknown")
        .when(device.isNotNull() & (accessory.isNull() | (device < accessory)), "device").when(accessory.isNotNull(), "accessory").otherwise("unknown")
    )


def category_evidence(title: Column) -> Column:
    """Structs of place and category, each category once at its first word, in the order of place."""
    t = fold(title)
    return F.array_sort(F.array_compact(F.array(*[F.when(place_of(t, w).isNotNull(), F.struct(place_of(t, w).alias("at"), F.lit(c).alias("category"))) for c, w in CATEGORY_WORDS.items()])))


def is_bundle(title: Column) -> Column:
    """A bundle word, or a device with a plus and something more."""
    t = fold(title)
    return t.rlike(_any(BUNDLE_WORDS)) | (t.rlike(r"\+ *[a-z]") & place_of(t, DEVICE_WORDS).isNotNull())


def page_chrome(text: Column) -> Column:
    """Two and more words of page controls make a text page chrome, not a title."""
    t = F.lower(text)
    return sum((t.contains(w).cast("int") for w in CHROME_WORDS), F.lit(0)) >= 2


def plain_name(title: Column) -> Column:
    """Lower case without accents and control characters; decimal comma a point, hyphens and underscores spaces."""
    t = F.regexp_replace(F.regexp_replace(fold(title), r"\p{Cntrl}", " "), r"([0-9]),([0-9])", "$1.$2")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[-_]+", " "), r"\s+", " "))


def label(brand: Column, model: Column) -> Column:
    """Brand and model without saying the brand twice."""
    again = F.lower(model).startswith(F.concat(F.lower(brand), F.lit(" "))) | (F.lower(model) == F.lower(brand))
    return F.when(again, model).otherwise(F.concat_ws(" ", brand, model))


def in_stock(text: Column) -> Column:
    return ~F.lower(text).rlike(_any(OUT_OF_STOCK))


def core_model(title: Column) -> Column:
    """A title without memory sizes, colours, connectivity and promotion words; the title itself where nothing usable is left."""
    t = plain_name(title)
    for p in (r"\b[0-9]+ ?(gb|tb)( ?ram)?\b", r"\b(black|white|blue|red|green|negro|blanco|azul)\b", r"\b(5g|4g|lte|dual sim|unlocked|liberado)\b", r"\b(new|sale|oferta|official)\b", r"[+/]"):
        t = F.regexp_replace(t, p, " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) >= 3, t).otherwise(plain_name(title))
