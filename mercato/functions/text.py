"""Text expressions: cleaning, fingerprints, classification ladders, dates, JSON repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chatty import json_object  # noqa: F401

NULLISH = ("", "null", "none", "nan", "n/a", "-")


def as_text(s: Column) -> Column:
    """Text that means nothing becomes null."""
    return F.when(F.lower(F.trim(s)).isin(*NULLISH), None).otherwise(s)


def fix_mojibake(s: Column, rounds: int = 3) -> Column:
    """UTF-8 that was read as Latin-1, up to ``rounds`` times over, is read again where its lead bytes show and the result is valid."""
    for _ in range(rounds):
        again = F.try_validate_utf8(F.encode(s, "ISO-8859-1").cast("string"))
        s = F.when(s.rlike("[ÃÂ][\u0080-¿]"), F.coalesce(again, s)).otherwise(s)
    return s


def row_hash(*parts: Column) -> Column:
    """md5 of the parts joined by a bar; null is empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def batch_key(ident: Column) -> Column:
    return F.substring(F.md5(ident.cast("string")), 1, 5)


def head_print(s: Column, n: int = 24) -> Column:
    """The first letters and digits, for telling near-equal heads."""
    return F.substring(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", ""), 1, n)


def letter_ratio(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]", "")) / F.nullif(F.length(s), F.lit(0))


def strip_badges(title: Column, badges: tuple[str, ...] = ("new", "sale", "hot", "official", "promo")) -> Column:
    """Badges stacked before or behind a title go; a title of badges only stays."""
    b = "|".join(badges)
    out = F.trim(F.regexp_replace(F.regexp_replace(title, rf"(?i)^(?:\s*(?:{b})\b[\s:!\-]*)+", ""), rf"(?i)(?:[\s\-]+(?:{b})!?)+\s*$", ""))
    return F.when(out == "", title).otherwise(out)


def tokens(s: Column) -> Column:
    """Lower-case Latin words and numbers; neighbouring CJK characters as pairs."""
    latin = F.regexp_extract_all(F.lower(s), F.lit(r"([a-z0-9À-ɏ]+)"), 1)
    runs = F.regexp_extract_all(s, F.lit(r"([一-鿿]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.concat(latin, pairs)


def detect_condition(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike(r"refurb|reacondicionad|recondicionad|vitrine"), "refurb").when(t.rlike(r"\b(used|usado|seminovo)\b"), "used").otherwise("new")


def event_kind(text: Column) -> Column:
    """The first of promotion, rumour, review, software, launch whose words the text has."""
    t = F.lower(text)
    return F.coalesce(
        F.when(t.rlike(r"\b(sale|discount|promo|oferta)"), "promo"), F.when(t.rlike(r"\b(rumou?r|leak|filtra)"), "rumor"), F.when(t.rlike(r"\b(review|hands-on|rese)"), "review"),
        F.when(t.rlike(r"\b(update|android|firmware)"), "software"), F.when(t.rlike(r"\b(launch|announce|lanza)"), "launch"), F.lit("other"),
    )


#: Texts of pages and controls that stand where a review should be.
ICON_WORDS = ("keyboard_arrow_up", "keyboard_arrow_down", "expand_more", "star_border", "chevron_right", "thumb_up")
CONTROLS = ("write a review", "see all reviews", "customer reviews", "escribir una opinion", "ver todas las opiniones", "avaliar produto")
PAGE_WORDS = ("add to cart", "cookie policy", "sign in", "privacy policy", "agregar al carrito", "iniciar sesion", "adicionar ao carrinho")
UI_NOISE = ("icon_only", "ui_only", "chrome", "scale_only", "histogram", "summary", "rating_dist", "low_letter", "vertical_hist")


def review_reject_reason(s: Column, least: int = 15, least_letters: float = 0.55) -> Column:
    """Why a text is no review: the first of eleven reasons that holds, or null.

    ``too_short`` and ``not_language`` may hit genuine short reviews; only the reasons in ``UI_NOISE`` are safe to delete by.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), "[ \t]+", " "))
    icons = "(?i)\\b(" + "|".join(ICON_WORDS) + ")\\b"
    t = F.trim(F.regexp_replace(F.regexp_replace(raw, icons, " "), "[ \t]+", " "))
    low, flat = fold(t), F.regexp_replace(t, "\\s+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.filter(lines, lambda x: x.rlike("^[0-9.,]{1,7}$"))
    many = lambda p, n: F.size(F.regexp_extract_all(flat, F.lit(p), 0)) >= n
    return (
        F.when(F.length(t) < least, F.when(raw.rlike(icons), "icon_only").otherwise("too_short"))
        .when(low.isin(*CONTROLS), "ui_only").when(low.rlike("|".join(PAGE_WORDS)), "chrome")
        .when(t.rlike("^[0-9][0-9 /.,]*$"), "scale_only").when(flat.rlike("(?i)\\b5 [0-9]+ 4 [0-9]+ 3 [0-9]+ 2 [0-9]+"), "histogram")
        .when(flat.rlike("(?i)[0-9][.,][0-9] (out of|de|sobre) 5|based on [0-9]+ reviews"), "summary")
        .when(many("(?i)[1-5] (stars?|estrellas?|estrelas?)", 3) | many("\\b[1-5] +[0-9]{1,3} ?%", 3), "rating_dist")
        .when(letter_ratio(t) < least_letters, "low_letter").when((F.size(lines) >= 4) & (F.size(bare) >= 0.5 * F.size(lines)), "vertical_hist")
        .when(~(t.rlike("\\p{L}{8,}") | many("\\p{L}{3,}", 4)), "not_language")
    )


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")


def parse_date(s: Column) -> Column:
    """The first format that fits: ISO, day/month/year, "2 Jan 2024"."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy")])


def relative_date(text: Column, base: Column) -> Column:
    """"3 days ago", "2 weeks ago": counted back from ``base``."""
    n = F.regexp_extract(F.lower(text), r"(\d+)\s*(day|week|month|year)s? ago", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(text), r"(\d+)\s*(day|week|month|year)s? ago", 2)
    days = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    return F.date_sub(base, n * days)


#: What tells an intercepted page, by kind; the first kind that shows counts.
BLOCK_WORDS = {
    "captcha": ("captcha", "are you a robot", "verify you are human"),
    "throttled": ("too many requests", "rate limit", "access denied"),
    "challenge": ("checking your browser", "enable javascript", "just a moment"),
    "login_wall": ("log in to continue", "login to continue", "sign in to see"),
}


def block_kind(text: Column, head: int = 4000) -> Column:
    """Captcha, throttled, challenge or login wall by the page's head, else none."""
    t = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    return F.coalesce(*[F.when(t.rlike("|".join(words)), kind) for kind, words in BLOCK_WORDS.items()], F.lit("none"))


def seller_kind(seller: Column, brand: Column, channel_kind: Column) -> Column:
    """Ladder: the brand's own store, a seller named as the channel's own, an official store of the brand, another name, unknown."""
    s = F.lower(F.trim(seller))
    return (
        F.when(channel_kind == "brand_store", "brand_official").when(s.isNull() | (s == ""), "unknown").when(s.rlike("^(sold|shipped) by us|retailer$"), "self_operated")
        .when(s.contains(F.lower(brand)) & s.rlike("official|oficial"), "brand_official").otherwise("third_party")
    )
