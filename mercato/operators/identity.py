"""Product identity: what a title is, which records are one product, and what becomes of links and catalogues when that changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import Rule, let, name_key, normalise, refined, usable, verdict
from .clusters import components, ties


def identity(title: Column, rules: Sequence[Rule], ladder: Sequence[Sequence[str]]) -> Column:
    """model, key, source, kind, is_bucket, reason, conflict of a title.

    In order: an ``accessory`` rule ends it; a ``sku`` rule is authoritative, but where an ``attached`` rule sees an accessory in the
    same title the two disagree and nothing is decided (conflict); a series' name is made finer by its ``refine`` rules; without an
    authoritative name the title is normalised. ``bucket`` rules then say whether the name holds several products. A title
    without a usable name has no key.
    """
    def of(t: Column) -> Column:
        accessory, sku = verdict(t, rules, "accessory"), verdict(t, rules, "sku")
        attached = verdict(t, rules, "attached")
        fine = refined(t, sku, rules)

        def told(model: Column, source: str, kind: str = "device", conflict: bool = False) -> Column:
            reason = verdict(F.lower(model), rules, "bucket")
            return F.struct(
                model.alias("model"), F.when(usable(model, 3), name_key(model)).alias("key"), F.lit(source).alias("source"), F.lit(kind).alias("kind"),
                F.coalesce(reason.isNotNull(), F.lit(False)).alias("is_bucket"), reason.alias("reason"), F.lit(conflict).alias("conflict"),
            )

        none = F.lit(None).cast("string")
        return (
            F.when(accessory.isNotNull(), told(none, "rule", "accessory"))
            .when(sku.isNotNull() & attached.isNotNull(), told(sku, "rule", "accessory", True))
            .when(sku.isNotNull() & fine.isNotNull(), told(fine, "rule/refined"))
            .when(sku.isNotNull(), told(sku, "rule")).otherwise(let(normalise(t, rules, ladder)["name"], lambda m: told(m, "name")))
        )

    return let(F.coalesce(title, F.lit("")), of)


def resolve(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """record, product, state, survivor: which records are one product.

    ``records``: record (long), name, authoritative (a name or null), verified (boolean). ``evidence``: record, key; records that share a key,
    directly or over others, are a cluster. A cluster with one authoritative name is ``sure``, with none ``open``, with several a
    ``conflict``, which is no decision: its records with an authoritative name are one product for each such name, the rest stay alone. The survivor
    of a product is its verified record, else the one with the longest name, else the smallest. Records without shared keys are products
    of their own. Records are taken to be distinct; a null record is left out. Nothing of a cluster is collected.
    """
    found = components(ties(evidence))
    rows = records.where("record is not null").join(found, "record", "left").withColumn("cluster", F.coalesce("cluster", "record"))
    names = rows.groupBy("cluster").agg(F.min("authoritative").alias("low"), F.max("authoritative").alias("high"))
    state = F.when(F.col("low").isNull(), "open").when(F.col("low") == F.col("high"), "sure").otherwise("conflict")
    rows = rows.join(names, "cluster").withColumn("state", state)
    alone = F.when((F.col("state") == "conflict") & F.col("authoritative").isNull(), F.col("record"))
    group = ["cluster", "split", "alone"]
    rows = rows.select("*", F.when(F.col("state") == "conflict", F.col("authoritative")).alias("split"), alone.alias("alone"))
    best = F.struct(F.coalesce("verified", F.lit(False)).alias("verified"), F.length(F.coalesce("name", F.lit(""))).alias("chars"), (-F.col("record")).alias("r"))
    heads = rows.groupBy(*group).agg(F.min("record").alias("product"), F.max(best).alias("best"))
    same = [rows[c].eqNullSafe(heads[c]) for c in group[1:]]
    both = rows.join(heads, (rows["cluster"] == heads["cluster"]) & same[0] & same[1])
    return both.select(rows["record"], "product", "state", (-F.col("best.r")).alias("survivor"))


def upsert_products(catalogue: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalogue after a batch: brand, category, key, name, verified, is_bucket, is_new.

    One row for a key. Marks go one way: a verified name replaces one that is not, never the reverse; a bucket may become a single product, never
    the reverse. Of a batch's rows of one key the verified one counts, else the first name in order. Rows without a key make no product.
    """
    on = ["brand", "category", "key"]
    batch = incoming.where("key is not null").groupBy(*on).agg(F.min(F.struct((~F.col("verified")).alias("no"), "name")).alias("best"), F.max("verified").alias("verified"), F.min("is_bucket").alias("is_bucket"))
    old = catalogue.select(*on, F.col("name").alias("had"), F.col("verified").alias("was_verified"), F.col("is_bucket").alias("was_bucket"))
    both = old.join(batch, on, "full")
    better = F.coalesce("verified", F.lit(False)) & ~F.coalesce("was_verified", F.lit(False))
    return both.select(
        *on, F.when(F.col("had").isNull() | better, F.col("best.name")).otherwise(F.col("had")).alias("name"), (F.coalesce("was_verified", F.lit(False)) | F.coalesce("verified", F.lit(False))).alias("verified"),
        F.when(F.col("was_bucket").isNull(), F.col("is_bucket")).otherwise(F.col("was_bucket") & F.coalesce("is_bucket", F.lit(True))).alias("is_bucket"), F.col("had").isNull().alias("is_new"),
    )


def tiers(text: Column, words: Sequence[str]) -> Column:
    """Which of the tier words a text has."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w.isin(*words)))


def tier_fit(name_tiers: Column, title_tiers: Column) -> Column:
    """How well a product's tier words fit a title's: those both have, less those only the product has."""
    return F.size(F.array_intersect(name_tiers, title_tiers)) - F.size(F.array_except(name_tiers, title_tiers))


def relink(links: DataFrame, products: DataFrame, words: Sequence[str]) -> DataFrame:
    """link, before, after, verdict: what becomes of each link of a title to a product.

    ``links``: link, brand, category, title, key (of the title), product. ``products``: product, brand, category, name, key, is_bucket. A
    link whose key is its product's stays (``same``), as do those of buckets and those without a key. Else another product with the title's
    key in the same brand and category is looked for: ``missing`` if there is none, ``bucket`` if it holds several, ``no_better`` if it does not fit the
    title's tier words better than the present one (links are kept, never moved by a doubtful sign), else ``move``. Of several
    products with one key the smallest counts.
    """
    have = products.select(F.col("product"), F.col("name").alias("name"), F.col("key").alias("had_key"), F.col("is_bucket").alias("had_bucket"))
    target = products.where("key is not null").groupBy("brand", "category", "key").agg(F.min(F.struct("product", "name", "is_bucket")).alias("to"))
    rows = links.join(have, "product").join(target, ["brand", "category", "key"], "left")
    said = tiers(F.col("title"), words)
    better = tier_fit(tiers(F.col("to.name"), words), said) > tier_fit(tiers(F.col("name"), words), said)
    what = (
        F.when(F.col("had_bucket"), "held").when(F.col("key").isNull(), "unknown").when(F.col("key") == F.col("had_key"), "same").when(F.col("to").isNull(), "missing")
        .when(F.col("to.product") == F.col("product"), "same").when(F.col("to.is_bucket"), "bucket").when(~better, "no_better").otherwise("move")
    )
    rows = rows.withColumn("verdict", what)
    return rows.select("link", F.col("product").alias("before"), F.when(F.col("verdict") == "move", F.col("to.product")).otherwise(F.col("product")).alias("after"), "verdict")
