"""Who owns whom by register entries: scores of names and places, parents, and what speaks for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import bare_name
from . import matching

#: Country codes and the words that a jurisdiction is recognised by.
PLACES = (
    ("us", ("united states", "us", "usa", "delaware", "new york", "california", "texas", "nevada")),
    ("gb", ("united kingdom", "uk", "england", "wales", "scotland", "england and wales")), ("de", ("germany", "deutschland")), ("fr", ("france",)),
    ("nl", ("netherlands", "nederland")), ("ie", ("ireland",)), ("lu", ("luxembourg",)), ("ch", ("switzerland",)), ("jp", ("japan",)), ("ca", ("canada",)),
    ("au", ("australia",)), ("sg", ("singapore",)), ("hk", ("hong kong",)), ("cn", ("china",)), ("br", ("brazil",)), ("in", ("india",)), ("se", ("sweden",)),
    ("dk", ("denmark",)), ("no", ("norway",)), ("fi", ("finland",)), ("be", ("belgium",)), ("it", ("italy",)), ("es", ("spain",)), ("pt", ("portugal",)),
    ("kr", ("south korea", "korea")), ("tw", ("taiwan",)), ("mx", ("mexico",)), ("bm", ("bermuda",)), ("ky", ("cayman islands", "cayman")),
    ("vg", ("british virgin islands", "bvi")), ("je", ("jersey",)), ("gg", ("guernsey",)),
)
#: What the name, the place and an issued entry are worth.
NAME, PLACE, ISSUED = 0.70, 0.20, 0.10
#: Keys of an entity's or a link's attributes that name a source, and sources that are none.
ENTITY_KEYS = ("intermediate_source", "gleif_lei", "gleif_parent_lei", "companies_house_number")
LINK_KEYS = ("gleif_child_lei", "gleif_parent_lei", "ch_company_number", "psc_name", "evidence", "intermediate_source")
NO_SOURCE = ("", "no_attributes", "exhibit_21", "hierarchy_extraction")


def place_codes(place: Column) -> Column:
    """Codes of all countries that one of their words occurs in the place for."""
    p = F.lower(F.coalesce(place, F.lit("")))
    named = lambda words: reduce(lambda x, y: x | y, [F.contains(p, F.lit(w)) for w in words])
    return F.filter(F.array(*[F.when(named(words), code) for code, words in PLACES]), lambda c: c.isNotNull())


def same_place(place: Column, country: Column, register_place: Column) -> Column:
    """A country that the place names is the register's, or is in or named by the register's jurisdiction."""
    land, other = F.lower(F.coalesce(country, F.lit(""))), F.lower(F.coalesce(register_place, F.lit("")))
    ours = place_codes(place)
    return F.exists(ours, lambda c: (land == c) | F.contains(other, c)) | F.arrays_overlap(ours, place_codes(register_place))


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(bare_name(name), " ")), " ")


def register_matches(entities: DataFrame, register: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, lei, score): the best entry (lei, name, country, jurisdiction, status) of each entity (id, name,
    jurisdiction) with a score of `least` or more, the smaller lei on ties. What place and status can't make up
    must come from the names, so only names that near meet; without a name nothing matches."""
    enough = (least - PLACE - ISSUED) / NAME
    ours = entities.select("id", "jurisdiction", sorted_words(F.col("name")).alias("__bare")).where("__bare <> ''")
    theirs = register.select("lei", "country", F.col("jurisdiction").alias("place"), "status", sorted_words(F.col("name")).alias("__other")).where("__other <> ''")
    names = matching.similar_names(ours.select("__bare").distinct(), theirs.select(F.col("__other").alias("__bare")).distinct(), [], enough)
    pairs = ours.join(names.withColumnRenamed("score", "ratio"), "__bare").join(theirs, "__other")
    place = F.when(same_place(F.col("jurisdiction"), F.col("country"), F.col("place")), PLACE).otherwise(0.0)
    total = F.col("ratio") * NAME + place + F.when(F.upper("status") == "ISSUED", ISSUED).otherwise(0.0)
    scored = pairs.select("id", "lei", F.least(F.round(total, 6), F.lit(1.0)).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "lei")
    return scored.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def register_parents(matches: DataFrame, parents: DataFrame, register: DataFrame, entities: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, parent_id, parent_lei): the register's direct parent (child, direct, ultimate), else the ultimate one, as an
    entity of the same company by its name. An entity is not its own parent."""
    found = matches.join(parents.withColumnRenamed("child", "lei"), "lei").select("id", F.coalesce("direct", "ultimate").alias("parent_lei")).where("parent_lei is not null")
    named = found.join(register.select(F.col("lei").alias("parent_lei"), F.col("name").alias("parent_name")), "parent_lei").join(entities.select("id", "company_id"), "id")
    known = entities.select("company_id", F.col("id").alias("parent_id"), F.col("name").alias("known_name"))
    best = matching.fuzzy_join(named, known, "parent_name", "known_name", "id", least, ("company_id",))
    return best.where("id <> parent_id").select("id", "parent_id", "parent_lei")


def filled_keys(attributes: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that the JSON object gives a value that isn't empty, false or 0."""
    value = lambda k: F.get_json_object(attributes, f"$.{k}")
    return F.coalesce(*[F.when(~value(k).isin("", "false", "0", "[]", "{}"), F.lit(k)) for k in keys])


def entity_evidence(attributes: Column, tier: Column, guarantor: Column, borrower: Column) -> Column:
    """What speaks for an entity's place in the tree, or null."""
    key = filled_keys(attributes, ENTITY_KEYS)
    return (
        F.when(key.isNotNull(), F.concat(F.lit("attribute:"), key)).when(tier <= 2, F.concat(F.lit("structure_tier:"), tier.cast("string")))
        .when(guarantor, "is_guarantor").when(borrower, "is_borrower")
    )


def link_evidence(attributes: Column) -> Column:
    source = F.coalesce(F.get_json_object(attributes, "$.source"), F.lit(""))
    return ~source.isin(*NO_SOURCE) | filled_keys(attributes, LINK_KEYS).isNotNull()


def unsupported_parents(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(id, parent_id): entities (id, parent_id, attributes, tier, is_guarantor, is_borrower) set below a root without
    evidence of their own or of a link (child_id, attributes); these parents are to be cleared."""
    roots = entities.where("parent_id is null").select(F.col("id").alias("parent_id"))
    bare = entities.where(entity_evidence(*[F.col(c) for c in ("attributes", "tier", "is_guarantor", "is_borrower")]).isNull())
    shown = links.where(link_evidence(F.col("attributes"))).select(F.col("child_id").alias("id"))
    return bare.join(roots, "parent_id", "left_semi").join(shown, "id", "left_anti").select("id", "parent_id")
