"""Which documents stand behind which instruments, and repairs of what links and amounts say.

Pairs meet on the company; scores add up signals, each a column, so one pass scores all pairs of a company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import bare_name, maturity_year
from ..functions.names import coupon_bps as coupon_of
from . import extraction, matching, text

#: Instrument types that are loans, and those that capacity instead of debt may be stated for.
LOANS = ("revolver", "term_loan_a", "term_loan_b", "term_loan", "abl", "credit_facility")
CAPACITY = ("revolver", "abl")
#: Words of a name that say nothing about which instrument it is.
PLAIN_WORDS = ("the", "and", "or", "of", "to", "for", "in", "a", "an")
LINKED, SURE = 0.50, 0.70
#: Instruments that no public document stands behind, by type or by what the name says, in order.
NO_DOCUMENT = (
    ("commercial_paper", ("commercial_paper", "commercial_paper_program"), (r"commercial\s*paper", r"\bcp\b\s*program")),
    ("bilateral_facility", (), ("bilateral", "uncommitted", r"bank\s*credit\s*facilit", r"bank\s*borrowing", r"other\s*bank", r"short.?term\s*loan\s*agreement", r"working\s*capital\s*facilit")),
    ("intercompany", (), ("intercompany", r"related\s*party", "affiliate")),
    ("foreign_local_facility", ("credit_line", "line_of_credit"), (r"local\s*(credit|facilit|line)", r"foreign\s*(credit|facilit|line)", r"non.?u\.?s\.?\s*(credit|facilit|borrowing)", r"international\s*(credit|facilit)", "yen.?denominated", "euro.?denominated", r"EUR\s*(fixed|floating)", r"GBP\s*(fixed|floating)")),
    ("securitization", ("receivables_facility", "abs", "asset_backed"), ("securitization", r"receivable.?\s*facilit", r"receivable.?\s*funding", "asset.?backed", r"floor\s*plan", "conduit")),
    ("finance_lease", ("finance_lease", "capital_lease"), (r"finance\s*lease", r"capital\s*lease", r"lease\s*obligation", "sale.?leaseback", r"equipment\s*obligation")),
    ("government_financing", (), (r"export\s*(credit|finance)", r"government\s*(loan|guarantee)", r"payroll\s*support", "FHLB", r"federal\s*home\s*loan")),
    ("project_finance", (), ("nonrecourse", "non.?recourse", r"project\s*financ", r"wind\s*(farm|project)", r"solar\s*(farm|project)")),
    ("letters_of_credit", (), ("^letter.?of.?credit", r"^l/?c\s*facilit", r"standby\s*letter")),
    ("aggregated_other", ("other",), (r"^other\s*(long.?term|short.?term)?\s*(debt|borrowing|financ|note)", r"^other\s*revolv", "^miscellaneous", r"various\s*(maturit|rate)")),
)


def has(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def points(condition: Column, weight: float) -> Column:
    return F.when(has(condition), weight).otherwise(0.0)


def indenture_score(coupon_bps: Column, maturity: Column, issued: Column, seniority: Column, name: Column, title: Column, content: Column, filed: Column) -> Column:
    """Signals of an indenture for a bond, 1 at most. What each is worth in the title and the content."""
    near = lambda found: (coupon_bps != 0) & F.exists(found, lambda x: F.abs(x - coupon_bps / 100) < 0.01)
    same_year = lambda found: F.array_contains(found, F.year(maturity))
    term = F.replace(extraction.seniority(title), F.lit("_"), F.lit(" "))
    rank = F.translate(F.lower(seniority), "_-", "  ")
    words = F.array_except(F.array_intersect(F.split(F.lower(name), r"\s+"), F.split(F.lower(title), r"\s+")), F.array(*map(F.lit, PLAIN_WORDS)))
    total = (
        F.when(has(near(text.coupons(title))), 0.35).otherwise(points(near(text.coupons(content)), 0.20))
        + F.when(has(same_year(text.years(title))), 0.35).otherwise(points(same_year(text.years(content)), 0.30))
        + points(F.contains(rank, term) | F.contains(term, rank), 0.15) + points(F.abs(F.datediff(filed, issued)) <= 30, 0.10) + points(F.size(words) >= 2, 0.15)
    )
    return F.least(total, F.lit(1.0))


def agreement_score(kind: Column, commitment: Column, issued: Column, title: Column, content: Column, filed: Column, today: Column) -> Column:
    """Signals of a credit agreement for a loan; a recent agreement alone isn't one. What each is worth."""
    word = F.when(kind.contains("revolv"), "revolving|revolver").when(kind.contains("term_loan"), "term loan").when(kind.contains("abl"), r"\babl\b|asset[- ]based")
    found = lambda t: word.isNotNull() & F.regexp_like(F.lower(t), word)
    amount = F.exists(text.amounts_cents(content), lambda x: F.abs(x - commitment) / F.greatest(commitment, F.lit(1)) < 0.15)
    total = (
        F.when(has(found(title)), 0.30).otherwise(points(found(content), 0.20)) + points((commitment != 0) & amount, 0.25) + points(F.abs(F.datediff(filed, issued)) <= 60, 0.15)
        + points(F.datediff(today, filed) <= 730, 0.15) + points(F.lower(title).contains("amended and restated"), 0.10) + points(F.lower(title).rlike("credit agreement|loan agreement"), 0.10)
    )
    return F.least(total, F.lit(1.0))


def best_documents(pairs: DataFrame, least: float = LINKED) -> DataFrame:
    """pairs (instrument_id, doc_id, score): each instrument's best document of `least` at least, the smaller id on ties, with its band."""
    w = Window.partitionBy("instrument_id").orderBy(F.col("score").desc(), "doc_id")
    best = pairs.where(F.col("score") >= least - 1e-9).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return best.withColumn("band", F.when(F.col("score") >= SURE - 1e-9, "high").otherwise("low"))


def single_agreement_links(instruments: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    """(instrument_id, doc_id, confidence): a company's only credit agreement goes with all its active loans without a document."""
    only = papers.where("kind = 'credit_agreement'").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    loans = instruments.where("is_active").where(F.col("instrument_type").isin(*LOANS)).join(links.select(F.col("instrument_id").alias("id")), "id", "left_anti")
    return loans.join(only, "company_id").select(F.col("id").alias("instrument_id"), "doc_id", F.lit(0.85).alias("confidence"))


def unlinked(instruments: DataFrame, links: DataFrame) -> DataFrame:
    """Active instruments that no document is linked to."""
    return instruments.where("is_active").join(links.select(F.col("instrument_id").alias("id")).where("id is not null"), "id", "left_anti")


def no_document(kind: Column, name: Column) -> Column:
    """Why no public document is to be expected, or null: the first entry of NO_DOCUMENT with the type or a pattern."""
    kind, name = F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(name, F.lit(""))
    return F.coalesce(*[F.when(kind.isin(*types) | name.rlike("(?i)" + "|".join(patterns)), F.lit(reason)) for reason, types, patterns in NO_DOCUMENT])


def indenture_rank(title: Column, content: Column) -> Column:
    """2 for a base indenture, 1 for any other, null for all else, officers' certificates among it."""
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    head = F.substring(c, 1, 2000)
    officer = t.rlike("officer|pricing|certificate") | head.rlike("action of authorized pricing officers|officer certificate")
    base = ~t.contains("supplemental") & (head.rlike("unlimited as to aggregate principal|base indenture|original indenture|may from time to time") | (F.length(c) > 20000))
    return F.when(~officer & t.contains("indenture"), F.when(base, 2).otherwise(1))


def base_indenture_links(instruments: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    """(instrument_id, doc_id, confidence): a company's newest base indenture, else its newest other one, for each of its
    active notes without a document of which one is to be expected. Of indentures filed on one day the smaller doc_id counts."""
    w = Window.partitionBy("company_id").orderBy(F.col("rank").desc(), F.col("filed").desc_nulls_last(), "doc_id")
    ranked = papers.where("kind = 'indenture'").withColumn("rank", indenture_rank(F.col("title"), F.col("content"))).where("rank is not null")
    best = ranked.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("company_id", "doc_id", F.when(F.col("rank") == 2, 0.60).otherwise(0.55).alias("confidence"))
    notes = unlinked(instruments, links).where("instrument_type is null or instrument_type rlike 'note|bond|debenture'").where(no_document(F.col("instrument_type"), F.col("name")).isNull())
    return notes.join(best, "company_id").select(F.col("id").alias("instrument_id"), "doc_id", "confidence")


def rate_text(coupon_bps: Column) -> Column:
    """A rate as footnotes write it, without zeros at its end."""
    return F.regexp_replace(F.format_string("%.2f", coupon_bps / 100), r"\.?0+$", "")


def footnote_hit(content: Column, coupon_bps: Column, year: Column, whole: bool = False) -> Column:
    """The coupon stands in the text with the year and a word for notes, both within 50 letters before it or 200 behind. whole: not as
    the end of another number, as 5.25 is of 15.25."""
    coupon = F.replace(rate_text(coupon_bps), F.lit("."), F.lit("\\."))
    y = F.concat(F.lit("\\b"), year.cast("string"), F.lit("\\b"))
    rate = F.concat(coupon, F.lit("\\s*%"))

    def around(word: Column, size: int) -> Column:
        return F.concat(F.lit("(?:(?<="), word, F.lit(f".{{0,{50 - size}}})|(?="), rate, F.lit(f".{{0,{200 - size}}}"), word, F.lit("))"))

    alone = F.lit(r"(?<![\d.])" if whole else "")
    return F.regexp_like(content, F.concat(F.lit("(?is)"), alone, around(y, 4), around(F.lit("\\b(?:due|notes?|senior|bonds?)\\b"), 3), rate)) & (F.length(content) >= 100) & (coupon_bps != 0)


def rates_said(content: Column) -> Column:
    """What stands before the percent signs of a text, and all its ends: every text of a rate that a sign may follow."""
    before = F.regexp_extract_all(content, F.lit(r"(?<![-\d.])([-\d.]++)\s*+%"), F.lit(1))
    ends = lambda x: F.transform(F.sequence(F.lit(1), F.least(F.length(x), F.lit(12))), lambda n: F.right(x, n))  # noqa: E731  (no text of a rate is longer)
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(before), ends)))


def footnote_links(instruments: DataFrame, notes: DataFrame, most: int = 3, whole: bool = False) -> DataFrame:
    """(instrument_id, doc_id, confidence): up to `most` footnotes (company_id, doc_id, content) that tell of each
    instrument, by doc_id. Coupon and year come from the name where the columns lack them; both are needed. They meet on the company and
    the rate; then the text is looked at. `whole` as in footnote_hit."""
    coupon = F.coalesce(F.nullif("rate_bps", F.lit(0)), coupon_of(F.col("name")))
    known = instruments.select("company_id", F.col("id").alias("instrument_id"), coupon.alias("coupon"), F.coalesce(F.year("maturity_date"), maturity_year(F.col("name"))).alias("year"))
    known = known.where("coupon is not null and year is not null").withColumn("rate", rate_text(F.col("coupon")))
    said = notes.select("company_id", "doc_id", F.explode(rates_said(F.col("content"))).alias("rate"))
    met = known.join(said, ["company_id", "rate"]).drop("rate").distinct()
    hits = met.join(notes.select("company_id", "doc_id", "content"), ["company_id", "doc_id"]).where(has(footnote_hit(F.col("content"), F.col("coupon"), F.col("year"), whole)))
    w = Window.partitionBy("instrument_id").orderBy("doc_id")
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("instrument_id", "doc_id", F.lit(0.65).alias("confidence"))


def plain_score(kind: Column, name: Column, doc_kind: Column, content: Column, head: int = 5000, name_head: int = 2000) -> Column:
    """Rate and year of the name in the document's first `head` letters, its type, and the ratio of the name to the first
    `name_head`. Types are compared as written, so `term loan` needs the blank. The ratio is worked out only where lengths allow 0.3."""
    low = F.lower(F.substring(content, 1, head))
    rate, year = F.regexp_extract(name, r"(\d+\.?\d*)\s*%", 1), F.regexp_extract(name, r"(?i)(?:due|maturing?)\s*(\d{4})", 1)
    kind = F.coalesce(kind, F.lit(""))
    tidy = F.trim(F.translate(F.lower(name), "-,.", " "))
    start = F.substring(low, 1, name_head)
    possible = (F.length(tidy) > 10) & (2 * F.least(F.length(tidy), F.length(start)) > 0.3 * (F.length(tidy) + F.length(start)))
    ratio = matching.sequence_ratio(F.when(possible, tidy), F.when(possible, start))
    return (
        points((rate != "") & F.contains(low, rate), 0.4) + points((year != "") & F.contains(low, year), 0.3)
        + points(kind.contains("term loan") & low.contains("term loan"), 0.3) + points(kind.contains("revolver") & low.contains("revolv"), 0.3)
        + points(F.lower(kind).contains("notes") & (doc_kind == "indenture"), 0.2) + F.when(has(ratio > 0.3), ratio * 0.3).otherwise(0.0)
    )


def plain_links(instruments: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    """The best document of `plain_score` for each active instrument without one, 0.5 at least."""
    pairs = unlinked(instruments, links).select("company_id", F.col("id").alias("instrument_id"), "instrument_type", "name").join(papers.where("kind in ('indenture', 'credit_agreement')").select("company_id", "doc_id", "kind", "content"), "company_id")
    score = plain_score(*[F.col(c) for c in ("instrument_type", "name", "kind", "content")])
    return best_documents(pairs.select("instrument_id", "doc_id", F.round(score, 6).alias("score")))


def note_descriptions(text: Column) -> Column:
    """`5.25% notes 2030` for each note that the text describes by coupon and year."""
    pattern = F.lit(r"(?i)(\d+\.?\d*)\s*%\s*(?:senior\s+secured\s+|senior\s+unsecured\s+|senior\s+|subordinated\s+)?notes?\s+due\s+(?:\w+\s+)?(?:\d{1,2},?\s+)?(\d{4})")
    each = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("rate"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("year"))
    return F.array_distinct(F.transform(each, lambda x: F.concat(F.format_string("%.2f", x["rate"].cast("double")), F.lit("% notes "), x["year"])))


def all_links(instruments: DataFrame, papers: DataFrame, today: Column, least: float = matching.KEEP, head: int = 50_000, body: int = 30_000) -> DataFrame:
    """(instrument_id, doc_id, score, relationship): every document of its company that an instrument meets with
    `least` or more. Instruments have a cusip and `issuer`, the issuer's name. The strongest signal counts, not their
    sum; an amount besides coupon and year adds a tenth, to 0.9 at most, which holds for stronger ones too. `head` and `body`
    are how far identifiers and issuers, and all else, are looked for. Loans without a signal go by `agreement_score`."""
    issuer = bare_name(F.col("issuer"))
    two = F.substring_index(issuer, " ", 2)
    known = instruments.select(
        "company_id", F.col("id").alias("instrument_id"), F.upper(F.replace("cusip", F.lit(" "), F.lit(""))).alias("cusip"), "instrument_type", "issue_date", issuer.alias("issuer"), F.when(F.length(two) >= 5, two).alias("two"),
        F.coalesce(F.nullif("rate_bps", F.lit(0)), coupon_of(F.col("name"))).alias("bps"), F.coalesce(F.year("maturity_date"), maturity_year(F.col("name"))).alias("year"),
        F.coalesce(F.nullif("outstanding", F.lit(0)), F.col("principal")).alias("amount"), F.coalesce("principal", F.lit(0)).alias("commitment"), note_descriptions(F.col("name")).alias("named"),
    ).withColumn("built", F.concat(F.format_string("%.2f", F.col("bps") / 100), F.lit("% notes "), F.col("year").cast("string")))
    start, text_body = F.substring("content", 1, head), F.substring("content", 1, body)
    read = papers.select(
        "company_id", "doc_id", "kind", "title", "content", "filed", extraction.cusips(F.upper(start)).alias("cusips"), F.lower(F.concat_ws("\n", "title", start)).alias("low"), note_descriptions(F.col("title")).alias("title_notes"),
        note_descriptions(text_body).alias("body_notes"), note_descriptions(F.col("content")).alias("notes"), F.concat(*[F.coalesce(text.coupons(t), F.array().cast("array<double>")) for t in (F.col("title"), text_body)]).alias("coupons"),
        text.years(text.without_party(text_body)).alias("body_years"), F.coalesce(text.years(text.without_party(F.col("title"))), F.array().cast("array<int>")).alias("title_years"), text.amounts_cents(text_body).alias("amounts"),
    )
    pairs = known.join(read, "company_id")
    c = F.col
    ours = F.filter(F.concat(F.coalesce("named", F.array().cast("array<string>")), F.array("built")), lambda x: x.isNotNull())
    days = F.abs(F.datediff("filed", "issue_date"))
    in_body = F.array_contains("body_years", c("year"))
    both = has(F.exists("coupons", lambda x: F.abs(x - c("bps") / 100) < 0.01)) & (has(in_body) | has(F.array_contains("title_years", c("year"))))
    rate = lambda x: F.substring_index(x, "%", 1).cast("double")
    alike = F.exists("notes", lambda x: (F.abs(F.round(rate(x) * 100, 6) - c("bps")) < 2) & (F.substring_index(x, " ", -1) == c("year").cast("string")))
    tranche = F.when(has(F.array_contains("notes", c("built"))), 0.80).otherwise(points(alike, 0.78))
    issued = (F.length("issuer") >= 3) & (c("low").contains(c("issuer")) | has(c("low").contains(c("two"))))
    strongest = F.greatest(
        points(F.array_contains("cusips", c("cusip")), 0.95), F.when(has(F.arrays_overlap(ours, "title_notes")), 0.90).otherwise(points(F.arrays_overlap(ours, "body_notes"), 0.75)),
        F.when(has(days == 0), 0.85).otherwise(points(days <= 7, 0.75)), points(issued & in_body, 0.65), points(both, 0.55), tranche,
    )
    amount = has((c("amount") > 0) & F.exists("amounts", lambda x: F.abs(x - c("amount")) / c("amount") < 0.05))
    raised = F.greatest(strongest, F.lit(0.45))
    score = F.when(amount, F.when(both | (tranche > 0), F.least(raised + 0.10, F.lit(0.90))).otherwise(raised)).otherwise(strongest)
    loan = has(F.lower("instrument_type").rlike("|".join(LOANS))) & (c("kind") == "credit_agreement")
    by_terms = agreement_score(*[c(n) for n in ("instrument_type", "commitment", "issue_date", "title", "content", "filed")], today)
    # each step stands in a list of one, so that the next reads its result instead of working it out again wherever it is named
    once = lambda x, then: F.element_at(F.transform(F.array(x), then), 1)
    best = once(F.round(score, 6), lambda x: F.when(loan & (x < least), F.greatest(x, F.round(by_terms, 6))).otherwise(x))
    scored = pairs.select("instrument_id", "doc_id", "title", F.explode(F.filter(F.array(best), lambda x: x >= least)).alias("score"))
    return scored.select("instrument_id", "doc_id", "score", matching.relationship(c("title")).alias("relationship"))


def covenant_targets(covenants: DataFrame, instruments: DataFrame) -> DataFrame:
    """(id, instrument_id) for covenants without an instrument: a tested financial one goes to the company's first
    loan, a change of control to its first bond, any other to its first loan; else to the other class."""
    name, kind = F.lower("name"), F.coalesce(F.lower("instrument_type"), F.lit(""))
    loan = F.when(name.rlike("note|bond|debenture|%"), False).when(name.rlike("term|loan|revolver|credit|facility"), True).when(kind.rlike("bond|note"), False).otherwise(kind.rlike("loan|credit"))
    first = instruments.where("is_active").groupBy("company_id").agg(F.min(F.when(loan, F.col("id"))).alias("loan"), F.min(F.when(~loan, F.col("id"))).alias("bond"))
    bonds_first = ~((F.col("covenant_type") == "financial") & (F.coalesce("test_metric", F.lit("")) != "")) & F.lower("covenant_name").contains("change of control")
    target = F.when(has(bonds_first), F.coalesce("bond", "loan")).otherwise(F.coalesce("loan", "bond"))
    return covenants.where("instrument_id is null").join(first, "company_id").select("id", target.alias("instrument_id")).where("instrument_id is not null")


def excess(instruments: DataFrame, totals: DataFrame, over: float) -> DataFrame:
    """Active instruments with an amount of companies whose instruments add up to more than `over` times the
    reported debt; totals: (company_id, instruments, reported)."""
    rows = instruments.where("is_active and outstanding is not null").join(totals.where("reported > 0"), "company_id")
    return rows.where(F.col("instruments") > F.col("reported") * over)


def capacity_amounts(instruments: DataFrame, totals: DataFrame) -> DataFrame:
    """Revolvers of such companies, whose amount is likely a capacity."""
    return excess(instruments, totals, 1.2).where((F.col("outstanding") > 0) & F.col("instrument_type").isin(*CAPACITY))


def outliers(instruments: DataFrame, totals: DataFrame) -> DataFrame:
    """Amounts filled in from documents that alone exceed the company's debt, where the sum is more than twice it."""
    return excess(instruments, totals, 2.0).where((F.col("outstanding") > F.col("reported")) & (F.get_json_object("attributes", "$.amount_source") == "doc_backfill"))


def stale_amounts(instruments: DataFrame, totals: DataFrame, before: str) -> DataFrame:
    """Amounts filled in from documents older than a day, of companies with too much debt."""
    stated = F.get_json_object("attributes", "$.amount_doc_date")
    return excess(instruments, totals, 1.2).where((F.col("outstanding") > 0) & (F.get_json_object("attributes", "$.amount_source") == "doc_backfill") & (stated < before))


def merged_duplicates(rows: DataFrame, group: list[str], order: list[Column], key: str, fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """(survivors, mapping): the first of each group by `order` keeps its key, and its nulls are filled from the
    next in order that know; the mapping is (key, keeper) of the others, for rows that point at them."""
    w = Window.partitionBy(*group).orderBy(*order, key)
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rows.withColumns({"nth": F.row_number().over(w), "keeper": F.first(key).over(all_of), **{c: F.coalesce(c, F.first(c, ignorenulls=True).over(all_of)) for c in fill}})
    return ranked.where("nth = 1").drop("nth", "keeper"), ranked.where("nth > 1").select(key, "keeper")


def repointed(rows: DataFrame, key: str, mapping: DataFrame, once: list[str]) -> DataFrame:
    """Rows whose key is a merged one point at its keeper; what then repeats by `once` comes once."""
    found = mapping.select(F.col(mapping.columns[0]).alias(key), "keeper")
    return rows.join(found, key, "left").withColumn(key, F.coalesce("keeper", key)).drop("keeper").dropDuplicates(once)


def new_filings(filings: DataFrame, watermark: DataFrame) -> DataFrame:
    """The newest filing of each (company_id, form) later than the company's stored day; all count where none is stored."""
    late = filings.join(watermark, "company_id", "left").where(F.col("stored").isNull() | (F.col("filed") > F.col("stored")))
    return late.groupBy("company_id", "form").agg(F.max_by(F.struct("filed", "accession"), F.struct("filed", "accession")).alias("x")).select("company_id", "form", "x.*")


def check_score(checks: list[Column]) -> Column:
    """{score, status}: the mean of the checks (passed 100, null for a warning 70, failed 0) and what it says."""
    each = [F.when(c.isNull(), 70.0).when(c, 100.0).otherwise(0.0) for c in checks]
    score = sum(each[1:], each[0]) / len(each)
    return F.struct(score.alias("score"), F.when(score >= 85, "pass").when(score >= 70, "needs_review").otherwise("fail").alias("status"))
