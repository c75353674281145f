from pyspark.sql import functions as F

from ledgerline.operators import extraction as ex


def only(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_facts(spark):
    assert only(spark, "CUSIP 037833100 and 037833101, ISIN US0378331005.", ex.cusips) == ["037833100"]
    assert only(spark, "ISIN US0378331005, US0378331006", ex.isins) == ["US0378331005"]
    assert tuple(only(spark, "S&P rates us BB+ and Moody's has Ba1.", ex.agency_ratings)) == ("BB+", "Ba1")
    assert only(spark, "(Dollars in millions, except shares) amounts in millions", ex.scale) == 100_000_000
    assert only(spark, None, ex.cusips) is None
    assert only(spark, "Senior Secured Notes", ex.seniority) == "senior_secured"


def test_passages_and_sections(spark):
    text = "Intro.\nThe Borrower shall not permit the leverage ratio to exceed 4.50 to 1.00 at any time. Done."
    assert len(only(spark, text, ex.covenant_passages)) == 1
    assert only(spark, "Liquidity and Capital Resources\nWe have cash.", ex.section_type) == "mda_liquidity"
    df = spark.createDataFrame([(1, "x\n\nNegative Covenants\nNo liens.\n\nMISCELLANEOUS\nend")], "k int, t string")
    assert [(r.section_type, "No liens" in r.content, "end" in r.content) for r in ex.sections(df, "k", "t").collect()] == [("covenants", True, False)]
    assert only(spark, "One two. Three four five", lambda c: ex.cut_at_sentence(c, 9)) == "One two."


def test_json_is_repaired(spark):
    assert only(spark, '```json\n{"a": [1, 2,], // note\n "b": "x//y"', ex.repaired_json) == '{"a": [1, 2], "b": "x//y"}'
    assert only(spark, "nothing", ex.repaired_json) is None and only(spark, None, ex.repaired_json) is None
