"""Filings: inline facts, lists of subsidiaries, sections and stated figures on planted texts, edges among them."""

import random
import re

from pyspark.sql import functions as F

from ledgerline.operators import filings
from ledgerline.operators.graph import hierarchy_from_indents


def facts(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    rows = filings.inline_facts(df, "id", "html").orderBy("id", "pos").collect()
    return [[(r.kind, r.name, r.text, r.value, r.hidden) for r in rows if r.id == i] for i in range(len(pages))]


def test_inline_facts(spark):
    number = lambda text, more="": f'<ix:nonFraction name="n" contextRef="c" unitRef="u" {more}>{text}</ix:nonFraction>'
    got = facts(
        spark,
        None,
        "",
        "plain text with no tags",
        "<p>no facts < here",
        f"<p>{number('1,234.5', 'scale=\"6\" sign=\"-\"')}</p>",
        "<ix:nonNumeric name='outer'>A <b>bold</b> " + number("7") + " &amp; <ix:nonNumeric name='inner'>B</ix:nonNumeric></ix:nonNumeric>",
        '<ix:nonNumeric name="open">never <i>closed ' + number("5") + "</td></ix:unknown> end",
        '<ix:nonNumeric name="a" continuedAt="k">one </ix:nonNumeric><ix:continuation id="k" continuedAt="l">two <ix:exclude>page 9</ix:exclude></ix:continuation>x<ix:continuation id="l" continuedAt="k">three</ix:continuation>',
        number("—") + number("n/a") + number("$ 12") + number("3", 'scale="x"') + '<ix:nonFraction name="nil" xsi:nil="true"/>after',
        "<!-- " + number("9") + ' --><ix:hidden>' + number("8") + "</ix:hidden>" + '<ix:nonFraction name="q" title="a > b">2</ix:nonFraction>',
    )
    assert got[:4] == [[], [], [], []]
    assert got[4] == [("nonfraction", "n", "1,234.5", -1234500000, False)]
    assert got[5] == [("nonnumeric", "outer", "A bold 7 & B", None, False), ("nonfraction", "n", "7", 7, False), ("nonnumeric", "inner", "B", None, False)]
    assert got[6] == [("nonnumeric", "open", "never closed 5 end", None, False), ("nonfraction", "n", "5", 5, False)]
    assert got[7] == [("nonnumeric", "a", "one two three", None, False)]
    assert [x[3] for x in got[8]] == [0, None, 12, 3, None]
    assert got[9] == [("nonfraction", "n", "8", 8, True), ("nonfraction", "q", "2", 2, False)]


def test_filing_text(spark):
    pages = [None, "", "a  < b", ' <p>A&#160;B&#x2019;s &#128512;&#xD800;&#99999999999;<ix:nonNumeric name="x">c</ix:nonNumeric>d</p>\n\n<style>p{}</style>&lt;', "<ix:hidden>h</ix:hidden><br>t"]
    got = [r.t for r in spark.createDataFrame([(p,) for p in pages], "html string").select(filings.filing_text(F.col("html")).alias("t")).collect()]
    assert got == ["", "", "a  < b", "A B's 😀&#xD800;&#99999999999;cd <", "t"]


def test_parents_by_indent(spark):
    rng = random.Random(1)
    docs = {d: [rng.randrange(5) for _ in range(rng.randrange(1, 60))] for d in range(30)} | {99: list(range(3000))}
    want = set()
    for d, levels in docs.items():
        stack = []
        for i, x in enumerate(levels):
            while stack and levels[stack[-1]] >= x:
                stack.pop()
            want.add((d, i, stack[-1] if stack else None))
            stack.append(i)
    lines = spark.createDataFrame([(d, i, x, f"n{i}") for d, levels in docs.items() for i, x in enumerate(levels)], "doc int, pos int, indent int, name string").repartition(3)
    assert {(r.doc, r.pos, r.parent_pos) for r in hierarchy_from_indents(lines).collect()} == want


def test_exhibit_forms(spark):
    pages = [
        None,
        "<p>nothing</p>",
        "<tr><td>List of Subsidiaries</td></tr><tr><td></td><td>Alpha &eacute;&#233; LLC</td><td>x</td><td>Delaware</td></tr><tr></tr><tr><td>AB</td></tr><tr><td>&nbsp;&nbsp;&nbsp;&nbsp;Beta Inc (Nevada)</td></tr><tr><td>HEADING ROW</td></tr>",
        "<div><font>Gamma Ltd (Ireland)</font></div><div> <font>Page 3</font> </div><p><font>not looked at</font></p>",
        '<p style="text-align: left"><font>TEXAS</font></p><p style="text-align:left"><font>Delta Health LLC</font></p><p><font>not left</font></p>',
    ]
    rows = filings.exhibit_hierarchy(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", "html").orderBy("id", "pos").collect()
    assert [(r.id, r.name, r.jurisdiction, r.indent, r.parent_name) for r in rows] == [
        (2, "Alpha &eacute;é LLC", "Delaware", 1, None), (2, "Beta Inc", "Nevada", 2, "Alpha &eacute;é LLC"), (3, "Gamma Ltd", "Ireland", 0, None), (4, "Delta Health LLC", "Texas", 0, None),
    ]


def plain_section(text, opening, least, end):
    m = re.search(f"(?i){opening}", text)
    after = m and text[m.end() :].lstrip()
    if not m or len(after) < least:
        return None
    e = re.search(f"(?i){end}", after[least:])
    return m[0], (after[: least + e.start()] if e else after).strip(" ")


def test_sections_against_plain_search(spark):
    rng = random.Random(3)
    words = "debt notes of 1. 22 the Company term loan item consent of delaware nevada jurisdiction".split()
    heads = ["Note 4 - Debt ", "NOTE 11: Long-Term Debt. ", "Note 7—Borrowings ", "Note 8: Other ", "Liquidity and Capital Resources ", "Item 8 ", "Subsidiaries of the Registrant ", "List of Subsidiaries ", "Exhibit 23 ", "Guarantor Subsidiaries ", "Financial Covenants ", "Events of Default ", "Credit Agreement ", "Indenture dated ", "9. Borrowings "]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            parts += [rng.choice(heads), " ".join(rng.choices(words, k=rng.choice([5, 60, 400, 1500])))]
        texts.append("\n".join(parts))
    rows = [(i, ("10-K", "10-Q", "8-K")[i % 3], t) for i, t in enumerate(texts)] + [(100, "10-K", None), (101, "10-K", ""), (102, "S-1", texts[0]), (103, None, texts[0])]
    got = {(r.id, r.section_type): (r.section_title, r.content) for r in filings.filing_sections(spark.createDataFrame(rows, "id int, form string, body string"), "id", "form", "body").collect()}
    want = {}
    for i, form, t in rows:
        for s in filings.SECTIONS:
            found = next((x for o, e in s.openings() if (x := plain_section(t or "", o, s.least, e))), None) if form in s.forms else None
            if found and s.kind == "exhibit_21":
                low = found[1].lower()
                green = sum(f in low for f in filings.GREEN_FLAGS)
                found = None if len(low) < 200 or any(f in low[:500] for f in filings.RED_FLAGS) or green < (1 if "subsidiaries" in low else 2) else found
            if found:
                want[i, s.kind] = found[0], re.sub(" {3,}", "  ", re.sub("\n{3,}", "\n\n", found[1]))
    assert got == want
    assert len({k for _, k in want}) == len(filings.SECTIONS)
    short = filings.filing_sections(spark.createDataFrame(rows, "id int, form string, body string"), "id", "form", "body", most=600).collect()
    assert {(r.id, r.section_type): r.content for r in short} == {k: v[:600] + "\n\n[TRUNCATED]" if len(v) > 600 else v for k, (_, v) in want.items()}


def test_stated_figures(spark):
    texts = [
        "(in millions) Revenue 12.5 then (in thousands) total revenues $1,000 in billions",
        "Net sales 7", "total borrowings 5 amounts in thousands", "revenues of none", None, "revenues 0 in thousands", "total debt 3,000 long-term debt $9",
    ]
    said = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", *[filings.stated_figure(F.col("text"), v).alias(k) for k, v in filings.FIGURES.items()]).collect()
    cents = lambda x: x and (int(x.cents), x.unit)
    assert [(cents(r.revenue), cents(r.total_debt)) for r in said] == [((100_000_000, "thousands"), None), ((700, "dollars"), None), (None, (500_000, "thousands")), (None, None), (None, None), ((0, "thousands"), None), (None, (300_000, "dollars"))]
    stored = spark.createDataFrame([(0, 105_000_000, None), (1, 700 * 1000, 0), (2, None, 900_000), (5, 5, 5), (6, None, 300_000), (9, 1, None)], "id int, revenue long, total_debt long")
    statements = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.field): r.verdict for r in filings.checked_figures(stored, statements, ["id"], "text").collect()}
    assert got == {(0, "revenue"): "match", (1, "revenue"): "scale_error", (2, "total_debt"): "mismatch", (5, "revenue"): "not_stated", (5, "total_debt"): "not_stated", (6, "total_debt"): "match", (9, "revenue"): "no_source"}


def test_openings_are_tried_only_where_their_words_are(spark):
    assert filings.words_of(filings.title("debt and [credit] facilities")) == ["facilities", "debt and"]
    assert filings.words_of(r"indenture\s+(?:dated|by\s+and\s+(?:between|among))") == ["indenture"]
    rows = [(i, f, f"x{gap}{t}  " + "word " * 1100 + "Note 9: ends") for i, (f, t, gap) in enumerate((f, t, g) for g in ("\n", " \t ") for f, t in (("8-K", f"CREDIT{g}{g}Agreement"), ("10-Q", f"debt\x0b{g}COVENANTS"), ("10-Q", f"Note 3.{g}Long{g}Term{g}Debt"), ("10-K", f"Subsidiary{g}Guarantor")))]
    found = filings.filing_sections(spark.createDataFrame(rows, "id int, form string, body string"), "id", "form", "body").collect()
    assert {(r.id, r.section_type, r.section_title) for r in found} == {
        (i, kind, body[1 + len(g) :].split("  word")[0]) for (i, _, body), kind, g in zip(rows, ("credit_agreement", "covenants", "debt_footnote", "guarantor_list") * 2, ["\n"] * 4 + [" \t "] * 4)
    }


def test_sections_are_cut_at_places_of_characters(spark, monkeypatch):
    """Signs of two to four bytes before, in and behind openings and around the least length; no pattern runs over texts in Spark."""
    monkeypatch.setattr(filings, "HANDED_ON", 2_000, raising=False)
    rows = []
    for i, sign in enumerate("xé–😀İ"):
        for n in (995, 996, 999, 1000, 1300):
            rows += [(len(rows), "10-Q", f"{sign * 7} NOTE 4{'—' if i % 2 else ': '}Long–Term  Debt \x0b\n{sign * n}note 5– next"), (len(rows) + 1, "10-K", f"Liquidity\nand  Capital Resources {sign}{'ab ' * (n // 3)}{sign}")]
    docs = spark.createDataFrame(rows, "id int, form string, body string")
    found = filings.filing_sections(docs, "id", "form", "body")
    want = {}
    for i, form, t in rows:
        for s in filings.SECTIONS:
            x = next((x for o, e in s.openings() if (x := plain_section(t, o, s.least, e))), None) if form in s.forms else None
            if x:
                want[i, s.kind] = x[0], re.sub(" {3,}", "  ", re.sub("\n{3,}", "\n\n", x[1]))
    assert {(r.id, r.section_type): (r.section_title, r.content) for r in found.collect()} == want
    assert 20 < len(want) < len(rows)
    assert "(?i)" not in found._jdf.queryExecution().optimizedPlan().toString()
