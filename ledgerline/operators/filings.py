"""Filings as they come: inline XBRL, lists of subsidiaries, sections, and figures checked against their statement.

Text work is column expressions. Three things are not, and run in Arrow batches, row by row: tags that nest (inline
facts), the stack of open parents of an indented list, and sections, which are cut at places in a text's bytes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- readable text -------------------------------------------------------------------------------

#: Named entities, and signs that are flattened.
NAMED = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x2019;", "'"), ("&#x2014;", "-"), ("&#x2013;", "-"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def numbered(text: Column, pattern: str, base: int) -> Column:
    """Numeric entities as their characters; what is no character stays."""

    def sign(code: Column) -> Column:
        n = F.conv(F.substring(code, 1, 8), base, 10).cast("long")
        fine = (F.length(code) <= 8) & (n <= 0x10FFFF) & (n > 0) & ~n.between(0xD800, 0xDFFF)
        return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, n).otherwise(32)), 8, "0")), "UTF-32"))

    def read(t: Column) -> Column:
        raw, codes = (F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (f"({pattern})", pattern))
        signs = F.zip_with(codes, raw, lambda c, r: F.coalesce(sign(c), r))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), signs, lambda part, s: F.concat(part, F.coalesce(s, F.lit("")))), "")

    return let(text, lambda t: F.when(t.rlike(pattern), read(t)).otherwise(t))


def filing_text(html: Column) -> Column:
    """Readable text of a filing, plain or inline XBRL. Scripts, styles and hidden facts go; a fact's own tags go without a
    trace, other tags leave a blank; null and empty are empty; what doesn't start with a tag is text already."""
    text = html
    for pattern in (r"<\?xml[^>]*\?>", r"<!DOCTYPE[^>]*>", r"(?i)<script[^>]*>[\s\S]*?</script>", r"(?i)<style[^>]*>[\s\S]*?</style>", r"(?i)<ix:hidden[^>]*>[\s\S]*?</ix:hidden>"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(text, r"<ix:[^>]*>([^<]*)</ix:[^>]*>", "$1"), r"<[^>]+>", " ")
    for name, sign in NAMED:
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = numbered(numbered(text, r"&#(\d+);", 10), r"&#x([0-9a-fA-F]+);", 16)
    return F.when(html.isNull() | (html == ""), "").when(~html.rlike(r"^\s*<"), html).otherwise(F.btrim(F.regexp_replace(text, r"\s+", " ")))


# ---- inline facts --------------------------------------------------------------------------------

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
FACT = "kind string, name string, context string, unit string, scale int, sign string, hidden boolean, text string"
#: Tags that hold a fact.
FACT_TAGS = ("ix:nonfraction", "ix:nonnumeric", "ix:fraction")


@dataclass
class Open:
    """A tag that is not closed yet, with the text inside it."""

    tag: str
    attributes: dict[str, str]
    hidden: bool
    parts: list[str] = field(default_factory=list)


def scanned_facts(source: str) -> list[dict]:
    """The facts in the order of their tags. A stack holds open tags: a closing tag closes what is open above its
    partner, one without a partner is passed over, and the end of the text closes all that is left. Excluded parts are left out of
    the facts around them; continuations are appended in the order of their links, each once."""
    stack: list[Open] = []
    found: list[tuple[int, Open]] = []
    more: dict[str, Open] = {}
    done, order = 0, 0

    def add(text: str) -> None:
        if text and not any(o.tag == "ix:exclude" for o in stack):
            for o in stack:
                o.parts.append(text)

    for m in TAG.finditer(source):
        add(source[done : m.start()])
        done = m.end()
        tag = (m[2] or "").lower()
        if m[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            del stack[at if at is not None else len(stack) :]
        elif tag.startswith("ix:"):
            here = Open(tag, {k.lower(): entities.unescape(a or b) for k, a, b in ATTRIBUTE.findall(m[3])}, tag == "ix:hidden" or any(o.hidden for o in stack))
            if tag in FACT_TAGS:
                found.append((order, here))
                order += 1
            elif tag == "ix:continuation" and "id" in here.attributes:
                more.setdefault(here.attributes["id"], here)
            if not m[3].rstrip().endswith("/"):
                stack.append(here)
    add(source[done:])
    out = []
    for _, fact in found:
        a, parts, seen = fact.attributes, list(fact.parts), set()
        link = a.get("continuedat")
        while link in more and link not in seen:
            seen.add(link)
            parts += more[link].parts
            link = more[link].attributes.get("continuedat")
        scale = a.get("scale", "")
        text = " ".join(entities.unescape("".join(parts)).split())
        out.append({"kind": fact.tag[3:], "name": a.get("name"), "context": a.get("contextref"), "unit": a.get("unitref"), "scale": int(scale) if re.fullmatch(r"-?\d{1,2}", scale) else 0, "sign": a.get("sign"), "hidden": fact.hidden, "text": text})
    return out


def inline_facts(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, name, context, unit, scale, sign, hidden, text, value): the facts of inline XBRL. The value of a
    number is its text times ten to the scale, negative by its sign; null where the text is no number. A null or plain text has none."""
    kind = T.ArrayType(T.StructType.fromDDL(FACT))

    @F.pandas_udf(kind)
    def facts(source: pd.Series) -> pd.Series:
        return source.map(lambda s: scanned_facts(s) if s and "<ix:" in s.lower() else [])

    rows = docs.select(key, F.posexplode(facts(F.col(html).cast("string"))).alias("pos", "x")).select(key, "pos", "x.*")
    plain = F.regexp_replace("text", r"[,\s$]", "")
    number = F.when(plain.isin("-", "–", "—"), "0").otherwise(F.nullif(F.regexp_extract(plain, r"^(\d*\.?\d+|\d+\.)$", 1), F.lit("")))
    value = F.expr("try_cast(concat(number, 'e', scale) as decimal(38, 6))")
    return rows.withColumn("number", F.when(F.col("kind") == "nonfraction", number)).withColumn("value", F.when(F.col("sign") == "-", -value).otherwise(value)).drop("number")


# ---- lists of subsidiaries -----------------------------------------------------------------------

#: Lines of a list that are headings, not names.
HEADINGS = (
    r"name\s*(of\s*)?(jurisdiction|country)?$", r"name\s+jurisdiction", "subsidiary", "exhibit", r"page\s*\d", r"\d+$", "state.*incorporation",
    r"jurisdiction\s*(of)?", r"country\s*(name)?", r"\*+$", "the following", "indentation", "list of subsidiar", "document$",
)
#: Places that head a part of a list of paragraphs.
STATES = (
    "ALABAMA ALASKA ARIZONA ARKANSAS CALIFORNIA COLORADO CONNECTICUT DELAWARE FLORIDA GEORGIA HAWAII IDAHO ILLINOIS INDIANA IOWA KANSAS KENTUCKY "
    "LOUISIANA MAINE MARYLAND MASSACHUSETTS MICHIGAN MINNESOTA MISSISSIPPI MISSOURI MONTANA NEBRASKA NEVADA OHIO OKLAHOMA OREGON PENNSYLVANIA "
    "TENNESSEE TEXAS UTAH VERMONT VIRGINIA WASHINGTON WISCONSIN WYOMING GUAM"
).split() + ["NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK", "NORTH CAROLINA", "NORTH DAKOTA", "RHODE ISLAND", "SOUTH CAROLINA", "SOUTH DAKOTA", "WEST VIRGINIA", "PUERTO RICO", "VIRGIN ISLANDS"]
#: Blanks of all kinds that lists use.
SPACE = r"[\s\u00A0]"
IN_BRACKETS = rf"\(([^)]+)\){SPACE}*$"


def shown(cell: Column) -> Column:
    """What a cell shows: no tags, its entities read, blanks single."""
    text = F.regexp_replace(cell, "<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.replace(numbered(numbered(text, r"&#(\d+);", 10), r"&#x([0-9a-fA-F]+);", 16), F.lit("&amp;"), F.lit("&"))
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def upper_only(text: Column) -> Column:
    return (text == F.upper(text)) & text.rlike("[A-Z]")


def is_heading(text: Column) -> Column:
    return F.lower(text).rlike("^(?:" + "|".join(HEADINGS) + ")") | (upper_only(text) & (F.length(text) < 20))


def split_place(text: Column) -> tuple[Column, Column]:
    """The name, and the place in brackets behind it."""
    place = F.btrim(F.regexp_extract(text, IN_BRACKETS, 1))
    return F.btrim(F.regexp_replace(text, IN_BRACKETS, "")), F.nullif(place, F.lit(""))


def table_line(row: Column) -> Column:
    """struct(name, jurisdiction, indent) of a table row; null where it shows no name. The indent is the number of empty cells
    before the name and half its hard blanks, or a fifteenth of its padding in pixels if that is more."""
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))

    def line(x: Column) -> Column:
        raw, text = x["own"]["raw"], x["own"]["shown"]
        pad = F.greatest(*[F.coalesce(F.regexp_extract(raw, rf"(?i){p}:\s*(\d{{1,6}})", 1).try_cast("int"), F.lit(0)) for p in ("padding-left", "margin-left")])
        hard = F.size(F.split(raw, r"&#160;|&nbsp;|\u00A0", -1)) - 1
        indent = F.greatest(x["empty"] + F.floor(hard / 2), F.floor(pad / 15)).cast("int")
        name, place = split_place(text)
        stated = F.get(x["beside"], 0)["shown"]
        return F.when((F.length(text) >= 3) & ~is_heading(text), F.struct(F.when(stated.isNotNull(), text).otherwise(name).alias("name"), F.coalesce(stated, place).alias("jurisdiction"), indent.alias("indent")))

    def parts(pairs: Column, first: Column) -> Column:
        beside = F.filter(F.slice(pairs, first + 1, 2), lambda c: F.length(c["shown"]).between(2, 49))
        return F.when(first > 0, F.struct(F.get(pairs, first - 1).alias("own"), (first - 1).alias("empty"), beside.alias("beside")))

    shown_cells = F.transform(cells, lambda c: F.struct(c.alias("raw"), shown(c).alias("shown")))
    first_of = lambda pairs: F.array_position(F.transform(pairs, lambda c: c["shown"] != ""), True).cast("int")
    return let(shown_cells, lambda pairs: let(let(first_of(pairs), lambda first: parts(pairs, first)), line))


def flat_line(text: Column) -> Column:
    """struct(name, jurisdiction, indent) of a line without indents; null for headings."""
    name, place = split_place(text)
    fine = (F.length(text) >= 3) & ~is_heading(text) & (F.length(name) >= 3)
    return F.when(fine, F.struct(name.alias("name"), place.alias("jurisdiction"), F.lit(0).alias("indent")))


def paragraph_lines(texts: Column) -> Column:
    """Lines of paragraphs; the name of a state alone on a line is the place of those below it."""
    state = F.transform(texts, lambda t: F.when(t.isin(STATES), F.initcap(F.lower(t))))

    def line(t: Column, i: Column) -> Column:
        above = F.filter(F.slice(state, 1, i + 1), lambda s: s.isNotNull())
        name, place = split_place(t)
        fine = ~t.isin(STATES) & (F.length(t) >= 3) & ~is_heading(t) & (F.length(name) >= 3) & ~(upper_only(name) & (F.length(name) < 30))
        return F.when(fine, F.struct(name.alias("name"), F.coalesce(place, F.try_element_at(above, F.lit(-1))).alias("jurisdiction"), F.lit(0).alias("indent")))

    return F.transform(texts, line)


def exhibit_lines(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, lines): the names of a list of subsidiaries as array<struct<name, jurisdiction, indent>>: from table rows, else
    from divs, else from paragraphs. A null page, or one without a list, has none."""
    page = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    some = lambda lines: F.filter(lines, lambda x: x.isNotNull())
    all_of = lambda pattern: F.regexp_extract_all("page", F.lit(pattern), F.lit(1))
    rows = docs.select(key, page.alias("page"))
    rows = rows.select(key, "page", some(F.transform(all_of(r"(?is)<tr[^>]*>(.*?)</tr>"), table_line)).alias("cells"))
    divs = some(F.transform(F.transform(all_of(r"(?i)<div[^>]*>\s*<font[^>]*>([^<]+)</font>\s*</div>"), shown), flat_line))
    left, any_side = (F.transform(all_of(p), shown) for p in (r"(?i)<p[^>]*text-align:\s*left[^>]*>\s*<font[^>]*>([^<]+)</font>", r"(?i)<p[^>]*>\s*<font[^>]*>([^<]{5,100})</font>"))
    rows = rows.select(key, "cells", F.when(F.size("cells") > 0, F.array().cast("array<struct<name:string,jurisdiction:string,indent:int>>")).otherwise(divs).alias("divs"), left.alias("left"), any_side.alias("any_side"))
    paragraphs = some(paragraph_lines(F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("any_side"))))
    return rows.select(key, F.when(F.size("cells") > 0, F.col("cells")).when(F.size("divs") > 0, F.col("divs")).otherwise(paragraphs).alias("lines"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def parents_of_indents(indents: pd.Series) -> pd.Series:
    """For each line the place of the nearest line above with a smaller indent, -1 where there is none: a stack of open parents,
    each line put on it and taken off once."""

    def parents(levels: list[int] | None) -> list[int]:
        stack: list[int] = []
        out = []
        for i, level in enumerate([] if levels is None else levels):
            while stack and levels[stack[-1]] >= level:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        return out

    return indents.map(parents)


def exhibit_hierarchy(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, name, jurisdiction, indent, parent_pos, parent_name, ownership_type): parents by indentation; a line
    without one belongs to the registrant, and its parent is null."""
    rows = exhibit_lines(docs, key, html).withColumn("up", parents_of_indents(F.transform("lines", lambda x: x["indent"])))
    flat = rows.select(key, "lines", F.posexplode(F.arrays_zip("lines", "up")).alias("pos", "x"))
    up = F.when(F.col("x.up") >= 0, F.col("x.up"))
    return flat.select(key, "pos", "x.lines.name", "x.lines.jurisdiction", "x.lines.indent", up.alias("parent_pos"), F.get("lines", up)["name"].alias("parent_name"), F.when(F.col("x.lines.indent") <= 1, "direct").otherwise("indirect").alias("ownership_type"))


# ---- sections ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Section:
    """A kind of section: the forms that hold it, titles in the order they are tried, the least length of what
    follows, and what ends it."""

    kind: str
    forms: tuple[str, ...]
    titles: tuple[str, ...]
    least: int
    end: str
    numbered: tuple[str, ...] = ()

    def openings(self) -> list[tuple[str, str]]:
        """(title, end): those of numbered headings last; the next number ends them."""
        return [(t, self.end) for t in self.titles] + [(rf"\d+\.\s*{t}", r"\d+\.\s*[a-z]") for t in self.numbered]


def title(words: str) -> str:
    """A title as a pattern: any blanks between its words, any dashes or blanks for a dash; a word in brackets may be missing."""
    parts = [rf"(?:{w[1:-1]}\s+)?" if w[0] == "[" else rf"{w}\s+" for w in words.split()]
    return "".join(parts).removesuffix(r"\s+").replace("-", r"[-–—\s]*")


#: How sections open and end.
NOTE = r"note\s*\d+[.:–—\s-]+"
NEXT_NOTE = r"note\s*\d+[.:–—-]"
NEXT_EXHIBIT = r"exhibit\s*2[2-9]|exhibit\s*[3-9]|signatures"
COMPANY = r"(?:the\s+)?(?:registrant|[a-z][a-z\s.,]+(?:inc|corp|llc|ltd|co|company))\.?"
DEBT_TITLES = (
    "[long-term] debt", "debt and [credit] facilities", "borrowings", "notes payable", "financing arrangements?", "short-term borrowings? and long-term debt",
    "deposits? and borrowings?", "credit (?:facility|facilities) and debt", "indebtedness", "long-term obligations?", "senior notes", "debt securities",
)
SECTIONS = (
    Section("exhibit_21", ("10-K",), (rf"subsidiaries\s+of\s+{COMPANY}", title("list of [significant] subsidiaries"), r"exhibit\s*21[.\s:-]*(?:list\s+of\s+)?subsidiaries"), 500, NEXT_EXHIBIT),
    Section("exhibit_22", ("10-K",), (title("list of [subsidiary] guarantors?"), title("guarantor subsidiaries"), r"exhibit\s*22[.\s:-]*(?:list\s+of\s+)?(?:subsidiary\s+)?guarantors?"), 300, r"exhibit\s*2[3-9]|exhibit\s*[3-9]|signatures"),
    Section("debt_footnote", ("10-K", "10-Q"), (*(NOTE + title(t) for t in DEBT_TITLES), title("long-term debt and [credit] facilities"), title("the components of [long-term] debt")), 1000, NEXT_NOTE, (title("long-term obligations?"), title("[long-term] debt"), "borrowings?")),
    Section("mda_liquidity", ("10-K", "10-Q"), (title("liquidity and capital resources"), title("liquidity,? capital resources"), title("capital resources and liquidity")), 1000, r"critical\s+accounting|results\s+of\s+operations|item\s+\d"),
    Section("credit_agreement", ("8-K",), (title("credit agreement"), title("amended and restated credit"), title("senior [secured] credit facility"), title("term loan [credit] agreement")), 2000, r"exhibit\s*\d"),
    Section("indenture", ("8-K",), (r"indenture\s+(?:dated|by\s+and\s+(?:between|among))", title("supplemental indenture"), r"indenture\s+among\s+[^,]+,\s+as\s+issuer", title("[senior] notes indenture")), 5000, r"exhibit\s*[a-z]"),
    Section("guarantor_list", ("10-K", "10-Q"), (title("guarantor subsidiaries"), title("subsidiary guarantors?"), title("guarantees? of [senior] notes"), title("condensed consolidating financial")), 500, rf"{NEXT_NOTE}|non[-–—\s]*guarantor"),
    Section("covenants", ("10-K", "10-Q", "8-K"), (title("financial covenants?"), title("debt covenants?"), title("covenant compliance"), title("restrictive covenants?")), 500, rf"events?\s+of\s+default|{NEXT_NOTE}"),
)
#: What shows that a list of subsidiaries is another exhibit, or that it is one.
RED_FLAGS = ("consent of", "power of attorney", "certification of", "hereby consent", "independent registered public accounting firm")
GREEN_FLAGS = (
    "delaware", "nevada", "california", "new york", "texas", "florida", "ireland", "netherlands", "luxembourg", "cayman islands", "united kingdom", "england", "cayman", "jurisdiction",
    "state of incorporation", "place of incorporation", "country of organization", "where incorporated", "jurisdiction of organization", "jurisdiction of formation", "subsidiaries of",
)


def is_subsidiary_list(content: Column) -> Column:
    """Long enough, no red flag near the start, two green flags or one beside the word itself."""
    def told(text: Column) -> Column:
        red = F.exists(F.array(*map(F.lit, RED_FLAGS)), lambda f: F.contains(F.substring(text, 1, 500), f))
        green = F.size(F.filter(F.array(*map(F.lit, GREEN_FLAGS)), lambda f: F.contains(text, f)))
        return ~red & (green >= F.when(F.contains(text, F.lit("subsidiaries")), 1).otherwise(2))

    return F.coalesce((F.length(content) >= 200) & let(F.lower(content), told), F.lit(False))


#: Blanks as patterns know them.
BLANKS = b" \t\n\x0b\f\r"


def words_of(pattern: str) -> list[str]:
    """Words and phrases in lower case, with single blanks, that every match of a title's pattern holds, the longest first: none of a
    group or of what may be missing."""
    plain, before = pattern, ""
    while plain != before:
        plain, before = re.sub(r"\((?:\?:)?[^()]*\)[?*+]?", "|", plain), plain
    plain = re.sub(r"\[[^\]]*\][?*+]?|\w[?*]", "|", plain).replace(r"\s+", " ")
    parts = re.findall(r"[a-z]+(?: [a-z]+)*", re.sub(r"\\.[?*+]?", "|", plain))
    return sorted({w for w in parts if len(w) > 2}, key=lambda w: (-len(w), w))


def in_bytes(pattern: str) -> re.Pattern[bytes]:
    """The pattern over UTF-8 in lower case; signs of several bytes leave their classes."""

    def apart(m: re.Match[str]) -> str:
        wide = [c for c in m[1] if c > "\x7f"]
        return f"(?:[{''.join(c for c in m[1] if c <= '\x7f')}]|{'|'.join(wide)})" if wide else m[0]

    return re.compile(re.sub(r"\[([^\]]*)\]", apart, pattern).encode())


def section_of(text: bytes, low: bytes, opening: re.Pattern[bytes], words: list[bytes], least: int, end: re.Pattern[bytes]) -> tuple[bytes, bytes] | None:
    """(title, content) from the first opening; None where less than `least` characters follow. The section goes on to the first end
    behind those, or to the end of the text. `low` is the text with small a-z. Linear in the text: nothing is tried twice, and the
    pattern only where the text has the words of the opening."""
    if not all(w in low for w in words) or not (m := opening.search(low)):
        return None
    start = m.end()
    while start < len(text) and text[start] in BLANKS:
        start += 1
    if len(text) - start < least:
        return None
    head = text[start : start + 4 * least]  # no character has more than four bytes
    if head[:least].isascii():
        behind = start + least
    else:
        signs = head.decode("utf-8", "ignore")
        if len(signs) < least:
            return None
        behind = start + len(signs[:least].encode())
    e = end.search(low, behind)
    return text[m.start() : m.end()], text[start : e.start() if e else len(text)].strip(b" ")


#: Bytes of contents that a task hands on at once.
HANDED_ON = 4 << 20


def filing_sections(docs: DataFrame, key: str, form: str, text: str, most: int | None = None, kinds: tuple[Section, ...] = SECTIONS) -> DataFrame:
    """(key, section_type, section_title, content): the sections of a filing that its form can hold, the first title that
    gives one; lists of subsidiaries only if they are such. `most` cuts contents, None keeps them whole. Line ends count as blanks;
    a null text has no sections."""
    sought = [(s.kind, s.forms, s.least, [(in_bytes(t), sorted({w.encode() for p in words_of(t) for w in p.split()}, key=len, reverse=True), in_bytes(e)) for t, e in s.openings()]) for s in kinds]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, forms, rows, size = batch.column(2).cast(pa.large_binary()), batch.column(1).to_pylist(), [], 0
            for i, of in enumerate(forms):
                mine = [s for s in sought if of in s[1]]
                whole = texts[i].as_py() if mine else None
                low = (whole or b"").lower()
                for kind, _, least, openings in mine:
                    hit = next((x for o, words, e in openings if (x := section_of(whole, low, o, words, least, e))), None) if whole else None
                    if hit:
                        rows.append((i, kind, *hit))
                        size += len(hit[1])
                if rows and (size > HANDED_ON or i == len(forms) - 1):
                    of_row, named, titles, contents = zip(*rows, strict=True)
                    out = [pa.array(named), *[pa.array(x, pa.binary()).cast(pa.string(), safe=False) for x in (titles, contents)]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_row)), *out], ["key", "section_type", "section_title", "content"])
                    rows, size = [], 0

    read = docs.select(F.col(key).alias("key"), F.col(form).alias("form"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", read.schema["key"].dataType), *[T.StructField(c, T.StringType()) for c in ("section_type", "section_title", "content")]])
    rows = read.mapInArrow(found, schema).withColumnRenamed("key", key)
    fine = F.when(F.col("section_type") == "exhibit_21", is_subsidiary_list(F.col("content"))).when(F.col("section_type") == "exhibit_22", F.length("content") > 200).otherwise(True)
    whole = F.col("content") if most is None else F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("\n\n[TRUNCATED]"))).otherwise(F.col("content"))
    head = F.when(F.length("section_title") > 250, F.concat(F.substring("section_title", 1, 250), F.lit("..."))).otherwise(F.col("section_title"))
    # patterns only where there is something for them
    fewer = lambda x, sign, pattern, to: let(x, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, to)).otherwise(t))
    return rows.where(fine).select(key, "section_type", head.alias("section_title"), fewer(fewer(whole, "\n\n\n", r"\n{3,}", "\n\n"), "   ", " {3,}", "  ").alias("content"))


# ---- figures checked against their statement -----------------------------------------------------

#: How a figure is labelled, in the order that labels are tried.
AMOUNT = r"\s*[$]?\s*([\d,]+(?:\.\d+)?)"
FIGURES = {
    "revenue": (r"total\s+(?:net\s+)?revenues?", r"net\s+(?:revenues?|sales)", r"revenues?"),
    "total_debt": (r"total\s+(?:long[- ]term\s+)?debt", r"total\s+borrowings?", r"long[- ]term\s+debt[^$]*"),
}
SCALE = r"\b(?:in|amounts?\s+in)\s+(?:u\.?s\.?\s+)?(?:dollars\s+in\s+)?(thousands|millions|billions)\b"
UNITS = {"thousands": 100_000, "millions": 100_000_000, "billions": 100_000_000_000}


def stated_figure(text: Column, labels: tuple[str, ...]) -> Column:
    """struct(cents, unit) of the first figure behind the first label that has one, by the last statement of scale before it, else the
    first behind it, else in dollars. Null without a figure."""
    lower = F.lower(text)

    def figure(label: str) -> Column:
        amount = F.replace(F.nullif(F.regexp_extract(lower, label + AMOUNT, 1), F.lit("")), F.lit(","), F.lit(""))
        before = F.get(F.split(lower, label + AMOUNT, 2), 0)
        near = F.nullif(F.regexp_extract(before, rf"(?s).*{SCALE}", 1), F.lit(""))
        unit = F.coalesce(near, F.nullif(F.regexp_extract(lower, SCALE, 1), F.lit("")), F.lit("dollars"))
        per = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit), F.lit(100)).cast("decimal(14,0)")
        cents = F.round(amount.try_cast("decimal(20,4)") * per).cast("decimal(38,0)")
        return F.when(cents.isNotNull(), F.struct(cents.alias("cents"), unit.alias("unit")))

    return F.coalesce(*map(figure, labels))


def checked_figures(figures: DataFrame, statements: DataFrame, keys: list[str], text: str, tolerance: float = 10.0, scale_error: float = 1000.0) -> DataFrame:
    """keys, field, stored, stated, unit, variance_pct, verdict: stored figures in cents (columns named as in FIGURES) beside what the
    statement of the same keys says. The verdict is match under `tolerance` percent, scale_error above `scale_error`, else mismatch;
    not_stated where the statement has no such figure, no_source where there is no statement. Null and 0 figures aren't checked;
    a stated 0 is not_stated."""
    said = statements.select(*keys, F.lit(True).alias("there"), *[stated_figure(F.col(text), labels).alias(f"said_{name}") for name, labels in FIGURES.items()])
    rows = figures.select(*keys, *FIGURES).join(said, keys, "left")
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("decimal(38,0)").alias("stored"), F.col(f"said_{n}.cents").alias("stated"), F.col(f"said_{n}.unit").alias("unit")) for n in FIGURES])).alias("x")
    rows = rows.select(*keys, "there", fields).select(*keys, "there", "x.*").where("stored <> 0")
    off = F.round(F.abs(F.col("stored") - F.col("stated")).cast("double") / F.col("stated").cast("double") * 100, 4)
    rows = rows.withColumn("variance_pct", F.when(F.col("stated") != 0, off))
    verdict = F.when(F.col("there").isNull(), "no_source").when(F.col("variance_pct").isNull(), "not_stated").when(F.col("variance_pct") < tolerance, "match").when(F.col("variance_pct") > scale_error, "scale_error").otherwise("mismatch")
    return rows.withColumn("verdict", verdict).drop("there")
