"""Texts read line by line: headings and lists, sections of a résumé, roles, words that come too often.

Where a line depends on those before and after it, lines are rows and windows in their order
carry the state: a section is open if the last line that opens or closes one opened it. A
window that looks forward runs over the reversed order, so that it stays incremental.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of list lines, ends of sentences, and the lengths that tell headings, items and paragraphs apart.
MARKS, DRAWN_MARKS = ("•", "-", "–", "▪", "*", "►"), ("•", "–", "▪", "►")
ENDS = (".", ",", ";", "!", "?")
HEADING, SHORT_HEADING, PARAGRAPH, SENTENCES = 80, 40, 300, 3
BLANK = r"[ \t\r\n\f\x0B]"
# Headings of the sections of a résumé, the order they are written in, marks of bullets.
SECTIONS = (
    ("summary", "summary|professional summary|objective|profile"),
    ("experience", "experience|work experience|employment|professional experience"),
    ("technical_skills", "skills|technical skills|core competencies|technologies"),
    ("education", "education|academic|degrees"),
    ("projects", "projects?|portfolio|personal projects|key projects"),
    ("certifications", "certifications?|licenses?|credentials"),
    ("awards", "awards?|honors?|achievements?"),
)
SECTION_ORDER = ("header", "summary", "experience", "technical_skills", "projects", "education", "certifications", "awards")
BULLET = r"^([-*•–]|[0-9]+\.)"
# Adjectives that fill, how often they may come, and what the base text may have.
FILLERS = ("analytical", "comprehensive", "systematic", "strategic", "robust", "scalable", "innovative", "cutting-edge", "dynamic", "holistic", "enterprise-grade")
FILLER_MOST, FILLER_BASE, FILLER_KEPT = 3, 1, 2
# Headings that are no roles, notes that are no bullets.
NO_ROLES = (
    "programming", "cloud", "data engineering", "ai / ml", "development tools", "api &", "architecture", "compliance", "authentication",
    "employment structure",
)
NO_BULLETS = ("scope boundaries", "overall fastapi", "did not build", "deployments were")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def _starts(c: Column, marks: tuple[str, ...]) -> Column:
    return F.substring(c, 1, 1).isin(*marks)


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), raw and s (without blanks around it) of every line; null texts have none."""
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    return lines.withColumn("s", stripped(F.col("raw")))


def line_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, raw, s and kind (heading, item, text or blank) of every line.

    A heading is short, ends like no sentence, and a longer line or none follows. A heading
    opens a section; in one, lines between blank lines are items, and so are longer headings.
    Lines that touch others, and long paragraphs, close it.
    """
    w = Window.partitionBy("key").orderBy("pos")
    back = Window.partitionBy("key").orderBy(F.col("pos").desc())
    ahead = back.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    s, full = F.col("s"), F.col("s") != ""
    rows = line_rows(df, key, text).withColumn("next_length", F.last(F.when(full, F.length(s)), ignorenulls=True).over(ahead))
    rows = rows.withColumn("is_short", full & ~_starts(s, MARKS) & (F.length(s) <= HEADING) & ~F.substring(s, -1, 1).isin(*ENDS) & (F.col("next_length").isNull() | (F.col("next_length") > F.length(s))))
    alone = F.coalesce(F.lag("s").over(w), F.lit("")).eqNullSafe("") & F.coalesce(F.lead("s").over(w), F.lit("")).eqNullSafe("")
    long = (F.length(s) > PARAGRAPH) & (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))) > SENTENCES)
    rows = rows.withColumns({"alone": alone, "long": long})
    signal = F.when(F.col("is_short"), True).when(full & (~F.col("alone") | F.col("long")), False)
    rows = rows.withColumn("signal", signal).withColumn("open", F.coalesce(F.last("signal", ignorenulls=True).over(so_far), F.lit(False)))
    heading = F.col("is_short") & (~F.col("open") | (F.length(s) <= SHORT_HEADING))
    item = F.col("is_short") | (F.col("open") & F.col("alone") & ~F.col("long"))
    return rows.select("key", "pos", "raw", "s", F.when(~full, "blank").when(heading, "heading").when(item, "item").otherwise("text").alias("kind"))


def escaped(c: Column) -> Column:
    for sign, by in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(sign), F.lit(by))
    return c


def formatted(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_headings, n_items and html of every text: headings strong, items with a dot, blank lines before either left out.

    A text that is null or empty has no lines but a remark.
    """
    back = Window.partitionBy("key").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = line_kinds(df, key, text)
    listed = F.col("kind").isin("heading", "item") | _starts(F.col("s"), DRAWN_MARKS)
    rows = rows.withColumn("next_listed", F.coalesce(F.last(F.when(F.col("kind") != "blank", listed), ignorenulls=True).over(back), F.lit(False)))
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("<strong>"), escaped(F.col("s")), F.lit("</strong>"))).when(F.col("kind") == "item", F.concat(F.lit("  • "), escaped(F.col("s")))).otherwise(escaped(F.col("raw")))
    kept = rows.withColumn("shown", F.when((F.col("kind") != "blank") | ~F.col("next_listed"), shown))
    out = kept.groupBy("key").agg(
        F.count_if(F.col("kind") == "heading").alias("n_headings"),
        F.count_if(F.col("kind") == "item").alias("n_items"),
        F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("pos", "shown")))).alias("lines"),
    )
    told = df.select(F.col(key).alias("key"), F.coalesce(F.col(text) == "", F.lit(True)).alias("is_empty")).join(out, "key", "left")
    html = F.when(F.col("is_empty"), "No description available.").otherwise(F.array_join(F.transform("lines", lambda x: x["shown"]), "\n"))
    count = lambda c: F.when(F.col("is_empty"), 0).otherwise(F.col(c))
    return told.select("key", count("n_headings").alias("n_headings"), count("n_items").alias("n_items"), html.alias("html"))


def resume_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section and content: each section's heading with the lines up to the next heading; of repeated sections the last.

    Lines before the first heading are the header. A heading is a line that begins with one of
    a section's names, whatever follows; the first section that fits counts.
    """
    w = Window.partitionBy("key").orderBy("pos")
    name = F.coalesce(*(F.when(F.col("s").rlike(f"(?i)^({pattern})"), section) for section, pattern in SECTIONS))
    rows = line_rows(df, key, text).withColumn("name", name)
    rows = rows.withColumns({"block": F.count("name").over(w), "section": F.coalesce(F.last("name", ignorenulls=True).over(w), F.lit("header"))})
    blocks = rows.groupBy("key", "block", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("lines"))
    content = F.array_join(F.transform("lines", lambda x: x["raw"]), "\n").alias("content")
    last = blocks.select("key", "section", "block", content).groupBy("key", "section").agg(F.max_by("content", "block").alias("content"))
    return last


def compressed(content: Column, most: int = 3) -> Column:
    """A section's first line, its lines before the first bullet, and the first bullets; other lines after a bullet go."""
    lines = F.split(content, "\n", -1)
    bullet = lambda x: stripped(x).rlike(BULLET)
    state = F.struct(F.lit(0).alias("n"), F.array(F.element_at(lines, 1)).alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(bullet(x), a["n"] + 1).otherwise(a["n"])
        keep = F.when(bullet(x), n <= most).otherwise(a["n"] == 0)
        return F.struct(n.alias("n"), F.when(keep, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), state, step, lambda a: F.array_join(a["out"], "\n"))


def trimmed(df: DataFrame, key: str, text: str, compress: tuple[str, ...]) -> DataFrame:
    """key and trimmed: all sections in their order, those of compress cut down, a blank line between them."""
    sections = resume_sections(df, key, text)
    order = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section"))
    content = F.when(F.col("section").isin(*compress), compressed(F.col("content"))).otherwise(F.col("content")) if compress else F.col("content")
    parts = sections.select("key", order.alias("place"), content.alias("content")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("parts"))
    return parts.select("key", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("trimmed"))


def roles(text: Column) -> Column:
    """The roles of a document as structs of company, dates, title, location, bullets and stack.

    A role begins with a line "### company — dates"; headings of skills and the like are
    none, and neither is a role without bullets. A null text has a null array.
    """

    def read(section: Column) -> Column:
        lines = F.split(section, "\n", -1)
        header = stripped(F.regexp_replace(F.element_at(lines, 1), "^#+", ""))
        body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")
        cut = F.instr(header, "—")
        found = lambda pattern: F.coalesce(stripped(F.regexp_extract(body, pattern, 1)), F.lit(""))
        marked = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), stripped), lambda x: x.startswith("- ") & ~x.startswith("- *"))
        bullets = F.filter(F.transform(marked, lambda x: stripped(F.substr(x, F.lit(3)))), lambda b: ~F.lower(b).rlike("|".join(NO_BULLETS)))
        return F.named_struct(
            F.lit("company"), F.when(cut > 0, stripped(F.substr(header, F.lit(1), cut - 1))).otherwise(header),
            F.lit("dates"), F.when(cut > 0, stripped(F.substr(header, cut + 1))).otherwise(""),
            F.lit("title"), found(rf"(?md)\*\*(?:Title|Engineering Title):\*\*{BLANK}*([^\n]+?)$"),
            F.lit("location"), found(r"\*\*([^\n]+?(?:VA|DC|MD|NY)[^\n]+?)\*\*"),
            F.lit("bullets"), bullets,
            F.lit("stack"), found(rf"(?md)\*\*Engineering stack:\*\*{BLANK}*([^\n]+?)$"),
            F.lit("skip"), F.contains(F.lower(header), F.lit(NO_ROLES[0])) | F.lower(header).rlike("|".join(NO_ROLES)),
        )

    parts = F.split(text, "\n### ", -1)
    made = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), read)
    return F.filter(made, lambda r: ~r["skip"] & (r["company"] != "") & (F.size(r["bullets"]) > 0))


def without_fillers(df: DataFrame, text: str, base: Column, fillers: tuple[str, ...] = FILLERS) -> DataFrame:
    """df, where adjectives that text has over and over and base hardly ever are taken out, from the last line on.

    Of an adjective that comes more than FILLER_MOST times, and in base FILLER_BASE times at
    most, as many go as it takes to keep FILLER_KEPT, one from each line at most, with the
    blanks behind them. One projection for each adjective: the next one reads what it left.
    """
    others = [c for c in df.columns if c != text]
    for word in fillers:
        edge = r"(?<![\p{L}\p{N}_])"
        whole, spaced = rf"(?i){edge}{word}(?![\p{{L}}\p{{N}}_])", rf"(?i){edge}{word}[ \t\r\f\x0B]+"
        count = lambda c: F.regexp_count(c, F.lit(whole))  # noqa: B023, E731
        excess = F.when((count(F.col(text)) > FILLER_MOST) & (count(base) <= FILLER_BASE), count(F.col(text)) - FILLER_KEPT).otherwise(0)
        df = df.select(*others, text, excess.alias("excess"), F.split(text, "\n", -1).alias("lines"))
        places = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(spaced), i)), lambda i: i.isNotNull())  # noqa: B023
        n = F.least(F.size("places"), F.col("excess"))
        df = df.withColumn("places", F.when(F.col("excess") > 0, places).otherwise(F.array().cast("array<int>")))
        df = df.withColumn("chosen", F.when(n > 0, F.slice("places", F.size("places") - n + 1, n)).otherwise(F.array().cast("array<int>")))
        first = rf"(?is)^(.*?){edge}{word}[ \t\r\f\x0B]+"
        kept = F.array_join(F.transform("lines", lambda x, i: F.when(F.array_contains("chosen", i), F.regexp_replace(x, first, "$1")).otherwise(x)), "\n")  # noqa: B023
        df = df.select(*others, F.when(F.size("chosen") > 0, kept).otherwise(F.col(text)).alias(text))
    return df
