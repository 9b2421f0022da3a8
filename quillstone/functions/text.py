"""Column builders for text: cleaning, keywords, sections, extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for a row, however often f names it.

    Spark shares an expression that is named twice only where each place is sure to be
    reached; behind a condition it works it out again at every place.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_tags(c: Column) -> Column:
    """Text of simple HTML: scripts and styles go, tags become spaces, blanks are squeezed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    return squeeze(entities(c))


#: Named entities and what they stand for, in the order of replacement.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def entities(c: Column) -> Column:
    """Named entities replaced; the ampersand last, so that nothing is unescaped twice."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \n\t\r]+", " "))


def clean_description(c: Column) -> Column:
    """HTML, entities and Markdown to plain text, line breaks kept: tags first, then entities, then marks of Markdown, then blanks.

    The rules run one after the other, so that what one leaves the next one may take: an
    escaped ampersand becomes the start of an entity, a link's exclamation mark stays.
    """
    rest = r"([^\p{L}\p{N}_>][^>]*)?>"
    blank = r"[ \t\n\r\f\x0B]"
    for pattern, by in (
        (rf"(?i)<br{blank}*/?>", "\n"),
        ("(?i)</(p|div|li|tr|h[1-6])>", "\n"),
        (f"(?i)<(p|div|li|tr|h[1-6]){rest}", ""),
        ("<[^>]+>", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&nbsp;", " "),
        ("&rsquo;|&lsquo;|&#8217;|&#8216;", "'"),
        ("&rdquo;|&ldquo;|&#8220;|&#8221;", '"'),
        ("&mdash;|&#8212;", "—"),
        ("&ndash;|&#8211;", "–"),
        ("&#[0-9]+;", ""),
        (r"&[\p{L}\p{N}_]+;", ""),
        (r"\*{2,3}([^\n]+?)\*{2,3}", "$1"),
        (r"_{2,3}([^\n]+?)_{2,3}", "$1"),
        (r"\\([*\-.#\[\]()&!>`~|])", "$1"),
        (rf"(?md)^#{{1,6}}{blank}+", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
        (rf"(?md)^\\?\*{blank}+", "• "),
        ("`([^`]+)`", "$1"),
        (rf"(?md)^[-*_]{{3,}}{blank}*$", ""),
        (r"[ \t]+", " "),
        (" *\n *", "\n"),
        ("\n{3,}", "\n\n"),
        (rf"^{blank}+|{blank}+$", ""),
    ):
        c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
    return c


def whole_word(term: str) -> str:
    """A pattern for the term between characters that are neither letters nor digits; no look-around, so that other engines take it."""
    return f"(^|[^a-z0-9]){re.escape(term) if re.search(r'[^a-z0-9 ]', term) else term}([^a-z0-9]|$)"


def has_term(lower: Column, term: str, boundary_up_to: int = 3, bounded: Iterable[str] = ()) -> Column:
    """Short or listed terms as whole words, others as substrings, in a lower-case text."""
    return lower.rlike(whole_word(term)) if len(term) <= boundary_up_to or term in set(bounded) else lower.contains(term)


def hits(lower: Column, terms: Iterable[str], **how) -> Column:
    """The terms that occur, in their sorted order."""
    return F.array_compact(F.array(*(F.when(has_term(lower, t, **how), F.lit(t)) for t in sorted(terms))))


def any_term(lower: Column, terms: Iterable[str]) -> Column:
    """Whether any of the terms is a substring.

    One search each: a regular expression would try every alternative at every position.
    """
    return reduce(lambda a, b: a | b, (lower.contains(t) for t in sorted(terms)))


def present(c: Column) -> Column:
    """The value, or null where a dynamic language would call it empty."""
    return F.when((c.isNotNull()) & (F.trim(c.cast("string")) != ""), c)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*map(present, cs))


def words(c: Column, least: int = 3, stop: Iterable[str] = ()) -> Column:
    """Distinct lower-case ASCII words of at least so many letters, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, sorted(stop)))) if stop else found


def overlap_share(have: Column, want: Column) -> Column:
    """Share of want's elements that have has; null for an empty want."""
    return F.size(F.array_intersect(have, want)) / F.nullif(F.size(want), F.lit(0))


def ngrams(c: Column, n: int) -> Column:
    """All runs of n blank-separated words; none for shorter texts.

    Shifted copies of the word array are zipped: a lambda that cut runs out of it would
    split the text anew for every run.
    """

    def made(w: Column) -> Column:
        runs = F.size(w) - (n - 1)
        shifted = [F.slice(w, k + 1, runs).alias(f"w{k}") for k in range(n)]
        return F.when(runs > 0, F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *(z[f"w{k}"] for k in range(n))))).otherwise(F.array().cast("array<string>"))

    return once(F.split(squeeze(c), " "), made)


def ngram_hashes(c: Column, n: int) -> Column:
    """A 64-bit hash of each run of n blank-separated words, in order; none for shorter texts."""

    def made(w: Column) -> Column:
        runs = F.size(w) - (n - 1)
        shifted = [F.slice(w, k + 1, runs).alias(f"w{k}") for k in range(n)]
        return F.when(runs > 0, F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*(z[f"w{k}"] for k in range(n))))).otherwise(F.array().cast("array<bigint>"))

    return once(F.transform(F.split(squeeze(c), " "), lambda x: F.xxhash64(x)), made)


#: Sections of requirements and of wishes in a lowered text, and the headings of benefits.
REQUIRED = r"(?s)((required|requirements|must have|qualifications).*?)(preferred|nice to have|bonus|$)"
WISHED = r"(?s)(preferred|nice to have|bonus|desired).*$"
BENEFITS = r"(?i)(great )?benefits (for|include|package)|our (people|colleagues|comprehensive)|in addition to our competitive|\n *benefits *\n"


def required_section(lower: Column) -> Column:
    """From the first requirements heading to the first heading of wishes; the whole text if there is none."""
    found = F.regexp_extract(lower, REQUIRED, 1)
    return F.when(found == "", lower).otherwise(found)


def preferred_section(lower: Column) -> Column:
    return F.regexp_extract(lower, WISHED, 0)


def without_benefits(c: Column) -> Column:
    """The text before the first heading of benefits."""
    at = F.regexp_instr(c, F.lit(BENEFITS))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def bullets(c: Column, least: int = 15, most: int = 300, top: int = 50) -> Column:
    """Distinct bulleted lines of a plausible length, in order."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike("^[-*•] *"))
    plain = F.transform(marked, lambda x: F.regexp_replace(x, "^[-*•] *", ""))
    return F.slice(F.array_distinct(F.filter(plain, lambda x: F.length(x).between(least, most))), 1, top)


def max_years(lower: Column, present_year: int) -> Column:
    """Longest span of years named in a text: (2015-2020), (2019-present) or 7+ years."""
    spans = F.regexp_extract_all(lower, F.lit(r"\(([0-9]{4}) *[-–—] *([0-9]{4}|present)\)"), F.lit(0))
    length = F.transform(spans, lambda s: F.when(s.contains("present"), F.lit(present_year)).otherwise(F.regexp_extract(s, "[-–—] *([0-9]{4})", 1).try_cast("int")) - F.regexp_extract(s, "([0-9]{4})", 1).try_cast("int"))
    plain = F.transform(F.regexp_extract_all(lower, F.lit(r"([0-9]{1,3})[+]? *years"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.greatest(F.array_max(length), F.array_max(plain)), F.lit(0))


def required_years(lower: Column) -> Column:
    found = F.regexp_extract_all(lower, F.lit(r"([0-9]{1,3})[+]? *years? *(of +)?experience"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda y: y.cast("int"))), F.lit(0))


# Terms that are whole words at any length, and words that are no skills.
BOUNDED = (
    "access", "rest", "async", "excel", "fitz", "agile", "scrum", "lead", "react", "docker", "linux", "celery", "poetry", "jira", "go", "r", "c", "rust",
    "swift", "dart", "ruby", "scala", "bash", "spark", "kafka", "redis", "flask", "django", "spring", "rails", "vue", "next", "nest", "helm", "kong",
    "vault", "sca", "sso", "mfa", "waf", "ids", "ips", "vpn", "tls", "ssl", "pki", "cve", "edr", "xdr", "siem", "soar", "nist", "rbac", "ldap", "iast",
    "rasp", "cvss",
)
NO_SKILLS = (
    "trust", "safety", "privacy", "governance", "compliance", "strategy", "leadership", "communication", "mentoring", "collaboration", "innovation",
    "passion", "creativity", "accountability", "transparency", "integrity", "diversity", "inclusion", "payments", "fintech", "crypto", "web3",
)


def skill_in_source(skill: Column, lower: Column) -> Column:
    """Whether a text bears a skill out: it has the skill, the longest of its words, or one of five spellings of it; some words are no skills."""
    s = F.lower(F.trim(skill))
    parts = F.filter(F.split(s, "[ \t\n\r\f]+"), lambda w: w != "")
    longest = F.aggregate(parts, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    spellings = [F.replace(s, F.lit(a), F.lit(b)) for a, b in ((".", ""), (".js", ""), (" ", ""), ("-", " "), ("/", ""))]
    found = F.contains(lower, s) | (F.size(parts) >= 2) & (F.length(longest) >= 3) & F.contains(lower, longest)
    for v in spellings:
        found = found | (F.length(v) >= 2) & F.contains(lower, v)
    return F.coalesce(~s.isin(*NO_SKILLS) & found, F.lit(False))


def salary_text(low: Column, high: Column, none: str = "Not specified") -> Column:
    """A range of pay in whole dollars, or the end that is known; zero counts as unknown."""
    shown = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    has_low, has_high = F.coalesce(low != 0, F.lit(False)), F.coalesce(high != 0, F.lit(False))
    return F.when(has_low & has_high, F.concat(shown(low), F.lit(" - "), shown(high))).when(has_low, F.concat(shown(low), F.lit("+"))).when(has_high, F.concat(F.lit("Up to "), shown(high))).otherwise(none)


def shortened(c: Column, most: int = 200) -> Column:
    """The text, or as many of its first signs up to the last blank among them, with three dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), "(?s) [^ ]*$", ""), F.lit("...")))


def dollar_figures(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[$][0-9][0-9,.]*[KMBkmb]?"), F.lit(0))


def percentages(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+([.][0-9]+)?%"), F.lit(0))


def in_required_context(lower: Column, term: str, required: Iterable[str], wished: Iterable[str], reach: int = 200) -> Column:
    """Whether the first occurrence of the term stands near words of requirement rather than of wish; null texts have none."""
    # The stretch is short, so that one pattern of all words costs less than a search for each.
    said = lambda near, terms: near.rlike("|".join(re.escape(t) for t in sorted(terms)))

    def near(at: Column) -> Column:
        return F.substring(lower, F.greatest(at - reach, F.lit(1)), F.when(at > reach, F.lit(2 * reach + len(term))).otherwise(at + len(term) + reach - 1))

    return once(F.instr(lower, term), lambda at: (at > 0) & once(F.when(at > 0, near(at)), lambda x: ~(said(x, wished) & ~said(x, required))))


def seniority(title: Column) -> Column:
    """Level of a title, the highest first."""
    t = F.lower(title)
    return (
        F.when(t.rlike(r"\b(chief|ceo|cto|cfo|coo|president|founder)\b"), "c_level")
        .when(t.rlike(r"\b(vp|vice president)\b"), "vp")
        .when(t.rlike(r"\b(director|head of)\b"), "director")
        .when(t.rlike(r"\bmanager\b"), "manager")
        .when(t.rlike(r"\b(senior|sr|lead|principal|staff)\b"), "senior")
        .when(t.rlike(r"\b(junior|jr|intern|entry)\b"), "junior")
        .otherwise("mid")
    )


def role_track(title: Column) -> Column:
    """Track of a title, the first that matches; the patterns are fixed values."""
    t = F.lower(title)
    return (
        F.when(t.rlike(r"business\s+systems\s+analyst|systems\s+analyst|\bbsa\b"), "bsa")
        .when(t.rlike(r"(credit|loan|mortgage|operations)\s+(operations\s+)?analyst"), "bsa")
        .when(t.contains("analyst"), "analyst")
        .when(t.rlike(r"(engineering|technical|software)\s+manager|\b(director|vp|head\s+of)\b"), "leadership")
        .otherwise("engineering")
    )


def remote_kind(location: Column, offices: Column | None = None) -> Column:
    """Work model by a place and the names of offices: both words in the place mean hybrid; offices that say nothing mean on-site; otherwise unknown."""
    place = F.lower(F.coalesce(location, F.lit("")))
    names = F.coalesce(offices, F.array().cast("array<string>")) if offices is not None else F.array().cast("array<string>")
    told = F.filter(F.transform(names, lambda x: F.lower(F.coalesce(x, F.lit("")))), lambda x: x.contains("remote") | x.contains("hybrid"))
    first = F.get(told, F.lit(0))
    return (
        F.when(place.contains("remote") & place.contains("hybrid"), "hybrid")
        .when(place.contains("remote"), "remote")
        .when(place.contains("hybrid"), "hybrid")
        .when(first.contains("remote"), "remote")
        .when(first.contains("hybrid"), "hybrid")
        .when(F.size(names) > 0, "on_site")
    )


def remote_kind_of_text(text: Column) -> Column:
    """Work model by a free text; unknown if it says none of the words."""
    t = F.lower(F.coalesce(text, F.lit("")))
    onsite = t.contains("onsite") | t.contains("on-site") | t.contains("in-office")
    return F.when(t.contains("remote") & t.contains("hybrid"), "hybrid").when(t.contains("remote"), "remote").when(onsite, "on_site")


def remote_kind_of_flag(is_remote: Column, description: Column) -> Column:
    """Work model by a flag, where the description of a job that isn't remote may say hybrid; unknown without a flag."""
    return F.when(is_remote, "remote").when(~is_remote & F.lower(F.coalesce(description, F.lit(""))).contains("hybrid"), "hybrid").when(~is_remote, "on_site")


def remote_kind_of_row(is_remote: Column, location: Column) -> Column:
    """Work model by a flag as text, else by the place; never unknown."""
    place = F.lower(F.coalesce(location, F.lit("")))
    yes = F.lower(F.coalesce(is_remote, F.lit(""))).isin("true", "1", "yes")
    return F.when(yes | place.contains("remote"), "remote").when(place.contains("hybrid"), "hybrid").otherwise("on_site")


def remote_kind_of_workplace(is_remote: Column, workplace: Column) -> Column:
    """Work model by a flag and a kind of workplace; unknown for a kind that isn't known."""
    kind, flag = F.lower(F.coalesce(workplace, F.lit(""))), F.coalesce(is_remote, F.lit(False))
    return F.when(flag | (kind == "remote"), "remote").when(kind == "hybrid", "hybrid").when(kind.isin("onsite", "on-site", ""), "on_site")


def company_candidates(name: Column) -> Column:
    """Names under which a company may be known: trading name, without suffix, without parentheses, as given."""
    suffix = r"(?i)[, ]+(inc|llc|ltd|corp|corporation|co|gmbh|plc|lp|llp)[.]?$"
    trading = F.regexp_extract(name, r"(?i)d/?b/?a[: ]+(.+)$", 1)
    before = F.regexp_replace(name, r"(?i),? *d/?b/?a.*$", "")
    bare = F.regexp_replace(before, suffix, "")
    options = F.array(trading, bare, F.regexp_replace(bare, r" *\([^)]*\)", ""), before, name)
    return F.array_distinct(F.filter(F.transform(options, lambda x: F.trim(x)), lambda x: x != ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_key(kind: str, c: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), c), 256), 1, length)


def undated_hash(c: Column, length: int = 16) -> Column:
    """Digest of a description without day-month-year dates and case, to see reposts; the date pattern is a fixed value."""
    plain = F.regexp_replace(F.lower(c), r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "")
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\s+", " "), 256), 1, length)


#: What Windows' Western code page has between 0x80 and 0x9F, and the signs of the same bytes in Latin-1; five bytes have nothing.
_WESTERN = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_SHOWN, _PLACES = "".join(w for _, w in _WESTERN if w), "".join(p for p, w in _WESTERN if w)
# Sequences that are broken beyond decoding, and the signs that they stand for.
BROKEN_SIGNS = (
    ("\u00f0\u0178\u201c\u02c6", "\U0001f4c8"), ("\u00f0\u0178\u017d\u00aa", "\U0001f3aa"), ("\u00f0\u0178\u201c\u0160", "\U0001f4ca"),
    ("\u00f0\u0178\u2019\u00aa", "\U0001f4aa"), ("\u00f0\u0178\u2018\u201d", "\U0001f454"), ("\u00f0\u0178\u00a4\u009d", "\U0001f91d"),
    ("\u00f0\u0178\u00a2", "\U0001f3c6"), ("\u00f0\u0178\u00ad", "\U0001f3e2"), ("\u00f0\u0178\u2019\u00a1", "\U0001f4a1"),
    ("\u00f0\u0178\u2018\u00a5", "\U0001f465"), ("\u00f0\u0178\u0152", "\U0001f30d"),
)


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Windows' Western page or as Latin-1, read again; then some broken signs replaced. Anything else stays."""
    raw = lambda x: F.encode(x, "ISO-8859-1")
    valid = lambda x: F.try_validate_utf8(raw(x).cast("string")).isNotNull()
    western = F.translate(c, _SHOWN, _PLACES)
    # Conditions one inside the other: only texts that have bytes on the page are encoded at all.
    on_western, on_latin = c.rlike(f"^[\\x00-\\x7F\\xA0-\\xFF{_SHOWN}]*$"), c.rlike("^[\\x00-\\xFF]*$")
    latin = F.when(on_latin, F.when(valid(c), F.decode(raw(c), "UTF-8")).otherwise(c)).otherwise(c)
    c = F.when(on_western, F.when(valid(western), F.decode(raw(western), "UTF-8")).otherwise(latin)).otherwise(latin)
    for broken, sign in BROKEN_SIGNS:
        c = F.replace(c, F.lit(broken), F.lit(sign))
    return c


def lenient_json(c: Column, schema: str) -> Column:
    """JSON as a struct; of a chatty answer, the first {...} in it."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("{"), c), schema), F.from_json(F.when(inner != "", inner), schema))
