"""Scoring ladders and matchers of postings, companies, contacts and letters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.numbers import band
from quillstone.functions.text import any_term, words


def first_failing(rules: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first rule that doesn't hold, or null; a rule that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for holds, reason in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), reason).otherwise(out)
    return out


def company_tier(name: Column, tiers: Sequence[Sequence[str]]) -> Column:
    """1 for a name with a term of the first list, 2 of the second and so on, 0 for none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(0)
    for i in range(len(tiers), 0, -1):
        out = F.when(any_term(low, [t.lower() for t in tiers[i - 1]]), i).otherwise(out)
    return out


def salary_ladder(low: Column, high: Column, required: float, target: tuple[float, float], stretch: float, dream: float) -> Column:
    amount = F.coalesce(high, low)
    return F.when(amount.isNull(), 0.5).otherwise(band_number(amount, ((dream, 1.0), (stretch, 0.9), (target[1], 0.8), (target[0], 0.7), (required, 0.6)), 0.5))


def band_number(c: Column, bounds: Sequence[tuple[float, float]], otherwise: float) -> Column:
    out = None
    for low, value in bounds:
        out = F.when(c >= low, value) if out is None else out.when(c >= low, value)
    return out.otherwise(otherwise)


def term_count(low: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (low.contains(t.lower()).cast("int") for t in terms), F.lit(0))


def skills_authenticity(text: Column, core: Sequence[str], secondary: Sequence[str], gaps: Sequence[str], excluded: Sequence[str]) -> Column:
    """Core terms count 1, secondary 0.5, gaps -0.3 and excluded ones -0.5 where something is required; a tenth of the sum, within 0 and 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hard = low.contains("required").cast("int")
    total = term_count(low, core) + 0.5 * term_count(low, secondary) - hard * (0.3 * term_count(low, gaps) + 0.5 * term_count(low, excluded))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 10))


def title_match(title: Column, roles: Sequence[str]) -> Column:
    """1 if a role is part of the title, else a third for each shared word, at most 1."""
    low = F.lower(F.coalesce(title, F.lit("")))
    known = sorted({w for r in roles for w in r.lower().split()})
    shared = F.size(F.array_intersect(F.array_distinct(F.split(low, " ")), F.array(*map(F.lit, known))))
    return F.when(any_term(low, [r.lower() for r in roles]), 1.0).otherwise(F.least(shared / 3, F.lit(1.0)))


def job_match(title: Column, company: Column, text: Column, location: Column, remote: Column, salary: Column, roles: Sequence[str], companies: Sequence[str], required: Sequence[str], preferred: Sequence[str], salary_floor: float, cities: Sequence[str]) -> Column:
    """Weighted score of title, company, skills, place and salary, with its label."""
    low = F.lower(text)
    parts = (
        (0.3, title_match(title, roles)),
        (0.2, F.when(company.isin(*companies), 1.0).when(any_term(F.lower(company), ("tech", "software", "data")), 0.5).otherwise(0.0)),
        (0.3, F.least(0.7 * term_count(low, required) / len(required) + 0.3 * term_count(low, preferred) / len(preferred), F.lit(1.0))),
        (0.1, F.when(remote, 1.0).when(any_term(location, cities), 0.7).otherwise(0.3)),
        (0.1, F.when(salary >= salary_floor, 1.0).when(salary >= 0.8 * salary_floor, 0.7).when(salary.isNotNull(), 0.3).otherwise(0.5)),
    )
    score = F.round(reduce(lambda a, b: a + b, (w * F.coalesce(c, F.lit(0.0)) for w, c in parts)), 4)
    return F.struct(score.alias("score"), band(score, ((0.8, "Excellent Match"), (0.7, "Good Match"), (0.6, "Fair Match")), "Poor Match").alias("level"))


def share_of(have: Column, want: Column, if_none: float) -> Column:
    return F.when(F.size(want) > 0, F.size(F.array_intersect(have, want)) / F.size(want)).otherwise(if_none)


def qualification(skills: Column, experience: Column, preference: Column, growth: Column) -> Column:
    return F.round(0.35 * skills + 0.25 * experience + 0.25 * preference + 0.15 * growth, 3)


def qualification_skills(required: Column, preferred: Column, own: Sequence[str]) -> Column:
    """Seven tenths for the share of required skills, three for that of preferred ones; without any, 1 and 0.5."""
    have = F.array(*map(F.lit, own)).cast("array<string>")
    share = lambda c, none: F.when(F.size(F.array_distinct(c)) > 0, F.size(F.array_intersect(c, have)) / F.size(F.array_distinct(c))).otherwise(none)
    return F.least(F.lit(1.0), 0.7 * share(required, 1.0) + 0.3 * share(preferred, 0.5))


# Words of a company's trade, and of descriptions that promise learning.
TRADE_WORDS = ("technology", "tech", "software", "saas", "startup")
LEARNING_WORDS = ("learning", "development", "training", "new", "cutting-edge", "innovative")


def qualification_experience(asked: Column, company: Column, size: Column, years: int, sizes: Sequence[str], led: int) -> Column:
    """Years held against the first number of years asked for, the company's trade and size, and leading where that is asked for."""
    low = F.lower(F.coalesce(asked, F.lit("")))
    wanted = F.coalesce(F.regexp_extract(low, "([0-9]+)[+]?[ \\t\\r\\n\\f]*years?", 1).try_cast("int"), F.lit(0))
    held = lambda c, terms: reduce(lambda a, b: a | b, (F.contains(F.coalesce(c, F.lit("")), F.lit(t)) for t in terms), F.lit(False))
    share = F.least(F.lit(1.0), F.lit(years) / F.greatest(wanted, F.lit(1)))
    trade = F.when(held(F.lower(company), TRADE_WORDS), 1.0).otherwise(0.7)
    leads = F.when(~F.contains(low, F.lit("leadership")) | F.lit(led > 0), 1.0).otherwise(0.3)
    return F.least(F.lit(1.0), share * 0.4 + trade * 0.2 + F.when(held(size, sizes), 1.0).otherwise(0.6) * 0.2 + leads * 0.2)


def qualification_preference(friendly: Column, location: Column, low: Column, high: Column, stage: Column, remote: bool, places: Sequence[str], wanted: tuple[float, float], stages: Sequence[str]) -> Column:
    """Place or remote work, overlap of the pay with what is wanted, stage of the company."""
    place = F.coalesce(location, F.lit(""))
    there = reduce(lambda a, b: a | b, (F.contains(place, F.lit(p)) for p in places), F.lit(False))
    where = F.when((F.coalesce(friendly, F.lit(False)) | F.contains(place, F.lit("Remote"))) & F.lit(remote), 1.0).when(there, 0.8).otherwise(0.4)
    return F.least(F.lit(1.0), where * 0.4 + preference_salary(low, high, *wanted) * 0.35 + F.when(stage.isin(*stages), 1.0).otherwise(0.7) * 0.25)


def qualification_growth(title: Column, offers: Column, description: Column, roles: Sequence[str], areas: Sequence[str]) -> Column:
    """A wanted role in the title, offers that touch the areas to grow in, words of learning (a fifth each)."""
    within = lambda c, terms: reduce(lambda a, b: a | b, (F.contains(c, F.lit(t.lower())) for t in terms), F.lit(False))
    role = F.when(within(F.lower(F.coalesce(title, F.lit(""))), roles), 1.0).otherwise(0.6)
    met = F.size(F.filter(F.coalesce(offers, F.array().cast("array<string>")), lambda o: within(F.lower(o), areas)))
    growing = F.least(F.lit(1.0), met / len(areas)) if areas else F.lit(0.5)
    text = F.lower(F.coalesce(description, F.lit("")))
    learning = F.least(F.lit(1.0), sum((F.when(F.contains(text, F.lit(w)), 0.2).otherwise(0.0) for w in LEARNING_WORDS), F.lit(0.0)))
    return F.least(F.lit(1.0), role * 0.4 + growing * 0.35 + learning * 0.25)


def preference_salary(low: Column, high: Column, want_low: float, want_high: float) -> Column:
    """Share of the wanted range that is offered, 0.3 without overlap, 0.6 if nothing is known."""
    overlap = F.least(F.lit(1.0), (F.least(high, F.lit(want_high)) - F.greatest(low, F.lit(want_low))) / (want_high - want_low))
    return F.when(low.isNull() | high.isNull(), 0.6).when((high >= want_low) & (low <= want_high), overlap).otherwise(0.3)


def contact_score(mutual: Column, title: Column, relevant: Column, activity: Column, company: Column) -> Column:
    low = F.lower(title)
    parts = (
        F.least(mutual / 10, F.lit(0.3)),
        F.when(any_term(low, ("vp", "cto", "ceo", "director", "head")), 0.25).when(any_term(low, ("senior", "lead", "principal")), 0.15),
        F.when(relevant, 0.2),
        F.when(activity.contains("hours"), 0.15).when(activity.contains("day"), 0.1),
        F.when(any_term(F.lower(company), ("startup", "corp", "inc")), 0.1),
    )
    return F.least(reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)), F.lit(1.0))


def audience(title: Column, text: Column) -> Column:
    """Who reads an application: by the reader's title, else by the description's language."""
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike("ceo|cto|cfo|chief|founder"), "c_suite")
        .when(t.rlike("vp|vice president|head of"), "vp")
        .when(t.rlike("manager|director|lead"), "manager")
        .when(t.rlike("engineer|developer|analyst|architect"), "ic")
        .when(d.rlike("(^|[^a-z])(executive|strategic|org|organization|board)([^a-z]|$)"), "vp")
        .when(d.rlike("(^|[^a-z])(mentor|lead|architect|staff|principal)([^a-z]|$)"), "ic")
        .otherwise("manager")
    )


def query_relevant(title: Column, description: Column, query: str, head: int = 1000) -> Column:
    """Whether any word of a query, of two letters or more, is in the title or the start of the description."""
    text = F.lower(F.concat_ws(" ", title, F.left(F.coalesce(description, F.lit("")), F.lit(head))))
    terms = [w for w in query.lower().split() if len(w) >= 2]
    return any_term(text, terms) if terms else F.lit(True)


def wanted(title: Column, text: Column, company: Column, include: Sequence[str], exclude: Sequence[str], always: Sequence[str]) -> Column:
    """Postings of target companies, and those with a word to include and none to exclude."""
    both = F.lower(F.concat_ws(" ", title, text))
    return company.isin(*always) | (any_term(both, include) & ~any_term(both, exclude))


def role_relevance(role: Column, job: Column, tools: Sequence[str]) -> Column:
    """Shared words, and twice the shared tools."""
    a, b = words(role), words(job)
    shared = [F.lower(role).contains(t) & F.lower(job).contains(t) for t in tools]
    return F.size(F.array_intersect(a, b)) + 2 * reduce(lambda x, y: x + y, (s.cast("int") for s in shared), F.lit(0))


def duty_categories(jd: Column, resume: str, signals: Mapping[str, Sequence[str]], weights: Mapping[str, float]) -> Column:
    """Weighted coverage of duty categories; one the posting doesn't touch counts 75."""
    low, total = F.lower(jd), F.lit(0.0)
    for name, terms in signals.items():
        asked, have = term_count(low, terms), sum(t in resume.lower() for t in terms)
        total = total + weights[name] * F.when(asked == 0, 75.0).otherwise(F.round(100 * F.least(have / asked, F.lit(1.0)), 1))
    return F.least(total / sum(weights.values()), F.lit(100.0))


def platform_violations(text: Column, bullets_only: bool, most_words: int, plain: bool) -> Column:
    """Names of the format rules that a text breaks."""
    marked = text.rlike(r"(?m)^[ \t]*([-*•]|[0-9]+[.)]) .+")
    count = F.size(F.filter(F.split(F.trim(text), "[ \t\r\n]+"), lambda w: w != ""))
    checks = [("no_bullets", ~marked)] if bullets_only else []
    checks += [("too_long", count > most_words)]
    checks += [("html", text.rlike("<[a-zA-Z][^>]*>|</[a-zA-Z]+>")), ("markdown", text.rlike(r"(?m)^#{1,6} +.+"))] if plain else []
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks)))


def authenticity(letter: Column, resume: Column, blocked: Sequence[str]) -> Column:
    """100 less 15 for each figure that the résumé lacks and each blocked tool, and 7 for each year it lacks; at least 0."""
    def lacking(pattern: str) -> Column:
        return F.size(F.array_except(F.regexp_extract_all(letter, F.lit(pattern), F.lit(0)), F.regexp_extract_all(resume, F.lit(pattern), F.lit(0))))

    figures, years = lacking("[$][0-9][0-9,.]*[KMkm]?|[0-9]+%"), lacking("(19|20)[0-9]{2}")
    return F.greatest(100 - 15 * (figures + term_count(F.lower(letter), blocked)) - 7 * years, F.lit(0))


# Words of inflated scope with what may stand for them, services that aren't verified, figures of a letter.
SCOPE_WORDS = {
    "architected": ("designed", "built", "implemented", "contributed to"),
    "owned": ("managed", "supported", "led", "was responsible for"),
    "spearheaded": ("led", "initiated", "drove", "supported"),
    "transformed": ("improved", "enhanced", "updated", "modified"),
    "revolutionized": ("improved", "modernized", "updated"),
    "single-handedly": ("contributed", "helped", "supported"),
}
UNVERIFIED = ("azure key vault", "azure functions", "azure cosmos db", "azure synapse", "azure databricks", "azure machine learning")
FIGURE = r"(?i)([0-9][0-9,.]* *(?:%|percent|x(?![\p{L}\p{N}_])|\$[0-9,]+|million|billion|k(?![\p{L}\p{N}_])|hours?|days?|weeks?|minutes?|seconds?))"


def audit(letter: Column, resume: Column, history: Column | None = None) -> Column:
    """What a letter says beyond its résumé: a struct of score, passed, and the figures, scope words, tools and employers that speak against it.

    A figure is borne out if some number of it is anywhere in the résumé; each that isn't counts,
    repeated ones too. A scope word needs itself or one of its alternatives there, a tool
    itself. An employer (structs of employer and start in history) counts if the letter names
    a year from 2000 on before its start. Figures and tools cost 15, the others 7; without
    figures and tools the letter passes. A null letter has no violations.
    """
    low, source = F.lower(F.coalesce(letter, F.lit(""))), F.lower(F.coalesce(resume, F.lit("")))
    numbers = lambda m: F.regexp_extract_all(m, F.lit("[0-9][0-9,.]*"), F.lit(0))
    figures = F.filter(F.regexp_extract_all(F.coalesce(letter, F.lit("")), F.lit(FIGURE), F.lit(1)), lambda m: ~F.exists(numbers(m), lambda n: F.contains(source, n)))
    borne = lambda terms: reduce(lambda a, b: a | b, (F.contains(source, F.lit(t)) for t in terms))
    scope = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)) & ~borne((w, *others)), F.lit(w)) for w, others in SCOPE_WORDS.items())))
    tools = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)) & ~borne((t,)), F.lit(t)) for t in UNVERIFIED)))
    years = F.regexp_extract_all(F.coalesce(letter, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])(20[0-9]{2})(?![\p{L}\p{N}_])"), F.lit(1))
    none = F.array().cast("array<string>")
    jobs = F.transform(F.filter(history, lambda h: (h["start"] != "") & F.exists(years, lambda y: y < F.substring(h["start"], 1, 4))), lambda h: h["employer"]) if history is not None else none
    critical = F.size(figures) + F.size(tools)
    score = F.greatest(100.0 - 15 * critical - 7 * (F.size(scope) + F.size(jobs)), F.lit(0.0))
    return F.struct(score.alias("score"), (critical == 0).alias("passed"), figures.alias("figures"), scope.alias("scope"), tools.alias("tools"), jobs.alias("employers"))


def network_indices(contacts: DataFrame, industry: str, location: str, role: str, company: str, mutual: int | Column) -> DataFrame:
    """One row with strengths of four groupings of contacts, their diversity, and the reach of the network.

    A grouping's strength is its share of all memberships, its diversity its groups over its
    members; a null value is no member. Reach joins the network's size, the share of mutual
    contacts and diversity. Without contacts strengths are null and the rest counts as 0.
    """
    dims = (industry, location, role, company)
    one = contacts.agg(*(F.count(c).alias(f"n_{c}") for c in dims), *(F.count_distinct(c).alias(f"g_{c}") for c in dims), F.count(F.lit(1)).alias("size"))
    total = sum((F.col(f"n_{c}") for c in dims), F.lit(0))
    strength = {k: F.try_divide(F.col(f"n_{c}"), total) for k, c in (("industry", industry), ("location", location), ("role", role), ("company", company))}
    overall = strength["industry"] * 0.3 + strength["location"] * 0.2 + strength["role"] * 0.25 + strength["company"] * 0.25
    diverse = lambda c: F.col(f"g_{c}") / F.greatest(F.col(f"n_{c}"), F.lit(1))
    diversity = F.round(diverse(industry) * 0.4 + diverse(location) * 0.3 + diverse(role) * 0.3, 3)
    size = F.when(F.col("size") <= 100, 0.5).when(F.col("size") <= 500, 0.75).when(F.col("size") <= 1000, 0.9).otherwise(1.0)
    reach = size * 0.4 + F.coalesce(F.try_divide(mutual if isinstance(mutual, Column) else F.lit(mutual), F.col("size")), F.lit(0.0)) * 0.3 + diversity * 0.3
    return one.select(*(F.round(v, 3).alias(f"{k}_strength") for k, v in strength.items()), F.round(overall, 3).alias("overall_strength"), diversity.alias("diversity"), F.round(reach, 3).alias("reach"))


def enriched(jobs: DataFrame, details: DataFrame, key: str, fill: Sequence[str], longer: Sequence[str] = ()) -> DataFrame:
    """Missing values of fill columns from details by key; of longer columns the longer value wins."""
    d = details.select(key, *(F.col(c).alias(f"__{c}") for c in (*fill, *longer)))
    out = jobs.join(d, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in fill})
    out = out.withColumns({c: F.when(F.length(f"__{c}") > F.coalesce(F.length(c), F.lit(0)), F.col(f"__{c}")).otherwise(F.col(c)) for c in longer})
    return out.drop(*(f"__{c}" for c in (*fill, *longer)))


def lookup_by_candidates(rows: DataFrame, candidates: Column, table: DataFrame, name: str, values: Sequence[str], key: str) -> DataFrame:
    """rows with values of the table's row that matches the earliest candidate name, case aside."""
    each = rows.select(key, F.posexplode(candidates).alias("__at", "__name")).withColumn("__name", F.lower("__name"))
    known = table.select(F.lower(name).alias("__name"), F.struct(*values).alias("__v"))
    best = each.join(known, "__name").groupBy(key).agg(F.min_by("__v", "__at").alias("__v"))
    return rows.join(best, key, "left").select("*", *(F.col(f"__v.{v}").alias(f"found_{v}") for v in values)).drop("__v")


def resolve_references(records: DataFrame, entries: DataFrame, ref: str, key: str = "id", value: str = "value") -> DataFrame:
    """Records with the entry that a reference of a normalised cache points to."""
    return records.join(entries.select(F.col(key).alias(ref), F.col(value).alias("resolved")), ref, "left")
