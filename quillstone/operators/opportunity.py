"""Scores of opportunities and companies, and checks of generated documents, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.extract import role_level
from quillstone.functions.numbers import clamp
from quillstone.functions.text import any_term, once
from quillstone.operators.matching import band_number, company_tier, skills_authenticity, term_count
from quillstone.operators.relational import top_per_group
from quillstone.operators.screening import GHOST_PATTERNS

#: Weights of the first score, points of a title's level.
WEIGHTS = {"company_tier": 0.35, "salary_match": 0.25, "skills_authenticity": 0.20, "title_level": 0.10, "industry_alignment": 0.10}
LEVELS = {"principal": 1.0, "senior": 0.9, "manager": 0.7, "default": 0.5}


@dataclass(frozen=True)
class Wishes:
    """What a candidate looks for; lists are searched as lower-case substrings."""

    ignored: tuple[str, ...]
    tiers: tuple[tuple[str, ...], ...]
    core: tuple[str, ...]
    secondary: tuple[str, ...]
    gaps: tuple[str, ...]
    excluded: tuple[str, ...]
    industries: tuple[str, ...]
    avoided_industries: tuple[str, ...]
    places: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    avoided_skills: tuple[str, ...] = ()


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def opportunity_score(company: Column, title: Column, description: Column, location: Column, salary_score: Column, wishes: Wishes) -> Column:
    """Weighted score from 0 to 1 of company tier, salary, skills, title level and industry; 0 for ignored companies.

    salary_score is null where no salary is known. A company of no tier has 0.4, none at
    all 0; avoided industries halve what the wished ones give; remote places add 0.02.
    """
    name = F.trim(F.coalesce(company, F.lit("")))
    tier = company_tier(name, wishes.tiers)
    companies = F.when(tier > 0, tier / 3.0).when(name != "", 0.4).otherwise(0.0)
    skills = skills_authenticity(description, wishes.core, wishes.secondary, wishes.gaps, wishes.excluded)
    level = role_level(title)
    levels = reduce(lambda out, kv: F.when(level == kv[0], kv[1]).otherwise(out), LEVELS.items(), F.lit(0.5))
    text = F.concat_ws(" ", F.trim(_low(title)), F.trim(_low(description)), F.trim(_low(location)))
    industry = F.least(term_count(text, wishes.industries) / max(1, len(wishes.industries)), F.lit(1.0))
    if wishes.avoided_industries:
        industry = industry * F.when(any_term(text, wishes.avoided_industries), 0.5).otherwise(1.0)
    w = WEIGHTS
    score = w["company_tier"] * companies + w["salary_match"] * F.coalesce(salary_score, F.lit(0.0)) + w["skills_authenticity"] * skills + w["title_level"] * levels + w["industry_alignment"] * industry
    score = score + F.when(_low(location).contains("remote") & (score < 1.0), 0.02).otherwise(0.0)
    ignored = any_term(F.lower(name), [x.lower() for x in wishes.ignored]) if wishes.ignored else F.lit(False)
    return F.when((name != "") & ignored, 0.0).otherwise(F.least(score, F.lit(1.0)))


@dataclass(frozen=True)
class Person:
    """What the profile-aware score knows of the candidate."""

    title: str
    years: int
    primary: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    technologies: tuple[str, ...] = ()
    certifications: tuple[str, ...] = ()


#: Weights of a person's skills by kind, and technologies that add a little each.
KINDS = (("primary", 0.3), ("secondary", 0.2), ("technologies", 0.15), ("certifications", 0.25))
CURRENT = ("ai", "machine learning", "kubernetes", "docker", "aws", "gcp", "azure", "react", "typescript")


def title_relevance(title: Column, person: Person, terms: Sequence[str]) -> Column:
    """0 to 1: search terms in the title, levels against the person's years, and words of the own title.

    Terms are tried in order: one that is part of the title ends the search with 0.6, one
    of which a word is part of it counts 0.4.
    """
    t = _low(title)
    score = F.when(any_term(t, terms), 0.6).when(any_term(t, {w for x in terms for w in x.split()}), 0.4).otherwise(0.0) if terms else F.lit(0.0)
    own = person.title.lower()
    if person.years >= 8 or "senior" in own:
        score = score + F.when(any_term(t, ("senior", "lead", "staff", "principal")), 0.3).when(any_term(t, ("jr", "junior", "entry")), -0.2).otherwise(0.0)
    elif person.years >= 5:
        score = score + F.when(any_term(t, ("senior", "lead")), 0.2).when(any_term(t, ("staff", "principal")), 0.1).otherwise(0.0)
    if own.split():
        shared = F.array_intersect(F.split(t, r"\s+"), F.array(*map(F.lit, sorted(set(own.split())))))
        score = score + 0.05 * F.size(shared)
    return clamp(score, 0.0, 1.0)


def skills_match(description: Column, person: Person, avoided: Sequence[str]) -> Column:
    """0 to 1: weighted skills that the description names, a bonus for many, current technologies, less avoided skills."""
    d = _low(description)
    weights: dict[str, float] = {}
    for kind, weight in KINDS:
        weights |= {s.lower(): weight for s in getattr(person, kind) if s}  # a later kind counts
    total = reduce(lambda a, b: a + b, (F.when(d.contains(s), w).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    many = term_count(d, tuple(weights))
    score = total + F.when(many >= 5, 0.15).when(many >= 3, 0.10).otherwise(0.0) - 0.1 * term_count(d, avoided) + 0.05 * term_count(d, CURRENT)
    return clamp(score, 0.0, 1.0)


def profile_score(title: Column, description: Column, location: Column, preferred: Column, salary_score: Column, person: Person, wishes: Wishes) -> Column:
    """Profile-aware score from 0 to 1; preferred tells whether the company is wished for."""
    place = _low(location)
    near = F.when(place.contains("remote"), 0.8).when(any_term(place, [p.lower() for p in wishes.places]), 0.6).otherwise(0.3) if wishes.places else F.when(place.contains("remote"), 0.8).otherwise(0.3)
    parts = F.when(preferred, 0.25).otherwise(0.08) + 0.20 * salary_score + 0.20 * title_relevance(title, person, wishes.terms) + 0.25 * skills_match(description, person, wishes.avoided_skills) + 0.10 * near
    return F.least(parts, F.lit(1.0))


#: Stars and what they are worth.
STARS = ((4.5, 85, "Excellent"), (3.8, 72, "Good"), (3.0, 57, "Average"), (2.5, 42, "Below Average"))


def _stars(rating: Column) -> tuple[Column, Column]:
    points = band_number(rating, [(low, p) for low, p, _ in STARS], 25)
    return points, reduce(lambda out, s: F.when(rating >= s[0], s[2]).otherwise(out), reversed(STARS), F.lit("Poor"))


def culture_score(rating: Column, reviews: Column, approval: Column) -> Column:
    """score and label of a company's culture; without rating and reviews 0 and Unknown."""
    points, label = _stars(rating)
    bonus = F.when(reviews >= 50, 5).when(reviews >= 20, 0).otherwise(-5) + F.when(approval >= 80, 5).when(approval >= 65, 0).otherwise(-5)
    unknown = (rating == 0) & (reviews == 0)
    return F.struct(F.when(unknown, 0).otherwise(clamp(points + bonus, 0, 100).cast("int")).alias("score"), F.when(unknown, "Unknown").otherwise(label).alias("label"))


def balance_score(rating: Column) -> Column:
    """score and label of work-life balance; 0 stars are unknown."""
    points, label = _stars(rating)
    return F.struct(F.when(rating == 0, 0).otherwise(points).alias("score"), F.when(rating == 0, "Unknown").otherwise(label).alias("label"))


def risk_level(culture: Column, balance: Column, layoffs: Column) -> Column:
    """Risk of a company from its two scores; layoffs raise it."""
    mean = (culture + balance) / 2
    with_layoffs = F.when(mean >= 70, "MODERATE (layoff concerns)").when(mean >= 50, "MODERATE-HIGH (layoff + culture concerns)").otherwise("HIGH (layoff + poor culture)")
    calm = F.when(mean >= 70, "LOW").when(mean >= 50, "MODERATE").when(mean >= 35, "MODERATE-HIGH").otherwise("HIGH")
    return F.when((culture == 0) & (balance == 0), "UNKNOWN").when(layoffs, with_layoffs).otherwise(calm)


def tool_tier(tool: Column, first: Sequence[str], second: Sequence[str], never: Sequence[str], exceptions: Sequence[str]) -> Column:
    """Tier of a tool's name: exceptions go before what may never be claimed, then the first and the second tier."""
    t = F.trim(F.lower(tool))
    return F.when(t.isin(*exceptions), "TIER2_EXCEPTION").when(t.isin(*never), "TIER3").when(t.isin(*first), "TIER1").when(t.isin(*second), "TIER2").otherwise("UNKNOWN")


def select_achievements(bank: DataFrame, wanted: DataFrame, top: int = 4, least: float = 65, boost: float = 5) -> DataFrame:
    """For each job (job_id, category, tools) the best achievements of its category, with boosted score and rank.

    bank (id, category, coverage, tools, blocked) has a row for each achievement and
    category. Each tool that the job asks for adds boost; ties go to the smaller id. Jobs
    that ask for the same category and tools are answered once; of achievements that no job
    can tell apart, by coverage and tools, only the first by id are held against them.
    """
    fit = bank.filter(~F.col("blocked") & (F.col("coverage") >= least)).select("id", "category", "coverage", F.col("tools").alias("has"))
    first = top_per_group(fit, ["category", "coverage", "has"], [F.col("id")], top).drop("rank")
    asked = wanted.select("category", "tools").distinct()
    pairs = asked.join(first, "category").withColumn("score", F.col("coverage") + boost * F.size(F.array_intersect("has", F.transform(F.array_distinct("tools"), F.lower))))
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    best = top_per_group(pairs, ["category", "tools"], order, top).select(F.col("category").alias("__category"), F.col("tools").alias("__tools"), "id", "score")
    jobs = wanted.join(best, (F.col("category") == F.col("__category")) & F.col("tools").eqNullSafe(F.col("__tools")))
    return top_per_group(jobs, ["job_id"], order, top).select("job_id", "rank", "id", "score")


#: Thresholds of the checks below.
ALIGNMENT_LEAST, SALARY_LEAST, DESCRIPTION_LEAST = 60, 130_000, 200


def job_checks(company: Column, title: Column, letter: Column, description: Column, score: Column, salary_min: Column, work_type: Column, location: Column, excluded: Sequence[str]) -> Column:
    """One struct (name, severity, passed) for each check of the job behind a letter. What is unknown passes."""
    low, kind, place = _low(letter), _low(work_type), _low(location)
    said = lambda c: (F.trim(F.coalesce(c, F.lit(""))) == "") | low.contains(F.lower(F.trim(c)))
    ghostly = reduce(lambda a, b: a | b, (_low(description).rlike(p) for p in GHOST_PATTERNS))
    checks = (
        ("company_and_role", "warning", said(company) & said(title)),
        ("alignment", "warning", score.isNull() | (score >= ALIGNMENT_LEAST)),
        ("salary_floor", "info", salary_min.isNull() | (salary_min >= SALARY_LEAST)),
        ("remote", "info", kind.contains("remote") | kind.contains("telecommute") | place.contains("remote") | ~kind.isin("on-site", "onsite", "in-office", "in office")),
        ("description", "warning", (F.length(F.coalesce(description, F.lit(""))) >= DESCRIPTION_LEAST) & ~ghostly),
        ("not_excluded", "critical", ~any_term(_low(company), excluded) if excluded else F.lit(True)),
    )
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.coalesce(p, F.lit(True)).alias("passed")) for n, s, p in checks))


def validate_output(text: Column, never: Sequence[str], name: str, postcode: str, wrong_postcode: str, email: str, link: str, score: Column, base: Column, floor: float = 0.90) -> Column:
    """fabrication, warnings and degraded of a generated document. An empty one is a fabrication and nothing else."""
    low = F.lower(text)
    word = lambda t: r"\b" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in t.lower()) + r"\b"
    errors = [F.when(low.rlike(word(t)), F.lit(f"tool: {t}")) for t in sorted(never)] + [F.when(text.contains(wrong_postcode), F.lit("wrong postcode"))]
    marks = (("name", name), ("postcode", postcode), ("email", email), ("link", link))
    worse = F.coalesce(score < base * floor, F.lit(False))
    warnings = [F.when(~text.contains(value), F.lit(f"missing {label}")) for label, value in marks] + [F.when(worse, F.lit("score"))]
    empty = F.coalesce(text, F.lit("")) == ""
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*errors))).alias("fabrication"),
        F.when(empty, none).otherwise(F.array_compact(F.array(*warnings))).alias("warnings"),
        (~empty & worse).alias("degraded"),
    )


def light_defense_check(description: Column, company: Column, primes: Sequence[str], clearance: Sequence[str], score: Column, most: float = 25) -> Column:
    """The score, capped for defence primes and postings that ask for clearance."""
    return F.when(any_term(_low(company), primes) | any_term(_low(description), clearance), F.least(score, F.lit(float(most)))).otherwise(score)


def supplemented(found: Column, description: Column, by_keyword: Column, least: int = 3, long: int = 1000) -> Column:
    """Skills that a model found, and those found by keyword where it found few in a long text; by keyword alone without a model."""
    few = (F.size(found) <= least) & (F.length(description) > long)
    return F.when(found.isNull(), by_keyword).when(few, F.array_union(found, by_keyword)).otherwise(found)


def merged(parts: Mapping[str, Column]) -> Column:
    """Maps merged into one; where keys repeat, the later map counts."""
    maps = list(parts.values())
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


#: Names and companies that stand for missing ones, wordings that claim a skill, and those that admit a gap.
PLACEHOLDER_NAMES = ("john doe", "jane doe", "jane smith", "john smith", "first last", "your name", "[name]", "[your name]")
PLACEHOLDER_COMPANIES = (
    "abc corporation", "xyz university", "abc university", "def startups", "acme corp", "acme inc", "example corp", "sample company",
    "company name", "[company]", "123 main st", "anytown",
)
CLAIMS = (
    "experience with {}", "expertise in {}", "proficient in {}", "skilled in {}", "worked with {}", "using {}", "built with {}", "designed with {}",
    "implemented {}", "deployed {}", "managed {}", "leveraged {}", "utilized {}",
)
GAPS = ("growth area", "to develop", "gap", "learning", "eager to learn", "would need to", "don't have", "do not have", "no experience", "not found")


def claimed_skills(text: Column, missing: Column, reach: int = 100) -> Column:
    """The skills among missing that a text claims somewhere: near a wording of a claim or of skills, and not near one of a gap."""
    low = F.lower(text)

    def claimed(skill: Column) -> Column:
        count = ((F.length(low) - F.length(F.replace(low, skill, F.lit("")))) / F.length(skill)).cast("int")
        ends = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.length(F.call_function("substring_index", low, skill, k)) + 1)

        def said(at: Column) -> Column:
            near = F.substring(low, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)) + F.length(skill) + reach)
            claims = reduce(lambda a, b: a | b, (F.contains(near, F.replace(F.lit(c), F.lit("{}"), skill)) for c in CLAIMS))
            return ~any_term(near, GAPS) & (claims | near.contains("skill"))

        return (count > 0) & F.exists(ends, said)

    return F.filter(missing, claimed)


def authentic_output(text: Column, name: Column, companies: Column, missing: Column) -> Column:
    """issues, claimed skills and confidence of a generated resume.

    The candidate's name has to occur (a part of more than three letters), no placeholder
    may, two of the known companies have to where there are any, and no missing skill may
    be claimed. One issue leaves a confidence of 0.3, more or any claimed skill 0.
    """
    parts = F.filter(F.split(F.lower(name), r"\s+"), lambda p: F.length(p) > 3)

    def checked(low: Column, claimed: Column) -> Column:
        named = (F.coalesce(name, F.lit("")) == "") | F.exists(parts, lambda p: F.contains(low, p))
        real = F.size(F.filter(companies, lambda c: F.contains(low, F.lower(c))))
        flags = [F.when(~named, F.lit("name"))] + [F.when(low.contains(p), F.lit(p)) for p in (*PLACEHOLDER_NAMES, *PLACEHOLDER_COMPANIES)] + [F.when((F.size(companies) > 0) & (real < 2), F.lit("companies"))]
        issues = F.concat(F.array_compact(F.array(*flags)), F.transform(claimed, lambda s: F.concat(F.lit("claimed: "), s)))
        return once(issues, lambda found: F.struct(found.alias("issues"), claimed.alias("claimed"), sure(found, claimed).alias("confidence")))

    sure = lambda issues, claimed: F.when(F.size(issues) == 0, 1.0).when((F.size(claimed) == 0) & (F.size(issues) == 1), 0.3).otherwise(0.0)
    return once(_low(text), lambda low: once(claimed_skills(low, missing), lambda claimed: checked(low, claimed)))


def simple_match(title: Column, description: Column, skills: Sequence[str]) -> Column:
    """0.2 for each skill in the title and 0.1 for each in the description, at most 0.9."""
    return F.least(0.2 * term_count(_low(title), skills) + 0.1 * term_count(_low(description), skills), F.lit(0.9))
