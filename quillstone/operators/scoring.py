"""Alignment, duty coverage, match scores and document quality as column expressions.

What is known of the candidate is computed once on the driver and enters as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.numbers import band, clamp
from quillstone.functions.text import any_term, dollar_figures, has_term, hits, ngrams, once, overlap_share, percentages, preferred_section, required_section, required_years, role_track, without_benefits, words
from quillstone.operators.relational import blocks
from quillstone.shelf import Shelf

#: Weights by role track; other tracks use the first.
WEIGHTS = {
    "engineering": {"technical": 0.45, "experience": 0.25, "domain": 0.15, "soft": 0.10, "education": 0.05},
    "analyst": {"technical": 0.35, "experience": 0.25, "domain": 0.20, "soft": 0.10, "education": 0.10},
}
#: Degrees and their rank.
DEGREES = (("phd", 100), ("doctorate", 100), ("masters", 85), ("ms ", 85), ("mba", 85), ("bachelors", 70), ("bs ", 70), ("ba ", 70))
PREFERRED_WEIGHT, FUNCTION_PENALTY = 0.30, 20
#: Source bullets that a task holds, and counts of shared words that it makes, at once.
SOURCES_AT_ONCE, CELLS_AT_ONCE = 500, 8_000_000


@dataclass(frozen=True)
class Profile:
    """The candidate, and the vocabularies that texts are searched for."""

    skills: tuple[str, ...]
    vocabulary: tuple[str, ...]
    domains: tuple[str, ...]
    soft: Mapping[str, tuple[str, ...]]
    resume: str
    years: int
    title_groups: Mapping[str, tuple[str, ...]]
    target_groups: tuple[str, ...]
    other_functions: Mapping[str, tuple[str, ...]]
    context: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]]


def _list(xs: Iterable[str]) -> Column:
    xs = sorted(xs)
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def technical(required: Column, preferred: Column, skills: Column) -> Column:
    """Share of the wanted skills that are there, preferred ones at 0.3; 50 if none are wanted."""
    wanted = F.size(required) + PREFERRED_WEIGHT * F.size(preferred)
    have = F.size(F.array_intersect(required, skills)) + PREFERRED_WEIGHT * F.size(F.array_intersect(preferred, skills))
    return F.when(wanted > 0, F.least(100 * have / wanted, F.lit(100.0))).otherwise(50.0)


def experience(jd: Column, title: Column, profile: Profile) -> Column:
    need = required_years(jd)
    years = F.when(need == 0, 0.0).when(need <= profile.years, 25.0).otherwise(-5.0 * (need - profile.years))
    t, resume = F.lower(title), profile.resume.lower()
    credit = F.when(F.coalesce(title, F.lit("")) == "", 0.0)
    for group, titles in profile.title_groups.items():
        fits = group in profile.target_groups and any(x in resume for x in titles)
        credit = credit.when(any_term(t, titles), 25.0 if fits else 0.0)
    title_words = F.array_distinct(F.filter(F.split(t, "[ \t]+"), lambda w: w != ""))
    known = F.filter(title_words, lambda w: F.lit(resume).contains(w))
    return clamp(50 + years + credit.otherwise(25 * F.size(known) / F.greatest(F.size(title_words), F.lit(1))), 0, 100)


def domain(jd: Column, profile: Profile, found: Column | None = None) -> Column:
    """found: the domain terms of the posting, if they are a column already."""
    resume = profile.resume.lower()
    found = hits(jd, profile.domains) if found is None else found
    known = [d for d in profile.domains if d in resume]
    doubtful = F.lit(0)
    for term, (valid, penalty) in profile.context.items():
        if term in known:
            doubtful = doubtful + (has_term(jd, term) & any_term(jd, penalty) & ~any_term(jd, valid)).cast("int")
    have = F.greatest(F.size(F.array_intersect(found, _list(known))) - doubtful, F.lit(0))
    return F.when(F.size(found) > 0, F.least(100 * have / F.size(found), F.lit(100.0))).otherwise(50.0)


def soft_wanted(jd: Column, profile: Profile) -> Column:
    return F.array_compact(F.array(*(F.when(any_term(jd, syn), F.lit(name)) for name, syn in sorted(profile.soft.items()))))


def soft(jd: Column, profile: Profile, wanted: Column | None = None) -> Column:
    """wanted: the soft skills of the posting, if they are a column already."""
    resume = profile.resume.lower()
    wanted = soft_wanted(jd, profile) if wanted is None else wanted
    known = [name for name, syn in profile.soft.items() if any(s in resume for s in syn)]
    return F.when(F.size(wanted) > 0, 100 * F.size(F.array_intersect(wanted, _list(known))) / F.size(wanted)).otherwise(60.0)


def degree_rank(text: Column) -> Column:
    return F.greatest(*(F.when(text.contains(d), r).otherwise(0) for d, r in DEGREES))


def education(jd: Column, resume: Column) -> Column:
    need, have = degree_rank(jd), degree_rank(resume)
    return F.when(need > 0, F.when(have >= need, 90.0).otherwise(F.greatest(F.lit(30.0), 80.0 * have / F.nullif(need, F.lit(0))))).when(have > 0, 75.0).otherwise(50.0)


def recommendation(overall: Column, gaps: Column) -> Column:
    return F.when((overall >= 70) & (gaps <= 2), "PROCEED").when((overall >= 50) | (gaps <= 3), "FLAG").otherwise("NO_PROCEED")


def other_function(jd: Column, title: Column, profile: Profile) -> Column:
    """The first function outside the target of which two signals or more occur, else null."""
    both = F.concat_ws("\n", jd, F.lower(title))
    out = F.lit(None).cast("string")
    for name, signals in reversed(profile.other_functions.items()):
        out = F.when(F.size(hits(both, signals, boundary_up_to=0)) >= 2, name).otherwise(out)
    return out


def align(jobs: DataFrame, profile: Profile, title: str = "title", description: str = "description") -> DataFrame:
    """jobs with the five category scores, the overall score, gaps and a recommendation.

    The columns are staged, so that no text is searched twice.
    """
    text = without_benefits(F.coalesce(F.col(description), F.lit("")))
    staged = jobs.withColumn("__jd", F.lower(text)).withColumn("track", role_track(F.coalesce(F.col(title), F.lit(""))))
    staged = staged.withColumns({"__need": required_section(F.col("__jd")), "__wish": preferred_section(F.col("__jd"))})
    staged = staged.withColumns({"__all": hits(F.col("__jd"), profile.vocabulary), "__required": hits(F.col("__need"), profile.vocabulary), "__wished": hits(F.col("__wish"), profile.vocabulary)})
    staged = staged.withColumn("__preferred", F.array_union("__wished", F.array_except("__all", "__required"))).drop("__need", "__wish", "__wished")
    jd, skills = F.col("__jd"), _list(profile.skills)
    staged = staged.withColumns({"__domain": hits(jd, profile.domains), "__soft": soft_wanted(jd, profile)})
    scores = {
        "technical": F.when(F.size("__all") > 0, technical(F.col("__required"), F.col("__preferred"), skills)).otherwise(50.0),
        "experience": experience(jd, F.col(title), profile),
        "domain": domain(jd, profile, F.col("__domain")),
        "soft": soft(jd, profile, F.col("__soft")),
        "education": education(jd, F.lit(profile.resume.lower())),
    }
    staged = staged.withColumns({f"{k}_score": F.round(v, 1) for k, v in scores.items()}).withColumn("critical_gaps", F.array_except("__required", skills)).withColumn("other_function", other_function(jd, F.coalesce(F.col(title), F.lit("")), profile))
    total = None
    for k in scores:
        weight = F.when(F.col("track") == "analyst", WEIGHTS["analyst"][k]).otherwise(WEIGHTS["engineering"][k])
        part = F.round(F.col(f"{k}_score") * weight, 1)
        total = part if total is None else total + part
    overall = F.greatest(clamp(total, 0, 100) - F.when(F.col("other_function").isNotNull(), FUNCTION_PENALTY).otherwise(0), F.lit(0))
    out = staged.withColumn("overall_score", F.round(overall, 1))
    gaps = F.size("critical_gaps") + F.col("other_function").isNotNull().cast("int")
    return out.withColumn("recommendation", recommendation(F.col("overall_score"), gaps)).withColumn("critical_gaps", F.slice("critical_gaps", 1, 10)).drop("__jd", "__all", "__required", "__preferred", "__domain", "__soft")


def blended(keyword: Column, semantic: Column, threshold: float = 25) -> Column:
    """Keyword and semantic score 60 to 40 where the keyword score is worth it."""
    return F.when((keyword >= threshold) & semantic.isNotNull(), F.round(0.6 * keyword + 0.4 * semantic, 1)).otherwise(keyword)


# Kinds of duties, the middle of each one's weights, and its signals.
DUTY_KINDS = (
    ("core_technical", 0.50, (
        "python", "sql", "java", "javascript", "typescript", "golang", "rust", "api", "rest", "graphql", "microservices", "architecture", "design",
        "algorithm", "data structure", "machine learning", "ml", "ai", "nlp", "etl", "pipeline", "database", "schema", "query", "index", "aws", "azure",
        "gcp", "cloud", "docker", "kubernetes", "react", "angular", "vue", "node", "django", "flask", "fastapi", "spark", "kafka", "airflow", "dbt",
        "snowflake", "databricks", "pytorch", "tensorflow", "scikit", "pandas", "numpy", "ci/cd", "devops", "infrastructure", "terraform", "ansible",
        "build", "implement", "develop", "engineer", "code", "program", "system", "platform", "framework", "library", "tool",
    )),
    ("implementation", 0.25, (
        "deploy", "release", "ship", "deliver", "execute", "implement", "test", "unit test", "integration test", "qa", "quality", "monitor", "observe",
        "logging", "metrics", "alerting", "maintain", "support", "operate", "run", "manage", "process", "workflow", "automation", "script", "agile",
        "scrum", "sprint", "kanban", "jira", "documentation", "spec", "requirement", "requirement", "debug", "troubleshoot", "resolve", "fix", "optimize",
    )),
    ("leadership", 0.20, (
        "lead", "mentor", "coach", "guide", "manage", "team", "cross-functional", "stakeholder", "partner", "communicate", "present", "report", "align",
        "hire", "recruit", "interview", "onboard", "roadmap", "strategy", "prioritize", "plan", "influence", "drive", "own", "accountable",
        "collaborate", "coordinate", "facilitate",
    )),
    ("domain", 0.10, (
        "fintech", "finance", "banking", "payments", "compliance", "healthcare", "hipaa", "ehr", "clinical", "e-commerce", "retail", "supply chain",
        "saas", "b2b", "b2c", "enterprise", "government", "federal", "regulatory", "security", "soc2", "gdpr", "pci", "media", "content", "advertising",
        "domain", "industry", "vertical", "sector",
    )),
    ("cultural", 0.10, (
        "ownership", "initiative", "proactive", "self-starter", "adaptable", "flexible", "growth mindset", "passionate", "motivated", "driven",
        "communication", "written", "verbal", "problem-solving", "analytical", "creative", "fast-paced", "ambiguous", "autonomous", "remote",
        "distributed", "async",
    )),
)
DUTY_STOP_WORDS = ("the", "and", "for", "with", "that", "this", "will", "are", "have", "has", "our", "you", "your", "their")
#: What a tier of coverage means for the room that a kind gets, and for how much is rewritten.
SPACE = {"Strong": "expand", "Moderate": "maintain", "Weak": "trim", "Minimal": "exclude"}
INTENSITY = {"Strong": "minimal", "Moderate": "light", "Weak": "heavy", "Minimal": "exclude"}


def coverage_tier(pct: Column) -> Column:
    """Tiers are closed intervals with gaps between them; a value in a gap is Minimal."""
    between = lambda low, high, label: (pct.between(low, high), label)
    out = F.when(pct.isNull(), F.lit(None).cast("string"))
    for held, label in (between(80.0, 100.0, "Strong"), between(50.0, 79.9, "Moderate"), between(25.0, 49.9, "Weak")):
        out = out.when(held, label)
    return out.otherwise("Minimal")


def plain_words(c: Column, least: int = 3) -> Column:
    """Distinct words of at least so many letters a-z with no letter, digit or underscore beside them, in a lowered text."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(f"^[a-z]{{{least},}}$")))


def duty_lines(text: Column, most: int = 50) -> Column:
    """Bulleted or numbered lines, then distinct others that begin with a capitalised word, of plausible lengths, up to most."""
    mark = r"^([-*•]|[0-9]+[.)]) +"

    def found(lines: Column) -> Column:
        marked = F.transform(F.filter(lines, lambda x: x.rlike(mark)), lambda x: F.regexp_replace(x, mark, ""))
        marked = F.filter(marked, lambda x: (F.length(x) > 15) & (F.length(x) < 300))
        verbs = F.filter(lines, lambda x: (F.length(x) > 20) & (F.length(x) < 300) & x.rlike(r"^[A-Z][a-z]+([^\p{L}\p{N}_]|$)"))
        return once(marked, lambda m: F.slice(F.concat(m, F.array_except(verbs, m)), 1, most))

    return once(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), found)


def resume_statements(resume: str) -> list[str]:
    """Lines of one résumé that state something: bulleted ones, and longer ones that begin with a capitalised word; from 20 signs on."""
    lines = [x.strip() for x in resume.splitlines()]
    marked = [m[1] for x in lines if (m := re.match(r"(?:[-*•]|[0-9]+[.)]) (.+)", x))]
    marked += [x for x in lines if len(x) > 30 and x not in marked and re.match("[A-Z][a-z]+ ", x)]
    return [x for x in marked if len(x) >= 20]


def duty_coverage(text: Column, resume: str, at_least: float = 0.25) -> Column:
    """How far one résumé covers the duties of a description.

    A struct of coverage, tier and intensity, scores and space of each kind of duty, and the
    duties that are matched and uncovered. A duty is matched if its words, without stop words,
    have the share at_least of the words of all statements together. A kind that the text
    never names scores 75.
    """
    known = sorted(set(re.findall(r"\b[a-z]{3,}\b", " ".join(resume_statements(resume)).lower())))
    said = F.array(*map(F.lit, known)).cast("array<string>")

    def scored(t: Column) -> Column:
        def score(signals: tuple[str, ...]) -> Column:
            have = sum(s in resume.lower() for s in signals)
            wanted = sum((t.contains(s).cast("int") for s in signals), F.lit(0))
            return once(wanted, lambda n: F.when(n == 0, 75.0).otherwise(F.round(100 * F.least(have / n, F.lit(1.0)), 1)))

        return F.struct(*(score(signals).alias(kind) for kind, _, signals in DUTY_KINDS))

    def matched(duty: Column) -> Column:
        share = lambda w: F.size(F.array_intersect(w, said)) / F.nullif(F.size(w), F.lit(0)) >= at_least
        return F.coalesce(once(F.array_except(plain_words(duty), F.array(*map(F.lit, DUTY_STOP_WORDS))), share), F.lit(False))

    label = lambda tier, labels: F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), tier)
    pct = lambda k: F.least(sum((w * k[name] for name, w, _ in DUTY_KINDS), F.lit(0.0)) / sum(w for _, w, _ in DUTY_KINDS), F.lit(100.0))

    def told(kinds: Column, held: Column, pct: Column, tier: Column) -> Column:
        listed = lambda fits: F.transform(F.filter(held, lambda d: d["matched"] if fits else ~d["matched"]), lambda d: d["duty"])
        return F.struct(
            F.round(pct, 1).alias("coverage"),
            tier.alias("tier"),
            label(tier, INTENSITY).alias("intensity"),
            kinds.alias("kinds"),
            F.struct(*(once(coverage_tier(kinds[k]), lambda x: label(x, SPACE)).alias(k) for k, _, _ in DUTY_KINDS)).alias("space"),
            listed(True).alias("matched"),
            listed(False).alias("uncovered"),
        )

    # Each step is worked out once: a tier names the coverage many times, and the coverage every signal.
    duties = F.transform(duty_lines(text), lambda d: F.struct(d.alias("duty"), matched(d).alias("matched")))
    return once(
        once(F.lower(text), scored),
        lambda kinds: once(duties, lambda held: once(pct(kinds), lambda p: once(coverage_tier(p), lambda tier: told(kinds, held, p, tier)))),
    )


def match_score(title: Column, description: Column, skills: tuple[str, ...]) -> Column:
    """Half, plus 0.4 times the share of skills named, plus a tenth each for remote and senior; at most 1."""
    text = F.lower(F.concat_ws(" ", title, description))
    share = F.size(hits(text, skills, boundary_up_to=0)) / max(1, len(skills))
    return F.least(0.5 + 0.4 * share + F.when(text.contains("remote"), 0.1).otherwise(0.0) + F.when(F.lower(title).contains("senior"), 0.1).otherwise(0.0), F.lit(1.0))


def weighted(parts: Mapping[str, float]) -> Column:
    """Weighted sum of score columns; null parts count as 0."""
    out = F.lit(0.0)
    for name, weight in parts.items():
        out = out + weight * F.coalesce(F.col(name), F.lit(0.0))
    return out


def strategy(score: Column) -> Column:
    """Band, priority and days to act from a score between 0 and 1."""
    return F.struct(
        band(score, ((0.8, "apply_now"), (0.6, "tailor"), (0.4, "network")), "skip").alias("strategy"),
        band(score, ((0.8, "high"), (0.6, "medium")), "low").alias("priority"),
        F.when(score >= 0.8, 1).when(score >= 0.6, 3).when(score >= 0.4, 7).alias("days"),
    )


def skill_gaps(required: Column, preferred: Column, skills: tuple[str, ...]) -> Column:
    have = _list(skills)
    return F.struct(
        F.slice(F.array_except(required, have), 1, 3).alias("critical"),
        F.slice(F.array_except(preferred, have), 1, 5).alias("wished"),
        F.slice(F.array_intersect(required, have), 1, 5).alias("strong"),
    )


#: Patterns of titles, the first that matches decides: category, confidence, whether such postings are wanted, patterns.
CATEGORIES = (
    ("physical_infrastructure", 0.95, False, (
        r"data center.*(deliver|capacity|construction|mechanical|electrical)", r"(construction|facilities|building|plant)\s+(manager|engineer|lead)",
        r"(general\s+superintendent|site\s+lead|field\s+engineer)", r"(hvac|cooling|power\s+delivery|commissioning)",
    )),
    ("sales_marketing", 0.90, False, (
        r"^account\s+executive", r"^(enterprise|strategic|growth)\s+account", r"^(business\s+development|sales\s+development)\s+rep",
        r"^customer\s+success\s+manager", r"^(partner|channel)\s+(manager|director)",
    )),
    ("legal_finance_hr", 0.90, False, (
        r"(counsel|attorney|lawyer|paralegal)", r"^(accountant|tax\s+(manager|director|lead))", r"^(recruiter|recruiting|talent\s+acquisition)",
        r"^(payroll|compensation|benefits)\s+(manager|specialist|lead)",
    )),
    ("software_data_engineering", 0.88, True, (
        r"(software|backend|fullstack|full.stack|platform|infrastructure|site.reliability)\s+engineer", r"(data|etl|pipeline|database|db|cloud)\s+engineer",
        r"(devops|sre|reliability)\s+engineer", r"(software|application)\s+(developer|architect)", r"(frontend|front.end)\s+engineer", r"developer\b", r"swe\b",
    )),
    ("data_analysis_business_analysis", 0.88, True, (
        r"(data|business|reporting|intelligence)\s+analyst", r"(business\s+systems|bsa)\s+analyst", r"bi\s+(developer|engineer|analyst)",
        r"(tableau|power\s*bi|looker)\s+(developer|analyst|engineer)",
    )),
    ("analytics_engineering", 0.90, True, (r"analytics\s+engineer", r"(dbt|metrics|data\s+model)\s+engineer")),
    ("research_science", 0.85, False, (r"(research|applied)\s+scientist", r"(ml|machine\s+learning)\s+researcher", r"research\s+engineer")),
    ("security_operations", 0.85, False, (
        r"(security|infosec|cybersecurity|soc)\s+(engineer|analyst|architect)", r"(red\s+team|blue\s+team|threat)\s+(engineer|analyst)", r"trust\s+.?\s*safety",
    )),
    ("product_design", 0.85, False, (r"product\s+(manager|lead|director|owner)", r"(ux|ui|product)\s+designer", r"design\s+(manager|director|lead)")),
    ("executive_management", 0.80, False, (r"^(vp|vice\s+president|director|head\s+of|chief|cto|cio|cfo)\b", r"^(engineering|technical)\s+manager")),
)
#: Words of title and description that tell of engineering, and how much of a description is read.
ENGINEERING_WORDS, CATEGORY_HEAD = ("python", "sql", "data pipeline", "etl", "api", "microservice"), 500


def category(title: Column, description: Column) -> Column:
    """category, confidence and wanted of a posting: by title, then by words of the title and the description's beginning, else other."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    both = F.concat_ws(" ", t, F.lower(F.substring(F.coalesce(description, F.lit("")), 1, CATEGORY_HEAD)))

    def made(name: str, confidence: float, wanted: bool) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(confidence).alias("confidence"), F.lit(wanted).alias("wanted"))

    out = None
    for name, confidence, wanted, patterns in CATEGORIES:
        held = t.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(held, made(name, confidence, wanted)) if out is None else out.when(held, made(name, confidence, wanted))
    return out.when(any_term(both, ENGINEERING_WORDS), made("software_data_engineering", 0.65, True)).otherwise(made("other", 0.50, True))


#: Document checks: name, points that a failure costs.
SEVERITY = {"critical": 15, "major": 8, "minor": 3}


#: Fixed value: the figures that a letter has one of at least.
METRIC = r"[0-9]+[%xX]|[$][0-9,.]+[MmKkBb]?|[0-9]+[+]|[0-9]+[.][0-9]+[xX]"


def document_checks(letter: Column, resume: Column, company: Column, forbidden: tuple[str, ...], placeholders: str = r"\[[A-Za-z ]+\]|lorem ipsum|xxx") -> Column:
    """One struct (name, severity, passed) for each check of a generated letter."""
    low = F.lower(letter)
    count = F.size(F.filter(F.split(F.trim(letter), "[ \t\r\n]+"), lambda w: w != ""))
    word_count = lambda c: F.size(F.filter(F.split(c, "[ \t\r\n\f]+"), lambda w: w != ""))
    paragraphs = F.size(F.filter(F.split(letter, "\n\n"), lambda p: word_count(p) > 20))
    lines = F.split(F.regexp_replace(letter, "^[ \t\r\n\f]+|[ \t\r\n\f]+$", ""), "\n")
    body = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")).otherwise(letter)
    figures = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+[%xX]|[$][0-9,.]+[MmKkBb]?"), F.lit(0))
    repeated = F.arrays_overlap(figures(letter), figures(resume)) | once(F.lower(resume), lambda source: F.exists(ngrams(low, 6), lambda g: F.contains(source, g)))
    checks = (
        ("names_company", "major", F.lower(body).contains(F.lower(company))),
        ("length", "minor", count.between(280, 420)),
        ("paragraphs", "minor", paragraphs == 4),
        ("has_metric", "minor", letter.rlike(METRIC)),
        ("no_placeholder", "critical", ~low.rlike(placeholders)),
        ("no_forbidden_skill", "critical", ~any_term(low, forbidden) if forbidden else F.lit(True)),
        ("figures_grounded", "critical", F.size(F.array_except(F.array_union(dollar_figures(letter), percentages(letter)), F.array_union(dollar_figures(resume), percentages(resume)))) == 0),
        ("no_repetition", "major", ~F.coalesce(repeated, F.lit(False))),
    )
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.coalesce(p, F.lit(False)).alias("passed")) for n, s, p in checks))


def check_score(checks: Column) -> Column:
    """100 less the points of the failed checks, at least 0."""
    cost = F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))
    lost = F.aggregate(checks, F.lit(0), lambda s, c: s + F.when(c["passed"], 0).otherwise(F.element_at(cost, c["severity"])))
    return F.greatest(100 - lost, F.lit(0))


def _most_shared(sources: list[list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Raises most of rows (text, most, n, words) to the number of words that one of the sources has; words go."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {w: i for i, w in enumerate(sorted({w for s in sources for w in s}))}
        has = np.zeros((len(vocabulary), len(sources)), np.uint8)
        for k, s in enumerate(sources):
            has[[vocabulary[w] for w in s], k] = 1
        known = pa.array(list(vocabulary), pa.string())
        for b in batches:
            most, listed = b.column(1).to_numpy(zero_copy_only=False).copy(), b.column(3)
            rows = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
            ids = pc.fill_null(pc.index_in(listed.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            rows, ids = rows[ids >= 0], ids[ids >= 0]
            starts = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else np.zeros(0, np.int64)
            at, step = 0, max(1, CELLS_AT_ONCE // max(1, len(sources)))
            while at < len(starts):  # whole rows, as many as fit, one at least
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
                stop = starts[end] if end < len(starts) else len(ids)
                shared = np.add.reduceat(has[ids[starts[at] : stop]], starts[at:end] - starts[at], axis=0, dtype=np.int32).max(axis=1)
                most[rows[starts[at:end]]] = np.maximum(most[rows[starts[at:end]]], shared)
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(most, pa.int32()), b.column(2)], names=b.schema.names[:3])

    return search


def grounded(bullets: DataFrame, sources: DataFrame, bullet: str, source: str, least: float = 0.35) -> DataFrame:
    """Each bullet with the best share of its words that one of all source bullets has, 0 where none has any.

    Every bullet is held against every source: sources go to the tasks in blocks.
    """
    shelf, found = None, bullets.select(bullet, F.lit(0).alias("most"))
    parts = blocks(sources.select(source).distinct(), source, SOURCES_AT_ONCE)
    for i, part in enumerate(parts):
        known = [r[0] for r in part.select(words(F.col(source))).collect() if r[0]]
        w = words(F.col(bullet))
        found = found.select(bullet, "most", F.size(w).alias("n"), w.alias("words")).mapInArrow(_most_shared(known), f"`{bullet}` string, most int, n int")
        if len(parts) > 1:
            shelf = shelf or Shelf(bullets.sparkSession, "grounded")
            found = shelf.put(found, f"block_{i}")
            shelf.keep(f"block_{i}")
    best = F.round(F.when(F.col("n") > 0, F.col("most") / F.col("n")).otherwise(0.0), 4)
    return found.select(bullet, best.alias("best")).withColumn("grounded", F.col("best") >= least)


def inconsistent(values: DataFrame, key: str, doc: str, array: str) -> DataFrame:
    """Pairs of documents of one key whose value sets share nothing."""
    a, b = (values.filter(F.size(array) > 0).select(key, F.col(doc).alias(f"{doc}_{s}"), F.col(array).alias(f"{array}_{s}")) for s in "ab")
    return a.join(b, key).filter((F.col(f"{doc}_a") < F.col(f"{doc}_b")) & ~F.arrays_overlap(f"{array}_a", f"{array}_b"))


def growth(value: Column, months: int, rate: Column, boost: float = 1.0) -> Column:
    return F.round(value * F.pow(1 + rate * boost, F.lit(months)), 4)


