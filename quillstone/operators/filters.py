"""Composable filters, named sort orders and paging over postings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places by region, as substrings of a location.
REGIONS = {
    "us": ("united states", "usa"),
    "uk": ("united kingdom", "england", "london"),
    "canada": ("canada", "toronto", "vancouver"),
    "europe": ("germany", "france", "romania", "spain", "netherlands"),
}


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Case-insensitive substring search for any of the terms; wildcards in them are literal."""
    def pattern(t: str) -> str:
        escaped = t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return f"%{escaped}%"

    return reduce(or_, (c.ilike(pattern(t)) for t in terms))


def recent_or_unknown(c: Column, as_of: datetime, days: int) -> Column:
    """Not older than so many days, or without a date."""
    return c.isNull() | (c >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


@dataclass(frozen=True)
class JobQuery:
    """What a list of postings is asked for. None leaves a condition out."""

    as_of: datetime
    days: int | None = None
    source: str | None = None
    remote_only: bool = False
    search: str | None = None
    min_score: float | None = None
    min_salary: float | None = None
    region: str | None = None
    sort: str = "default"
    limit: int | None = None
    offset: int = 0

    def conditions(self) -> list[Column]:
        out = []
        if self.days is not None:
            out.append(recent_or_unknown(F.col("posted_date"), self.as_of, self.days))
        if self.source:
            out.append(F.col("source_site") == self.source)
        if self.remote_only:
            out.append(F.col("remote_type") == "remote")
        if self.search:
            out.append(reduce(or_, (contains_any(F.col(c), (self.search,)) for c in ("title", "company", "description"))))
        if self.min_score is not None:
            out.append(F.col("alignment_score") >= self.min_score)
        if self.min_salary is not None:
            out.append(F.coalesce("salary_max", "salary_min", F.lit(0)) >= self.min_salary)
        if self.region:
            out.append(contains_any(F.col("location"), REGIONS[self.region]))
        return out

    def order(self) -> list[Column]:
        newest, key = F.col("posted_date").desc_nulls_last(), F.col("id")
        named = {
            "score": [F.col("alignment_score").desc_nulls_last(), newest],
            "salary": [F.coalesce("salary_max", "salary_min", F.lit(0)).desc(), newest],
            "culture": [F.col("company_rating").desc_nulls_last(), newest],
            "date": [newest],
            "default": [F.when(F.col("remote_type") == "remote", 0).when(F.col("remote_type") == "hybrid", 1).otherwise(2), F.coalesce("salary_max", "salary_min", F.lit(0)).desc(), newest],
        }
        return [*named[self.sort], key]

    def apply(self, jobs: DataFrame) -> DataFrame:
        found = self.conditions()
        out = jobs.filter(reduce(and_, found)) if found else jobs
        if self.limit is None and not self.offset:
            return out.orderBy(*self.order())
        out = out.orderBy(*self.order()).offset(self.offset) if self.offset else out.orderBy(*self.order())
        return out.limit(self.limit) if self.limit is not None else out


# What places a job in a region.
LOCATIONS = {
    "us": (
        "United States", ", US", "USA", ", CA", ", NY", ", WA", ", TX", ", VA", "San Francisco", "New York", "Seattle", "Remote - USA", "Remote, US",
    ),
    "uk": ("United Kingdom", ", UK", "London", "England"),
    "canada": ("Canada", "Toronto", "Vancouver", "Montreal"),
    "europe": ("Germany", "France", "Netherlands", "Spain", "Ireland", "Berlin", "Amsterdam", "Europe"),
}


@dataclass(frozen=True)
class JobList:
    """The list of active jobs of the last days, by a source, words, scores, a place and what came of them. None leaves a condition out.

    A place is a work model (remote, hybrid) or a region; other names leave it out. status is
    "new", for jobs without an answer, or a kind of answer. Jobs without a date posted stay.
    """

    as_of: datetime
    days: int = 7
    limit: int = 200
    source: str | None = None
    remote_only: bool = False
    search: str | None = None
    sort: str = "remote_first"
    min_score: float | None = None
    min_salary: float | None = None
    seniority: str | None = None
    location: str | None = None
    status: str | None = None

    def conditions(self) -> list[Column]:
        since = F.lit(self.as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(self.days))
        out = [F.col("scraped_date") >= since, F.col("is_active"), F.col("posted_date").isNull() | (F.col("posted_date") >= since)]
        if self.source:
            out.append(F.col("source_site") == self.source)
        if self.remote_only:
            out.append(F.col("remote_type") == "remote")
        if self.search:
            out.append(reduce(or_, (contains_any(F.col(c), (self.search,)) for c in ("title", "company", "description"))))
        if self.min_score:
            out.append(F.col("alignment_score") >= self.min_score)
        if self.min_salary:
            out.append(F.coalesce("salary_max", "salary_min", F.lit(0)) >= self.min_salary)
        if self.seniority:
            out.append(F.col("experience_level") == self.seniority)
        if self.location in ("remote", "hybrid"):
            out.append(F.col("remote_type") == self.location)
        elif self.location in LOCATIONS:
            out.append(contains_any(F.col("location"), LOCATIONS[self.location]))
        return out

    def order(self) -> list[Column]:
        """The named order, then the newest, then the id."""
        down = lambda c: F.coalesce(c, F.lit(0)).desc()
        named = {
            "remote_first": [F.when(F.col("remote_type") == "remote", 0).when(F.col("remote_type") == "hybrid", 1).otherwise(2), down("alignment_score"), down("salary_max")],
            "score": [down("alignment_score")],
            "salary": [down("salary_max")],
            "culture": [down("company_rating"), down("alignment_score")],
        }
        return [*named.get(self.sort, []), F.col("scraped_date").desc_nulls_last(), F.col("id")]

    def apply(self, jobs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """jobs that meet the conditions, in order; answers (job_id, response_type) are read for a status alone."""
        out = jobs.filter(reduce(and_, self.conditions()))
        if self.status and answers is not None:
            asked = F.col("response_type") != "none" if self.status == "new" else F.col("response_type") == self.status
            known = answers.filter(asked).select(F.col("job_id").alias("id"))
            out = out.join(known, "id", "left_anti" if self.status == "new" else "left_semi")
        return out.orderBy(*self.order()).limit(self.limit)
