"""Labelled text out of detail pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.dom import Pick, Sel, element_texts
from postsieve.functions.text import filled

BLANK_LINE_LABELS = {"body": "\nJob Description:\n", "fallback": "\nPage Content:\n"}


@dataclass(frozen=True)
class Rules:
    """Where a platform keeps the parts of a posting.

    For title to salary the selectors are tried in order until one gives text. Tags,
    body and fallback take the first element in document order that any selector of
    theirs matches; the fallback counts only where there is no body element.
    """

    title: tuple[Sel, ...]
    company: tuple[Sel, ...]
    location: tuple[Sel, ...]
    salary: tuple[Sel, ...]
    body: tuple[Sel, ...]
    fallback: tuple[Sel, ...]
    tags: tuple[Sel, ...] = ()

    @property
    def fields(self) -> list[tuple[str, tuple[Sel, ...]]]:
        return [
            ("Title: ", self.title),
            ("Company: ", self.company),
            ("Location: ", self.location),
            ("Salary: ", self.salary),
        ]

    @property
    def picks(self) -> tuple[Pick, ...]:
        single = [Pick((s,)) for _, selectors in self.fields for s in selectors]
        return (*single, *[Pick(s, lines=True) for s in (self.tags, self.body, self.fallback)])


def _c(*names: str) -> Sel:
    return Sel(cls=names)


def _testid(value: str) -> Sel:
    return Sel(attr=("data-testid", value))


# The elements that hold each part of a posting, by platform.
DETAIL_RULES = {
    "LinkedIn": Rules(
        title=(
            _c("jobs-unified-top-card__job-title"),
            _c("job-details-jobs-unified-top-card__job-title"),
            _c("incareer-job-top-card__job-title"),
            Sel(tag="h1", cls=("topcard__title",)),
            Sel(tag="h1"),
        ),
        company=(
            _c("jobs-unified-top-card__company-name"),
            _c("job-details-jobs-unified-top-card__company-name"),
            _c("incareer-job-top-card__company-name"),
            _c("topcard__org-name-link"),
            Sel(tag="a", part=("href", "/company/")),
        ),
        location=(
            _c("jobs-unified-top-card__bullet"),
            _c("jobs-unified-top-card__workplace-type"),
            _c("incareer-job-top-card__bullet"),
            _c("topcard__flavor--bullet"),
        ),
        salary=(
            _c("jobs-unified-top-card__job-insight--highlight"),
            _c("compensation__salary"),
            _c("incareer-job-top-card__salary"),
        ),
        body=(
            _c("jobs-description-content__text"),
            _c("jobs-description__content"),
            Sel(id="job-details"),
            _c("jobs-box__html-content"),
            _c("incareer-job-description__content"),
            _c("job-description-content"),
        ),
        fallback=(Sel(tag="main"), _c("scaffold-layout__detail")),
    ),
    "Indeed": Rules(
        title=(
            Sel(tag="h1", cls=("jobsearch-JobInfoHeader-title",)),
            _testid("jobsearch-JobInfoHeader-title"),
            Sel(tag="h1"),
        ),
        company=(
            _testid("inlineHeader-companyName"),
            Sel(tag="a", inside=_c("jobsearch-InlineCompanyRating-companyHeader")),
            _c("css-hon9z8"),
        ),
        location=(
            _testid("job-location"),
            Sel(tag="div", last_child_of=_c("jobsearch-JobInfoHeader-subtitle")),
            _c("css-6z8o9s"),
        ),
        salary=(
            _testid("attribute_snippet_testid"),
            Sel(id="salaryInfoAndJobType"),
            _c("css-19j1a75"),
        ),
        body=(
            Sel(id="jobDescriptionText"),
            _c("jobsearch-jobDescriptionText"),
            _testid("jobsearch-JobComponent-description"),
        ),
        fallback=(Sel(tag="main"), Sel(id="jobsearch-ViewjobPaneWrapper")),
    ),
    "Boss直聘": Rules(
        title=(_c("job-name"), _c("name", "job-name"), _c("position-name"), Sel(tag="h1")),
        company=(
            _c("company-name"),
            _c("name", "company-name"),
            Sel(cls=("name",), inside=_c("company-info")),
            Sel(tag="a", inside=_c("job-company")),
        ),
        location=(_c("location-address"), _c("job-location"), _c("job-area"), _c("location")),
        salary=(_c("salary"), _c("job-salary"), Sel(part=("class", "salary"))),
        tags=(_c("job-tags"), _c("tag-list"), _c("job-condition")),
        body=(
            Sel(cls=("job-sec-text",), inside=_c("job-detail-section")),
            _c("job-sec-text"),
            _c("detail-content"),
            _c("job-detail-info"),
            Sel(cls=("text",), inside=_c("job-box")),
        ),
        fallback=(_c("job-detail-box"), _c("job-primary-detail"), Sel(tag="main"), Sel(id="main")),
    ),
}


def _labelled(label: str, text: Column) -> Column:
    """Null where there is no text, so that the line is left out."""
    return F.concat(F.lit(label), text)


def _assemble(texts: Column, rules: Rules) -> Column:
    lines, at = [], 0
    for label, selectors in rules.fields:
        found = [filled(texts[at + i]) for i in range(len(selectors))]
        lines.append(_labelled(label, F.coalesce(*found) if found else F.lit(None).cast("string")))
        at += len(selectors)
    tags, body, fallback = texts[at], texts[at + 1], texts[at + 2]
    lines.append(_labelled("Tags: ", tags))
    lines.append(
        F.coalesce(
            _labelled(BLANK_LINE_LABELS["body"], body),
            _labelled(BLANK_LINE_LABELS["fallback"], fallback),
        )
    )
    return F.concat_ws("\n", *lines)


def extract_detail_text(
    pages: DataFrame,
    rules: dict[str, Rules] = DETAIL_RULES,
    html: str = "html",
    platform: str = "platform",
) -> DataFrame:
    """Detail pages with ``text``: labelled lines, empty parts left out; ``parse_failed`` marks pages that broke the parser."""
    picks = {name: r.picks for name, r in rules.items()}
    found = pages.withColumn("_found", element_texts(F.col(html), F.col(platform), picks)).drop(html)
    text = F.lit("")
    for name, r in rules.items():
        text = F.when(F.col(platform) == name, _assemble(F.col("_found.texts"), r)).otherwise(text)
    return found.withColumns({"text": text, "parse_failed": F.col("_found.failed")}).drop("_found")
