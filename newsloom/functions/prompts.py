"""Prompt columns for the summary and label stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label of an article that fits no category. It is always rejected.
OTHER = "Other"

# Defaults; callers may give templates of their own with the same slots.
SUMMARY_PROMPT = """\
Summarise the article below for a general reader in neutral words.
Give one bold sentence, then a section "### Key Points" of 3 to 6 bullets, then a section "### Why it Matters" of one bullet.
Use only facts of the article.

Article:
{text}
"""

LABEL_PROMPT = """\
Choose the label that fits the article best and answer with the label alone.
Labels:
{labels}
Title: {title}
Summary:
{summary}"""


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the template around the value columns, which appear in the given order."""
    pieces, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), F.coalesce(value, F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def label_set(categories: Sequence[str]) -> list[str]:
    return [*categories, OTHER]


def summary_prompt(text: Column, template: str = SUMMARY_PROMPT) -> Column:
    """The template with the article in place of {text}."""
    return _fill(template, {"text": text})


def label_prompt(title: Column, summary: Column, categories: Sequence[str], template: str = LABEL_PROMPT) -> Column:
    """The template with values in place of {labels}, {title} and {summary}, in this order."""
    labels = F.lit("\n".join(f"  {name}" for name in label_set(categories)))
    return _fill(template, {"labels": labels, "title": title, "summary": summary})
