"""JSON-LD documents as compact JSON text. A null field is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _typed(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *[v.alias(k) for k, v in fields.items()])


def _link(url: Column) -> Column:
    return F.struct(url.alias("@id"))


def article_ld(
    *, page: Column, title: Column, description: Column, published: Column, words: Column, section: Column,
    keywords: Column, author: Column, image: Column, url: Column, site_url: str, site_name: str,
) -> Column:
    """NewsArticle with author, publisher, page, image and the parts meant to be read aloud."""
    publisher = F.struct(
        F.lit("Organization").alias("@type"),
        F.lit(f"{site_url}/#organization").alias("@id"),
        F.lit(site_name).alias("name"),
        _typed("ImageObject", url=F.lit(f"{site_url}/logo.png")).alias("logo"),
    )
    read_aloud = F.array(F.lit(".article-title"), F.lit(".article-body p:first-of-type"))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("NewsArticle").alias("@type"),
        page.alias("@id"),
        title.alias("headline"),
        description.alias("description"),
        published.alias("datePublished"),
        published.alias("dateModified"),
        words.alias("wordCount"),
        section.alias("articleSection"),
        keywords.alias("keywords"),
        F.lit(True).alias("isAccessibleForFree"),
        _typed("Person", name=author).alias("author"),
        publisher.alias("publisher"),
        F.struct(F.lit("WebPage").alias("@type"), page.alias("@id")).alias("mainEntityOfPage"),
        _typed("ImageObject", url=image, width=F.lit(1200), height=F.lit(630)).alias("image"),
        _typed("SpeakableSpecification", cssSelector=read_aloud).alias("speakable"),
        url.alias("url"),
    ))


def breadcrumb_ld(names: list[Column], paths: list[Column], site_url: str) -> Column:
    """BreadcrumbList; positions start at 1 and an entry without path has no link."""
    trail = F.arrays_zip(F.array(*names).alias("name"), F.array(*paths).alias("path"))
    items = F.transform(trail, lambda entry, i: F.struct(
        F.lit("ListItem").alias("@type"),
        (i + 1).alias("position"),
        entry["name"].alias("name"),
        F.concat(F.lit(site_url), F.nullif(entry["path"], F.lit(""))).alias("item"),
    ))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("BreadcrumbList").alias("@type"),
        items.alias("itemListElement"),
    ))


def collection_ld(label: Column, path: Column, parts: Column, site_url: str, described: Column) -> Column:
    """CollectionPage; `parts` is an array of `(path, headline)`."""
    page = F.concat(F.lit(site_url), path)
    listed = F.transform(parts, lambda part: F.struct(
        F.lit("NewsArticle").alias("@type"),
        F.concat(F.lit(site_url), part["path"]).alias("@id"),
        part["headline"].alias("headline"),
        F.concat(F.lit(site_url), part["path"]).alias("url"),
    ))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("CollectionPage").alias("@type"),
        page.alias("@id"),
        label.alias("name"),
        page.alias("url"),
        described.alias("description"),
        _link(F.lit(f"{site_url}/#organization")).alias("publisher"),
        listed.alias("hasPart"),
    ))
