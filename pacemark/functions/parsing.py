"""Keys, delimited lists, repository names and estimates given as free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacemark.functions.text import strip


def join_list(items: Column) -> Column:
    """A list as ``a|b|c``."""
    return F.array_join(items, "|")


def split_list(text: Column, keep_blank: bool = False) -> Column:
    """``a|b|c`` as a list; null and '' give an empty list, blanks go unless kept."""
    parts = F.split(text, "[|]")
    if not keep_blank:
        parts = F.filter(parts, lambda x: x != "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(parts)


def comma_list(text: Column) -> Column:
    """``a, b,,c`` as a list of the trimmed parts that are not blank."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def encoder_slug(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def item_key(repo: Column, issue_number: Column) -> Column:
    return F.concat(repo, F.lit("#"), issue_number.cast("string"))


def full_name(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("/"), name)


def owner_and_name(url: Column, host: str = "github.com") -> Column:
    """``owner`` and ``name`` from a link or a slug, null when there are not two parts."""
    tidy = F.regexp_replace(strip(url), "/+$", "")
    path = F.when(tidy.contains(host), F.substring_index(tidy, f"{host}/", -1)).otherwise(tidy)
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.struct(
        parts[0].alias("owner"), F.replace(parts[1], F.lit(".git"), F.lit("")).alias("name")))


def stated_estimate(answer: Column, hours_key: str = "hours", reason_key: str = "reasoning") -> Column:
    """Hours and reasoning from the first ``{...}`` of an answer.

    No block, broken JSON and hours that are no number all give null hours;
    a block without hours means 0.
    """
    block = F.regexp_extract(answer, r"(\{[^}]+\})", 1)
    parsed = F.try_parse_json(F.when(block != "", block))
    stated = F.try_variant_get(parsed, f"$.{hours_key}", "variant")
    hours = (F.when(parsed.isNull(), F.lit(None).cast("double"))
             .when(stated.isNull(), F.lit(0.0))
             .otherwise(F.try_variant_get(parsed, f"$.{hours_key}", "double")))
    reason = F.coalesce(F.try_variant_get(parsed, f"$.{reason_key}", "string"), F.lit(""))
    return F.struct(hours.alias("hours"), F.when(parsed.isNotNull(), reason).alias("reasoning"))


def prompt_parts(title: Column, body: Column, body_limit: int = 2000, title_limit: int = 100) -> Column:
    """The short texts an external estimator is given and a report lists."""
    return F.struct(
        F.substring(F.coalesce(title, F.lit("")), 1, title_limit).alias("title"),
        F.substring(F.coalesce(body, F.lit("")), 1, body_limit).alias("body"))
