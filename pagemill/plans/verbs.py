"""What a user asks of pages in one call: what repeats on them, a table of chosen columns, a recipe that fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import extract, jobs, naming, structure
from pagemill.plans import recipe as recipes

LISTED = 4  # declared types that a look lists


def inspect(pages: DataFrame, keep_table, key: str = "page_id") -> DataFrame:
    """(key, title, container, count, columns, declared) of each page: its best container with its columns (index, name,
    path, kind, fill_rate, samples), and the types it declares. A page without repeats has none: count 0, no columns."""
    best = structure.containers(pages, keep_table, key).where("place = 1")
    told = best.select(key, F.col("selector").alias("container"), "count", "columns", naming.names(F.col("columns")).alias("names"))
    row = lambda c, i: F.struct(
        i.alias("index"), F.element_at("names", (i + 1).cast("int")).alias("name"), c["path"].alias("path"), c["kind"].alias("kind"), c["fill_rate"].alias("fill_rate"), c["samples"].alias("samples")
    )
    told = told.withColumn("columns", F.transform("columns", row)).drop("names")
    parts = extract.extract(pages.select(key, "html"), ["title", "jsonld", "microdata"])
    types = F.array_distinct(F.flatten(F.transform(F.concat("jsonld", "microdata"), lambda e: F.split(F.regexp_replace(F.coalesce(F.get_json_object(e, "$['@type']"), F.lit("")), r'[\[\]"]', ""), ","))))
    seen = parts.select(key, "title", F.slice(F.filter(types, lambda t: t != ""), 1, LISTED).alias("declared"))
    out = seen.join(told, key, "left")
    none = F.array().cast(told.schema["columns"].dataType)
    return out.select(key, "title", "container", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("columns", none).alias("columns"), "declared")


def check_names(picks: list[tuple[str, str, str]]) -> None:
    """An error if there are no picks, or two of one name: the second column would overwrite the first."""
    names = [n for n, *_ in picks]
    if not names:
        raise ValueError("no columns picked")
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"names repeat: {', '.join(again)}")


def picked_recipe(name: str, container: str, picks: list[tuple[str, str, str]]) -> recipes.Recipe:
    """A recipe of picks (name, path, kind); picks of a blank name are dropped."""
    picks = [(n.strip(), p, k) for n, p, k in picks if n and n.strip()]
    check_names(picks)
    absolute = {"href": ("to_absolute_url",), "src": ("to_absolute_url",)}
    return recipes.Recipe(name, container=container, fields=tuple(recipes.Field(n, p, k, transform=absolute.get(k, ())) for n, p, k in picks))


def collect(pages: DataFrame, container: str, picks: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, one column a pick) of all pages: picks are (name, path, kind) of the columns of a look."""
    return recipes.run(picked_recipe("collect", container, picks), pages, key, url)


def adapt(page: DataFrame, keep_table, name: str = "adapted", candidates: int = structure.TOP, key: str = "page_id") -> tuple[recipes.Recipe | None, DataFrame | None]:
    """The recipe that fits one page best, and its quality: each of its containers becomes a recipe, columns named by
    their markup, is run on the page and measured, and the best score stays; of equals the better container. (None, None)
    for a page without repeats. ``page`` has one row."""
    found = structure.containers(page, keep_table, key, limit=candidates)
    rows = found.orderBy("place").select("selector", naming.picked(F.col("columns"), naming.names(F.col("columns"))).alias("picks")).collect()  # ``candidates`` at most
    made = [picked_recipe(name, r.selector, [(p.name, p.path, p.kind) for p in r.picks]) for r in rows]
    if not made:
        return None, None
    scores = [recipes.measure(r, page).withColumn("recipe", F.lit(i)) for i, r in enumerate(made)]
    measured = keep_table(reduce(DataFrame.unionByName, scores))
    best = jobs.best_recipes(measured.withColumn("page", F.lit(0)), "page").first().recipe
    return made[best], measured.where(F.col("recipe") == best).drop("recipe")
