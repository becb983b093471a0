"""Declarative recipes, and the DataFrame pipelines they compile to."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import paths, values
from pagemill.operators import extract, filters, nodes, quality
from pagemill.sources import web

SOURCES = ["css", "jsonld", "microdata", "embedded", "feed", "table", "article"]
SHAPES = {"feed": ["title", "url", "published_at", "summary", "author"], "article": ["title", "text", "word_count"]}


@dataclass(frozen=True)
class Field:
    name: str
    selector: str = ""
    type: str = "text"
    attr: str | None = None
    transform: tuple[str, ...] = ()
    required: bool = False

    def __post_init__(self):
        if not 1 <= len(self.name) <= 64:
            raise ValueError("a field's name has 1 to 64 characters")
        if self.type not in ("text", "html", "href", "src", "attr"):
            raise ValueError(f"unknown type {self.type!r}")
        values.check(list(self.transform))


@dataclass(frozen=True)
class Recipe:
    name: str
    source: str = "css"
    container: str | None = None
    fields: tuple[Field, ...] = ()
    filters: tuple[filters.RecordFilter, ...] = ()
    version: int = 1
    status: str = "draft"
    allowed_domains: tuple[str, ...] = field(default=())

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if self.source not in SOURCES:
            raise ValueError(f"unknown source {self.source!r}")
        if len(set(names)) != len(names):
            raise ValueError("field names repeat")
        for f in self.filters:
            if f.field not in names:
                raise ValueError(f"filter on unknown field {f.field!r}")

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]


def from_dict(data: dict, name: str) -> Recipe:
    made = [Field(**{**f, "transform": tuple(f.get("transform") or ())}) for f in data.get("fields") or ()]
    rules = [filters.RecordFilter(**f) for f in data.get("filters") or ()]
    known = {k: data[k] for k in ("source", "container", "version", "status") if data.get(k) is not None}
    return Recipe(data.get("name") or name, fields=tuple(made), filters=tuple(rules), allowed_domains=tuple(data.get("allowed_domains") or ()), **known)


def load(path: str) -> Recipe:
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text()) or {}, Path(path).stem)


def load_all(folder: str) -> tuple[dict[str, Recipe], dict[str, str]]:
    """Recipes of a folder's YAML files by name, and what went wrong with others by file."""
    good, bad = {}, {}
    for p in sorted(Path(folder).glob("*.yaml")):
        if not p.name.startswith("_"):
            try:
                r = load(str(p))
                good[r.name] = r
            except Exception as e:
                bad[p.name] = str(e)
    return good, bad


def save(recipe: Recipe, path: str) -> None:
    """Writes what differs from the defaults."""
    import yaml

    plain = lambda x: {k: list(v) if isinstance(v, tuple) else v for k, v in x.items() if v not in (None, "", (), [], False)}
    data = plain(asdict(recipe)) | {"fields": [plain(asdict(f)) for f in recipe.fields], "filters": [plain(asdict(f)) for f in recipe.filters]}
    Path(path).write_text(yaml.safe_dump({k: v for k, v in data.items() if v}, sort_keys=False, allow_unicode=True))


def parse_field(text: str) -> Field:
    """``name=selector::type|transform|transform``."""
    name, _, rest = text.partition("=")
    head, *steps = rest.split("|")
    selector, _, kind = head.partition("::")
    attr = kind[5:-1] if kind.startswith("attr(") else None
    return Field(name.strip(), selector.strip(), "attr" if attr else kind.strip() or "text", attr, tuple(s.strip() for s in steps))


def supported(recipe: Recipe, content_type: Column) -> Column:
    """Whether a recipe's extractor reads pages of a content type; feeds are read whatever they call themselves."""
    kind = F.lower(F.trim(F.coalesce(content_type, F.lit(""))))
    return F.lit(True) if recipe.source == "feed" else kind.startswith("text/html") | kind.endswith("+xml")


def records(recipe: Recipe, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, one column a field) of all records found, before required fields and filters. Where pages has a
    column content_type, those that the extractor does not read give none."""
    if "content_type" in pages.columns:
        pages = pages.where(supported(recipe, F.col("content_type")))
    fields = [{"name": f.name, "selector": f.selector, "type": f.type, "attr": f.attr, "transform": list(f.transform) or ["trim"]} for f in recipe.fields]
    if recipe.source == "css":
        return nodes.css_records(pages, recipe.container, fields, key, url)
    shown = lambda f, v: values.chain(v, list(f.transform), F.col(url)).alias(f.name)
    if recipe.source in SHAPES or recipe.source == "table":
        if recipe.source == "feed":
            rows = pages.select(key, url, F.explode(web.read_feed(F.col("html").cast("binary"), F.col(url))).alias("row")).where(F.col("row.error").isNull())
        elif recipe.source == "article":
            rows = nodes.articles(pages, [key, url]).select(key, url, F.struct("title", "text", "word_count").alias("row"))
        else:
            rows = extract.extract(pages.select(key, url, "html"), ["table"]).select(key, url, F.explode("table").alias("row"))
        own = recipe.fields or tuple(Field(n, n) for n in SHAPES.get(recipe.source, ()))
        return rows.select(key, url, *[shown(f, F.col("row")[f.selector or f.name].cast("string")) for f in own])
    if recipe.source == "embedded":
        script, _, path = (recipe.container or "").partition(".")
        rows = extract.extract(pages.select(key, url, "html"), ["embedded"]).withColumn("data", F.col("embedded")[script])
        rows = rows.withColumn("data", F.get_json_object("data", "$" + "".join(f"['{p}']" for p in path.split(".") if p)))
        rows = rows.where(F.col("data").isNotNull())
        many = F.when(F.col("data").startswith("["), F.from_json("data", "array<string>")).otherwise(F.array("data"))
        rows = rows.select(key, url, F.explode(many).alias("row"))
    else:
        rows = extract.extract(pages.select(key, url, "html"), [recipe.source]).select(key, url, F.explode(recipe.source).alias("row"))
        if recipe.container:
            kind = F.lower(F.get_json_object("row", "$['@type']"))
            rows = rows.where(kind.rlike(r'(^|[/"])' + recipe.container.lower() + r'("|$)'))
    out = rows.select(key, url, *[shown(f, paths.json_path(F.col("row"), f.selector or f.name)) for f in recipe.fields])
    there = F.lit(False)
    for f in recipe.fields:
        there = there | (F.coalesce(F.col(f.name).cast("string"), F.lit("")) != "")
    return out.where(there)


def run(recipe: Recipe, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """A recipe's records, after required fields and filters."""
    return filters.keep(records(recipe, pages, key, url), list(recipe.filters), recipe.required)


def measure(recipe: Recipe, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row of a recipe's quality on some pages."""
    found = records(recipe, pages, key, url)
    return quality.measure(found, filters.keep(found, list(recipe.filters), recipe.required), [f.name for f in recipe.fields])


def with_fallback(recipe: Recipe, pages: DataFrame, rendered: DataFrame, keep_table, key: str = "page_id", url: str = "url") -> DataFrame:
    """A recipe's records with via ("http" or "rendered"): pages that give none are read once more as rendered, where the
    second table has them. Only those pages of it are parsed. ``keep_table`` writes the first table's records."""
    first = keep_table(records(recipe, pages, key, url))
    bare = pages.select(key).join(first.select(key).distinct(), key, "left_anti")
    again = records(recipe, rendered.join(bare, key, "left_semi"), key, url)
    return first.withColumn("via", F.lit("http")).unionByName(again.withColumn("via", F.lit("rendered")))
