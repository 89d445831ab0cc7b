"""Recipe rows out of fetched pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed, variants
from larder.functions.scoring import quality_score
from larder.functions.text import normalise_url, truthy, url_host
from larder.operators.shaping import first_per, once

_JSONLD = (
    r'(?is)<script\b[^>]*\btype\s*=\s*["\']?application/ld\+json["\']?[^>]*>(.*?)</script\s*>'
)
_ANCHOR = r"""(?is)<a(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: The first attribute of that very name, its value in double, single or no quotes.
_HREF = (
    r"""(?is)^<a(?:[\s/]++(?!href[\s=/>])[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+"""
    r"""[\s/]++href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
)
_NUMERIC = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?"


# --- blocked pages ----------------------------------------------------------------


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)


def body_text(html: Column) -> Column:
    """Text of the body with comments and tags taken out."""
    body = F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>", "")
    return F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]*>", "")


def is_blocked(html: Column, status: Column | None = None) -> Column:
    """Refused by status, or an anti-bot page by its title or body."""
    # the title is only cut out, and the tags only removed, where the words occur at all
    out = F.when(
        html.contains(fixed.BLOCK_BODY.split()[-1]), body_text(html).contains(fixed.BLOCK_BODY)
    ).otherwise(F.lit(False))
    for phrase in fixed.BLOCK_TITLES:
        out = out | F.when(
            html.contains(phrase), page_title(html).contains(phrase)
        ).otherwise(F.lit(False))
    if status is not None:
        out = out | F.coalesce(status.isin(fixed.BLOCK_STATUSES), F.lit(False))
    return F.coalesce(out, F.lit(False))


# --- links --------------------------------------------------------------------------


def unescaped(c: Column) -> Column:
    """Numeric character references and the five of XML decoded, in the place where they stand."""

    def one(acc: Column, code: Column) -> Column:
        number = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).cast("bigint")
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        real = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")), F.when(real, sign).otherwise(F.lit("\ufffd")))

    # an ampersand is decoded last, so that nothing is decoded twice; "&#38;" is one of its spellings
    out = F.regexp_replace(c, r"(?i)&#(?:0*38|x0*26);", "&amp;")
    out = F.aggregate(F.array_distinct(F.regexp_extract_all(out, F.lit(_NUMERIC), 1)), out, one)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.when(c.contains("&"), out).otherwise(c)


def hrefs(html: Column) -> Column:
    """The addresses of all anchors outside comments, in order, decoded and without blanks around."""
    seen = F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")).otherwise(html)

    def href(tag: Column) -> Column:
        return F.concat(*(F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)))

    return F.transform(
        F.regexp_extract_all(seen, F.lit(_ANCHOR), 0), lambda tag: F.btrim(unescaped(href(tag)), F.lit(" \t\n\r\f"))
    )


def _without_dots(path: Column) -> Column:
    """A path that begins with `/`, its `.` and `..` parts folded."""
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)
    last = F.element_at(parts, -1)

    def fold(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), fold)
    # a path that ends in a dot part names a folder
    whole = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(path)


def resolved(url: Column, href: Column) -> Column:
    """The absolute http address that a reference on a page of address `url` stands for, without its
    fragment. Null for other schemes, for a fragment of the same page, and for an empty reference."""

    def part(c: Column, group: int) -> Column:
        return F.regexp_extract(c, _PARTS, group)

    bare = F.regexp_replace(href, "(?s)#.*$", "")
    query, path = F.regexp_extract(bare, r"(?s)\?.*$", 0), F.regexp_replace(bare, r"(?s)\?.*$", "")
    origin = F.concat(part(url, 1), F.lit("//"), part(url, 2))
    here = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    folder = F.regexp_replace(here, r"[^/]*$", "")
    given = F.when(bare.startswith("//"), F.concat(part(url, 1), bare)).otherwise(bare)
    given_path = part(given, 3)
    return (
        F.when(bare == "", F.lit(None))
        .when(bare.startswith("//") | bare.rlike(r"(?i)^https?://"), F.concat(
            part(given, 1), F.lit("//"), part(given, 2),
            F.when(given_path == "", given_path).otherwise(_without_dots(given_path)), part(given, 4)))
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(path == "", F.concat(origin, here, query))
        .when(path.startswith("/"), F.concat(origin, _without_dots(path), query))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query))
    )


def _hostname(c: Column | str) -> Column:
    return F.regexp_replace(url_host(c), r":[0-9]*$", "")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page url, link) for every same-host link worth following, distinct per page; ports do not count.

    Site pages such as /about are left out unless they look like a recipe; `recipe_like` marks
    the targeted ones.
    """
    links = (
        pages.select(url, F.explode(F.array_distinct(hrefs(F.col(html)))).alias("href"))
        .withColumn("link", resolved(F.col(url), F.col("href")))
        .filter(F.col("link").isNotNull() & (_hostname("link") == _hostname(url)))
    )
    site_page = F.col("link").rlike("/(?:" + "|".join(fixed.EXCLUDED_PATHS) + ")$")
    recipe_like = F.col("link").rlike(fixed.RECIPE_LINK)
    return (
        links.withColumn("recipe_like", recipe_like)
        .filter(~site_page | F.col("recipe_like"))
        .select(url, "link", "recipe_like")
        .distinct()
    )


def frontier(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct links not seen yet. `seen` has a column `url`."""
    fresh = links.groupBy("link").agg(F.max("recipe_like").alias("recipe_like"))
    return fresh.join(seen.select(F.col("url").alias("link")), "link", "left_anti")


# --- fields by CSS class ----------------------------------------------------------

# how HTML leaves out end tags (the parts of the standard that matter to the text of an element)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
         "track", "wbr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer",
           "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p",
           "pre", "section", "table", "ul"}
_HOLDS_P = {"button", "caption", "object", "table", "td", "th"}
_HOLDS_LI = {"article", "blockquote", "ol", "section", "table", "td", "th", "ul"}
_INLINE = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u"}


class _Fields(HTMLParser):
    """Text of the elements named by simple selectors: `tag`, `.class`, `tag.class`, `A B`."""

    def __init__(self, selectors: dict[str, list[str]]):
        super().__init__(convert_charrefs=True)
        self.selectors = {f: [s.split() for s in found] for f, found in selectors.items()}
        self.open: list[tuple[str, set[str], list[list[str]]]] = []
        self.texts: dict[str, list[list[str]]] = {f: [] for f in selectors}
        self.images: list[str | None] = []

    @staticmethod
    def _meets(step: str, tag: str, classes: set[str]) -> bool:
        name, _, css = step.partition(".")
        return (not name or name == tag) and (not css or css in classes)

    def _selected(self, steps: list[str], tag: str, classes: set[str]) -> bool:
        if not self._meets(steps[-1], tag, classes):
            return False
        return len(steps) == 1 or any(self._meets(steps[0], t, c) for t, c, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._close("p", _HOLDS_P)
        if tag == "li":
            self._close("li", _HOLDS_LI)
        known = dict(attrs)
        classes = set((known.get("class") or "").split())
        sinks = []
        for field, selectors in self.selectors.items():
            if any(self._selected(s, tag, classes) for s in selectors):
                if field == "image":
                    self.images.append(known.get("src"))
                else:
                    self.texts[field].append([])
                    sinks.append(self.texts[field][-1])
        if tag not in _VOID:
            self.open.append((tag, classes, sinks))

    def _close(self, tag: str, holders: set[str] = frozenset()) -> None:
        """End the innermost such element and all inside it, looking no further than a holder."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                if tag in _INLINE:  # blocks begun inside it go on
                    del self.open[i]
                else:
                    del self.open[i:]
                return
            if name in holders:
                return

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        for _, _, sinks in self.open:
            for sink in sinks:
                sink.append(data)


def _fields_of(html: str | None, selectors: dict[str, list[str]]) -> dict:
    parser = _Fields(selectors)
    parser.feed(html or "")
    parser.close()
    out: dict = {}
    for field, found in parser.texts.items():
        cut = ["".join(pieces).strip() for pieces in found]
        if field in ("name", "description"):
            out[field] = (cut[0] or None) if cut else None
        else:
            out[field] = [c for c in cut if c]
    out["image"] = (parser.images[0] or None) if parser.images else None
    return out


DOM_SELECTORS = {
    "name": fixed.DOM_NAME,
    "description": fixed.DOM_DESCRIPTION,
    "ingredients": fixed.DOM_INGREDIENTS,
    "instructions": fixed.DOM_INSTRUCTIONS,
    "image": fixed.DOM_IMAGE,
}


def dom_fields(
    pages: DataFrame, key: str = "url", html: str = "html",
    selectors: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Fields read by CSS class, one row per page. A page is parsed inside one Arrow batch row, so
    the work spreads over the scan's partitions without a shuffle."""
    chosen = selectors or DOM_SELECTORS

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame(
                [_fields_of(h, chosen) for h in batch[html]],
                columns=["name", "description", "ingredients", "instructions", "image"],
            )
            found.insert(0, key, batch[key].to_numpy())
            yield found

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(
        read,
        f"{key} {kind}, name string, description string, ingredients array<string>, "
        "instructions array<string>, image string",
    )


# --- JSON-LD -----------------------------------------------------------------------


def _marked(html: Column) -> Column:
    """Texts of the well-formed JSON-LD scripts of a page."""
    found = F.when(html.contains("ld+json"), F.regexp_extract_all(html, F.lit(_JSONLD), 1))
    return F.coalesce(
        F.filter(found, lambda j: F.try_parse_json(j).isNotNull()),
        F.array().cast("array<string>"),
    )


def _members(data: Column) -> Column:
    """Members of a list, of `@graph`, or the object itself."""
    return F.coalesce(variants.items(data), variants.items(data, '$["@graph"]'), F.array(data))


def _is_recipe(item: Column) -> Column:
    kinds = F.coalesce(
        F.try_variant_get(item, '$["@type"]', "array<string>"),
        F.array(variants.text(item, '$["@type"]')),
    )
    return F.coalesce(F.array_contains(kinds, "Recipe"), F.lit(False))


def _told(item: Column) -> Column:
    """The item has instructions of its own."""
    given = variants.node(item, "$.recipeInstructions")
    return F.coalesce(
        (variants.text(given) != "") & (F.coalesce(F.size(variants.items(given)), F.lit(1)) != 0),
        F.lit(False),
    )


def jsonld_blocks(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, block no, parsed JSON) of every well-formed JSON-LD script."""
    return (
        pages.filter(F.col(html).contains("ld+json"))
        .select(key, F.posexplode(_marked(F.col(html))).alias("block", "json"))
        .select(key, "block", F.try_parse_json("json").alias("data"))
    )


def recipe_items(blocks: DataFrame, key: str = "url") -> DataFrame:
    """(key, block, place, item) of the items of type Recipe."""
    return blocks.select(
        key, "block", F.posexplode(_members(F.col("data"))).alias("place", "item")
    ).filter(_is_recipe(F.col("item")))


def item_rows(
    items: DataFrame, key: str = "url", also: list[str] | None = None
) -> DataFrame:
    """Recipe columns of JSON-LD items; `also` names further columns to keep."""
    item = F.col("item")

    def text(path: str) -> Column:
        return variants.text(item, path)

    ingredients = variants.items(item, "$.recipeIngredient")
    return items.select(
        key, "block", "place", *(also or []),
        text("$.name").alias("name"),
        variants.image_url(variants.node(item, "$.image")).alias("image"),
        text("$.description").alias("description"),
        text("$.cookTime").alias("cook_time"),
        text("$.prepTime").alias("prep_time"),
        text("$.totalTime").alias("total_time"),
        variants.non_empty(variants.joined(variants.node(item, "$.recipeYield"), ","))
        .alias("recipe_yield"),
        F.transform(ingredients, lambda x: variants.text(x)).alias("recipe_ingredients"),
        variants.instruction_list(variants.node(item, "$.recipeInstructions"))
        .alias("recipe_instructions"),
        variants.joined(variants.node(item, "$.recipeCategory")).alias("recipe_category"),
        variants.joined(variants.node(item, "$.recipeCuisine")).alias("recipe_cuisine"),
        text("$.nutrition").alias("nutrition"),
    )


_RECIPE = [
    "name", "image", "description", "cook_time", "prep_time", "total_time", "recipe_yield",
    "recipe_ingredients", "recipe_instructions", "recipe_category", "recipe_cuisine", "nutrition",
]


def _with_dom(pages: DataFrame) -> DataFrame:
    """Pages `(page_url, blocks, html)` with the fields read by CSS class where `html` is given."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {"name": None, "description": None, "ingredients": [], "instructions": [],
                 "image": None}
        for batch in batches:
            found = pd.DataFrame(
                [empty if h is None else _fields_of(h, DOM_SELECTORS) for h in batch["html"]],
                columns=list(empty),
            )
            yield pd.concat([batch[["page_url", "blocks"]].reset_index(drop=True), found], axis=1)

    return pages.select("page_url", "blocks", "html").mapInPandas(
        read,
        "page_url string, blocks string, name string, description string, "
        "ingredients array<string>, instructions array<string>, image string",
    )


def extract(pages: DataFrame, now: Column) -> DataFrame:
    """Recipe rows of `pages(url, status, html)` with their score, before the gate.

    JSON-LD first. Pages without any fall back to their CSS classes, and items without
    instructions take those of the page. The pages are scanned once: only JSON-LD and the HTML of
    pages that need their classes read go to Python, everything else stays in the JVM.
    """
    readable = pages.filter(~is_blocked(F.col("html"), F.col("status")))
    marked = once(
        readable.select(F.col("url").alias("page_url"), "html"), "marked", _marked(F.col("html"))
    )
    lacking = F.exists(
        "marked",
        lambda j: F.exists(
            _members(F.try_parse_json(j)), lambda i: _is_recipe(i) & ~_told(i)
        ),
    )
    needed = (F.size("marked") == 0) | lacking
    read = _with_dom(
        marked.select(
            "page_url",
            F.concat(F.lit("["), F.array_join("marked", ","), F.lit("]")).alias("blocks"),
            F.when(needed, F.col("html")).alias("html"),
        )
    )
    # a page described by its classes becomes an item like any other
    described = F.col("name").isNotNull() & (
        (F.size("ingredients") > 0) | (F.size("instructions") > 0)
    )
    own = F.to_variant_object(
        F.struct(
            F.lit("Recipe").alias("@type"), "name", "description", "image",
            F.col("ingredients").alias("recipeIngredient"),
            F.col("instructions").alias("recipeInstructions"),
        )
    )
    blocks = variants.items(F.try_parse_json("blocks"))
    given = F.when(F.col("blocks") != "[]", blocks).when(described, F.array(own))
    items = (
        read.select("page_url", "instructions", F.posexplode(given).alias("block", "data"))
        .select(
            "page_url", F.col("instructions").alias("dom"), "block",
            F.posexplode(_members(F.col("data"))).alias("place", "item"),
        )
        .filter(_is_recipe(F.col("item")))
    )
    rows = item_rows(items.withColumn("told", _told(F.col("item"))), "page_url", ["dom", "told"])
    rows = rows.withColumn(
        "recipe_instructions",
        F.when(~F.col("told") & (F.size("dom") > 0), F.col("dom"))
        .otherwise(F.col("recipe_instructions")),
    )
    score = quality_score(
        *[F.col(c) for c in ("name", "description", "image", "recipe_ingredients",
                             "recipe_instructions", "cook_time", "prep_time")],
        truthy("nutrition"),
    )
    return rows.select(
        normalise_url("page_url").alias("url"), "block", "place", *_RECIPE,
        now.alias("updated_at"), F.lit("pending").alias("qa_status"),
        score.alias("quality_score"),
    )


def gate(rows: DataFrame, at: int = fixed.GATE_SCORE) -> tuple[DataFrame, DataFrame]:
    """(rows good enough to store, rows turned away). A row without a name cannot be stored."""
    good = F.coalesce(F.col("quality_score") >= at, F.lit(False)) & F.col("name").isNotNull()
    return rows.filter(good), rows.filter(~good)


def last_per_url(rows: DataFrame) -> DataFrame:
    """Recipes of one page share its url; the last one on the page is stored."""
    return first_per(rows, ["url"], [F.desc("block"), F.desc("place")])


def found_per_url(rows: DataFrame) -> DataFrame:
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("recipes_found"))
