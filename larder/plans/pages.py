"""Page queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed, text
from larder.operators import pages as p
from larder.operators.shaping import spread
from larder.plans import sql
from larder.session import table

NOW = "2024-06-01 00:00:00"


def url_normalise(spark, d):
    pages = table(spark, d, "pages", ["page_id", "url"])
    ported = F.concat(
        F.lit(" "), F.regexp_replace("url", r"^(https?)://([^/]+)", "$1://WWW.$2:80"), F.lit(" ")
    )
    return pages.select(
        "page_id",
        text.normalise_url("url").alias("clean"),
        text.normalise_url(ported).alias("ported"),
        text.normalise_url(F.concat(F.lit("no url? "), "url")).alias("unparsed"),
        text.url_host("url").alias("host"),
        text.short_url("url").alias("label"),
    )


def _links(spark, d):
    return p.page_links(spread(table(spark, d, "pages", ["url", "html"])))


def page_links(spark, d):
    return _links(spark, d)


def page_frontier(spark, d):
    seen = table(spark, d, "pages", ["url"]).select(
        F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+", 0), F.lit("/the")).alias("url")
    )
    return p.frontier(_links(spark, d), seen)


def page_blocked(spark, d):
    """Every page as it is, and with a refusal put into its title or body by its own address."""
    pages = table(spark, d, "pages", ["page_id", "url", "html"])
    changed = (
        F.when(F.col("url").startswith("http://"),
               F.regexp_replace("html", "<title>", "<title>Just a moment... "))
        .when(F.col("url").contains("utm_source"),
              F.regexp_replace("html", "<h1>", "<h1>Access <b>Denied</b> "))
        .when(F.col("url").contains("?page"),
              F.regexp_replace("html", "<h1>", "<h1><!-- Access Denied -->Access granted "))
        .otherwise(F.col("html"))
    )
    status = F.when(F.col("url").contains("#top"), 429).otherwise(200)
    return pages.select(
        "page_id",
        p.is_blocked(F.col("html")).alias("blocked"),
        p.is_blocked(changed, status).alias("blocked_changed"),
    )


def page_dom_fields(spark, d):
    pages = spread(table(spark, d, "pages", ["page_id", "html"]))
    chosen = {
        "name": ["h1"], "description": ["title"], "ingredients": ["nav li"],
        "instructions": [".ad"], "image": ["img"],
    }
    found = p.dom_fields(pages, "page_id", selectors=chosen)
    return found.select(
        "page_id", "name", "description", F.array_join("ingredients", "|").alias("items"),
        F.array_join("instructions", "|").alias("notes"), "image",
    )


def _pages(spark, d):
    return as_pages(
        spread(table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand", "p_size"]))
    )


def as_pages(part):
    """Recipe pages made of the parts, in every shape a page may have."""
    key = F.col("p_partkey").cast("string")
    name, brand = F.col("p_name"), F.col("p_brand")
    script = '<script type="application/ld+json">'

    def say(*bits):
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    common = say(
        '"name":"', name, '","description":"A part called ', name,
        '","recipeIngredient":["1 cup ', name, '","2 ', brand, '"],"recipeCategory":["x","', brand,
        '"],"recipeYield":', F.col("p_size").cast("string"),
    )
    url = say("https://img.example/", key, ".jpg")
    plain = say('{"@type":"Recipe",', common, ',"image":"', url, '","cookTime":"PT5M",',
                '"recipeInstructions":["Mix ', name, '","Bake"],"nutrition":{"calories":"5"}}')
    listed = say('[{"@type":"Recipe","name":"first ', name, '","image":"', url,
                 '","recipeIngredient":["x"],"recipeInstructions":"Stir"},{"@type":"Recipe",', common,
                 ',"image":{"contentUrl":"', url, '"},"recipeInstructions":[{"@type":"HowToStep",',
                 '"text":"Mix ', name, '"},{"@type":"HowToTip","text":"no"},"Bake"]}]')
    graph = say('{"@graph":[{"@type":"WebPage"},{"@type":["Thing","Recipe"],', common,
                ',"image":["', url, '","other"],"recipeInstructions":[{"@type":"HowToSection",',
                '"itemListElement":[{"@type":"HowToStep","text":"Mix ', name,
                '"},{"@type":"HowToStep","text":""}]},{"@type":"HowToStep","text":"Bake"}]}]}')
    bare = say('{"@type":"Recipe",', common, ',"image":{"url":"', url, '"},"recipeInstructions":[]}')
    classes = say('<h2 class="big wprm-recipe-name"> ', name, ' </h2><div class="entry-content"><p>Made of ',
                  brand, '</p><img class="i" src="', url, '"></div><ul><li class="ingredient">1 cup ',
                  name, '<li class="ingredient">2 ', brand,
                  '</ul><ol class="instructions"><li>Mix &amp; stir ', name, '</li><li>Bake</li></ol>')
    kind = F.col("p_type")
    body = (
        F.when(kind == "STANDARD", say(script, plain, "</script>"))
        .when(kind == "PROMO", say(script, listed, "</script>"))
        .when(kind == "MEDIUM", say(script, "{broken</script>", script, graph, "</script>"))
        .when(kind == "LARGE", classes)
        .when(kind == "ECONOMY", say(script, bare, "</script>", classes))
        .otherwise(say(script, '{"@type":"Recipe","name":"', name, '"}</script>'))
    )
    return part.select(
        say("https://Site.Example/r/", key, "/?q=1#top").alias("url"),
        F.when(F.col("p_size") == 50, 403).otherwise(200).alias("status"),
        say("<html><head><title>", name, "</title></head><body>", body, "</body></html>").alias("html"),
    )


def flat(rows):
    return rows.select(
        "url", "block", "place", "name", "image", "description", "cook_time", "recipe_yield",
        F.array_join("recipe_ingredients", "|").alias("ingredients"),
        F.array_join("recipe_instructions", "|").alias("instructions"),
        "recipe_category", "nutrition", "quality_score",
    )


def page_jsonld(spark, d):
    items = p.recipe_items(p.jsonld_blocks(_pages(spark, d)))
    rows = p.item_rows(items)
    return rows.select(
        "url", "block", "place", "name", "image", "recipe_yield",
        F.array_join("recipe_instructions", "|").alias("instructions"),
    )


def _extracted(spark, d):
    return p.extract(_pages(spark, d), F.lit(NOW).cast("timestamp_ntz"))


def page_extract(spark, d):
    return flat(_extracted(spark, d))


def page_stored(spark, d):
    good, _ = p.gate(_extracted(spark, d))
    return flat(p.last_per_url(good)).drop("block", "place")


def page_counts(spark, d):
    return p.found_per_url(p.gate(_extracted(spark, d))[0])


_LINKS_SQL = f"""
    h AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://[^/?#]+', 0)
        || trim(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS link FROM pages),
    l AS (SELECT DISTINCT url, regexp_replace(link, '#.*$', '') AS link,
        regexp_matches(link, '{fixed.RECIPE_LINK}') AS recipe_like FROM h
      WHERE NOT regexp_matches(link, '/(?:{"|".join(fixed.EXCLUDED_PATHS)})$')
        OR regexp_matches(link, '{fixed.RECIPE_LINK}'))"""

_UNESCAPED = "replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&amp;', '&')"

_PARTS_SQL = """
    s AS (SELECT 'https://site.example/r/' || p_partkey AS url, p_partkey, p_name AS name,
      p_brand, p_type, p_size, 'https://img.example/' || p_partkey || '.jpg' AS image,
      '1 cup ' || p_name || '|2 ' || p_brand AS ingredients,
      'Mix ' || p_name || '|Bake' AS told,
      'Mix & stir ' || p_name || '|Bake' AS dom FROM part WHERE p_size <> 50),
    x AS (
      SELECT url, CASE p_type WHEN 'MEDIUM' THEN 0 ELSE 0 END AS block,
        CASE p_type WHEN 'PROMO' THEN 1 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS place, name, image,
        CASE p_type WHEN 'LARGE' THEN 'Made of ' || p_brand ELSE 'A part called ' || name END
          AS description,
        CASE p_type WHEN 'STANDARD' THEN 'PT5M' END AS cook_time,
        CASE p_type WHEN 'LARGE' THEN NULL ELSE CAST(p_size AS VARCHAR) END AS recipe_yield,
        ingredients, CASE WHEN p_type IN ('LARGE', 'ECONOMY') THEN dom ELSE told END AS instructions,
        CASE p_type WHEN 'LARGE' THEN NULL ELSE 'x, ' || p_brand END AS recipe_category,
        CASE p_type WHEN 'STANDARD' THEN '{"calories":"5"}' END AS nutrition,
        CAST(90 + CASE p_type WHEN 'STANDARD' THEN 10 ELSE 0 END
          - CASE WHEN length(name) > 3 THEN 0 ELSE 10 END AS INTEGER) AS quality_score
      FROM s WHERE p_type <> 'SMALL'
      UNION ALL
      SELECT url, 0, 0, 'first ' || name, image, NULL, NULL, NULL, 'x', 'Stir', NULL, NULL, 80
      FROM s WHERE p_type = 'PROMO'
      UNION ALL
      SELECT url, 0, 0, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 10
      FROM s WHERE p_type = 'SMALL')"""

QUERIES = {
    "url_normalise": (
        url_normalise,
        f"""WITH s AS (SELECT page_id, url,
          ' ' || regexp_replace(url, '^(https?)://([^/]+)', '\\1://WWW.\\2:80') || ' ' AS ported
          FROM pages)
        SELECT page_id, {sql.normalised_url('url')} AS clean,
          {sql.normalised_url('ported')} AS ported, 'no url? ' || url AS unparsed,
          lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
          substr(regexp_replace(url, '^https?://(www\\.)?', ''), 1, 30) || '...' AS label FROM s""",
    ),
    "page_links": (page_links, f"WITH {_LINKS_SQL} SELECT url, link, recipe_like FROM l"),
    "page_frontier": (
        page_frontier,
        f"""WITH {_LINKS_SQL}
        SELECT link, bool_or(recipe_like) AS recipe_like FROM l
        WHERE link NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/the' FROM pages)
        GROUP BY link""",
    ),
    "page_blocked": (
        page_blocked,
        """SELECT page_id, false AS blocked,
          starts_with(url, 'http://') OR contains(url, 'utm_source') OR contains(url, '#top')
            AS blocked_changed FROM pages""",
    ),
    "page_dom_fields": (
        page_dom_fields,
        f"""SELECT page_id,
          {_UNESCAPED.format("trim(regexp_extract(html, '<h1>(.*?)</h1>', 1))")} AS name,
          {_UNESCAPED.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")} AS description,
          {_UNESCAPED.format(
              "array_to_string(list_transform(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a></li>', 1),"
              " lambda x: trim(x)), '|')")} AS items,
          {_UNESCAPED.format("trim(regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1))")} AS notes,
          CAST(NULL AS VARCHAR) AS image FROM pages""",
    ),
    "page_jsonld": (
        page_jsonld,
        """
        WITH s AS (SELECT 'https://Site.Example/r/' || p_partkey || '/?q=1#top' AS url,
          p_name AS name, p_type, 'https://img.example/' || p_partkey || '.jpg' AS image,
          CAST(p_size AS VARCHAR) AS y, 'Mix ' || p_name || '|Bake' AS told FROM part
          WHERE p_type <> 'LARGE')
        SELECT url, 0 AS block, CASE WHEN p_type IN ('PROMO', 'MEDIUM') THEN 1 ELSE 0 END AS place,
          name, CASE WHEN p_type <> 'SMALL' THEN image END AS image,
          CASE WHEN p_type <> 'SMALL' THEN y END AS recipe_yield,
          CASE p_type WHEN 'ECONOMY' THEN '' WHEN 'SMALL' THEN NULL ELSE told END AS instructions
        FROM s
        UNION ALL SELECT url, 0, 0, 'first ' || name, image, NULL, 'Stir' FROM s
        WHERE p_type = 'PROMO'""",
    ),
    "page_extract": (page_extract, f"WITH {_PARTS_SQL} SELECT * FROM x"),
    "page_stored": (
        page_stored,
        f"""WITH {_PARTS_SQL}
        SELECT url, name, image, description, cook_time, recipe_yield, ingredients, instructions,
          recipe_category, nutrition, quality_score
        FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY block DESC, place DESC) AS rn
          FROM x WHERE quality_score >= 60) WHERE rn = 1""",
    ),
    "page_counts": (
        page_counts,
        f"""WITH {_PARTS_SQL}
        SELECT url, count(*) AS recipes_found FROM x WHERE quality_score >= 60 GROUP BY url""",
    ),
}
