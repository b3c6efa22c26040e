"""Weighted links: where a link stands on its page and how likely it is followed.

The links of a page stay one array in the page's row, in page order. Every
operator here works inside that row, so none of them shuffles.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from weblens.functions import dom
from weblens.functions.core import Sql, each, each_indexed, keep, let, uniform
from weblens.functions.selectors import Matcher
from weblens.functions.urls import normalize_in, split_base
from weblens.shipping import ship_package

_LINK_FACTS = pa.struct(
    [
        ("href", pa.string()),
        ("anchor_text", pa.string()),
        ("class", pa.string()),
        ("style", pa.string()),
        ("has_img", pa.bool_()),
        ("in_nav", pa.bool_()),
        ("in_footer", pa.bool_()),
        ("in_main", pa.bool_()),
        ("depth", pa.int32()),
    ]
)
_FACTS_DDL = (
    "array<struct<href string, anchor_text string, class string, style string, has_img boolean, "
    "in_nav boolean, in_footer boolean, in_main boolean, depth int>>"
)


def _marks(node: dom.Node) -> tuple[bool, bool, bool]:
    css = node.attributes.get("class", "").lower()
    ident = node.attributes.get("id", "").lower()
    return (
        node.tag == "nav" or "nav" in css or "nav" in ident,
        node.tag == "footer" or "footer" in css or "footer" in ident,
        node.tag in ("main", "article") or "main" in css or "content" in css,
    )


def _marks_around(link: dom.Link) -> tuple[bool, bool, bool]:
    """Whether any element of the chain has each mark; every link is looked at once per page."""
    chain = []
    while link is not None and link.marks is None:
        chain.append(link)
        link = link.up
    marks = link.marks if link is not None else (False, False, False)
    for inner in reversed(chain):
        inner.marks = marks = tuple(a or b for a, b in zip(marks, _marks(inner.node)))
    return marks


def _page_facts(page: str) -> list[dict]:
    """Position facts of every anchor with a non-empty href."""
    facts = []
    for node in dom.select(page, lambda n, _: n.tag == "a" and n.attributes.get("href")):
        in_nav, in_footer, in_main = _marks_around(node.around)
        facts.append(
            {
                "href": node.attributes["href"],
                "anchor_text": "".join(node.text).strip(),
                "class": node.attributes.get("class", "").lower(),
                "style": node.attributes.get("style", "").lower(),
                "has_img": node.has_img,
                "in_nav": in_nav,
                "in_footer": in_footer,
                "in_main": in_main,
                "depth": node.around.depth,
            }
        )
    return facts


def _scan(batches):
    for batch in batches:
        others = [n for n in batch.schema.names if n != "html"]
        facts, errors = [], []
        for page in batch.column("html"):
            try:
                facts.append(_page_facts(page.as_py() or ""))
                errors.append(None)
            except Exception as failure:  # one bad page must not fail the job
                facts.append(None)
                errors.append(f"{type(failure).__name__}: {failure}")
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in others),
                pa.array(facts, pa.list_(_LINK_FACTS)),
                pa.array(errors, pa.string()),
            ],
            names=[*others, "facts", "error"],
        )


def _weight(f: Sql) -> Sql:
    """Link weight, clamped to 0..1. The terms are added in a fixed order."""
    text = f"lower({f}.anchor_text)"
    words = " or ".join(f"contains({text}, '{w}')" for w in ("home", "about", "contact", "products"))
    css = " or ".join(f"contains({f}.class, '{w}')" for w in ("button", "btn", "cta"))
    total = f"""0.5D + if({f}.in_nav, 0.3D, 0D) + if({f}.in_main, 0.2D, 0D)
        - if({f}.in_footer, 0.3D, 0D) + if({f}.depth < 10, 0.2D, 0D) + if({css}, 0.2D, 0D)
        + if({f}.has_img, 0.1D, 0D)
        + if(octet_length({f}.anchor_text) > 3 and octet_length({f}.anchor_text) < 100, 0.1D, 0D)
        + if({words}, 0.15D, 0D)"""
    return clamp01(total)


def clamp01(x: Sql) -> Sql:
    return f"greatest(0D, least(1D, {x}))"


def bias_pow(weight: Sql, bias: float) -> Sql:
    """Weight sharpened by a click bias above 0."""
    if bias <= 0:
        raise ValueError("bias must be greater than 0")
    return f"pow({weight}, {1.0 / bias!r}D)"


def _visible(f: Sql) -> Sql:
    return (
        f"(not contains({f}.style, 'display:none') and not contains({f}.class, 'hidden') "
        f"and ({f}.anchor_text <> '' or {f}.has_img))"
    )


def weighted_links(pages: DataFrame, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Per page an array of links with weight, position and visibility, in page order.

    ``error`` tells of a page that could not be walked; its ``links`` are null, not empty. Only
    the tree walk runs in Python, on Arrow batches, and hands over raw facts; weights, flags and
    URL normalisation are Catalyst expressions.
    """
    ship_package()
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *keep_columns, "html")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    facts = given.mapInArrow(_scan, f"{kept}, facts {_FACTS_DDL}, error string")

    def link(f, pos, base):
        return f"""named_struct(
            'pos', {pos}, 'href', {f}.href, 'url', {normalize_in(f"{f}.href", base)},
            'anchor_text', {f}.anchor_text, 'weight', {_weight(f)},
            'position', named_struct('is_above_fold', {f}.depth < 10, 'in_nav', {f}.in_nav,
                'in_footer', {f}.in_footer, 'in_main', {f}.in_main, 'depth', {f}.depth),
            'in_navigation', {f}.in_nav, 'is_visible', {_visible(f)})"""

    links = let(split_base("url"), lambda b: each_indexed("facts", lambda f, i: link(f, i, b)))
    return facts.select("page_id", "url", *keep_columns, F.expr(links).alias("links"), "error")


def explode_links(weighted: DataFrame) -> DataFrame:
    """One row per link."""
    return weighted.select("page_id", F.inline("links"))


def visible_links(weighted: DataFrame) -> DataFrame:
    """Keep links that are visible and weigh more than 0.1."""
    kept = keep("links", lambda l: f"{l}.is_visible and {l}.weight > 0.1D")
    return weighted.withColumn("links", F.expr(kept))


def follow_link_sample(weighted: DataFrame, bias: float, seed: int = 0) -> DataFrame:
    """Keep each link with probability bias x weight; the same seed keeps the same links."""
    kept = keep(
        "links",
        lambda l: f"{uniform('page_id', f'{l}.pos', str(seed))} < {bias!r}D * {l}.weight",
    )
    return weighted.withColumn("links", F.expr(kept))


def link_stats(weighted: DataFrame) -> DataFrame:
    """Link counts and weights per page; a page without links has average 0, maximum 0, minimum 1.

    All figures of a page that could not be walked are null.
    """
    weights = each("links", lambda l: f"{l}.weight")
    total = f"aggregate({weights}, 0D, (a, w) -> a + w)"
    return weighted.selectExpr(
        "page_id",
        "cast(size(links) as bigint) as total_links",
        f"cast(size({keep('links', lambda l: f'{l}.is_visible')}) as bigint) as visible_links",
        f"cast(size({keep('links', lambda l: f'{l}.in_navigation')}) as bigint) as navigation_links",
        f"""cast(size({keep('links', lambda l: f'{l}.position.is_above_fold')}) as bigint)
            as above_fold_links""",
        f"if(links is null, null, if(size(links) > 0, {total} / size(links), 0D)) as avg_weight",
        f"if(links is null, null, greatest(0D, array_max({weights}))) as max_weight",
        f"if(links is null, null, least(1D, array_min({weights}))) as min_weight",
    )


def top_links(weighted: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest links per page, equal weights in page order; short lists stay as they are."""
    ranked = each(
        "links", lambda l: f"named_struct('w', -{l}.weight, 'p', {l}.pos, 'link', {l})"
    )
    best = each(f"slice(array_sort({ranked}), 1, {n})", lambda r: f"{r}.link")
    return weighted.withColumn("links", F.expr(f"if(size(links) <= {n}, links, {best})"))


def select_weighted_link(weighted: DataFrame, bias: float, seed: int = 0) -> DataFrame:
    """One link per page, drawn with probability proportional to weight^(1/bias).

    Pages without links give no row. All weights zero gives the first link.
    """

    def draw(powers):
        total = f"aggregate({powers}, 0D, (a, w) -> a + w)"

        def pick(t):
            walk = f"""aggregate({powers},
                named_struct('sum', 0D, 'i', 0, 'hit', -1),
                (a, w) -> named_struct(
                    'sum', a.sum + w / {t}, 'i', a.i + 1,
                    'hit', if(a.hit < 0 and r <= a.sum + w / {t}, a.i, a.hit)),
                a -> a.hit)"""
            found = let(walk, lambda h: f"if({h} >= 0, {h}, size(links) - 1)")
            return f"if({t} = 0, links[0], get(links, {found}))"

        return let(total, pick)

    powers = each("links", lambda l: bias_pow(f"{l}.weight", bias))
    return (
        weighted.where("size(links) > 0")
        .withColumn("r", F.expr(uniform("page_id", str(seed))))
        .select("page_id", F.expr(let(powers, draw)).alias("link"))
        .select("page_id", "link.*")
    )


class SelectText:
    """Table function: (selector, pos, text) of every element that matches one of an array of CSS selectors."""

    def __init__(self):
        self.compiled = {}

    def eval(self, page: str, selectors: list[str]):
        key = tuple(selectors)
        if key not in self.compiled:
            self.compiled[key] = Matcher(key)
        found = [0] * len(key)
        for node in dom.select(page or "", self.compiled[key]):
            text = "".join(node.text).strip()
            for n in range(len(key)):
                if node.matched >> n & 1:
                    yield n, found[n], text
                    found[n] += 1


def register_select_text(spark: SparkSession) -> None:
    """Make ``select_text(html, selectors)`` available to SQL, for use with LATERAL."""
    ship_package()
    spark.udtf.register("select_text", udtf(SelectText, returnType="selector int, pos int, text string"))


def extract_by_selectors(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(page_id, name, pos, text): trimmed text of every element that matches, by the selector's name.

    All selectors are matched in one pass over a page; ``pos`` counts the matches of each in page order.
    """
    Matcher(selectors.values())  # an unsupported selector fails here, not in a task
    spark = pages.sparkSession
    register_select_text(spark)
    return spark.sql(
        """SELECT p.page_id, element_at(:names, t.selector + 1) AS name, t.pos, t.text
        FROM {pages} p, LATERAL select_text(p.html, :selectors) t""",
        args={"selectors": list(selectors.values()), "names": list(selectors)},
        pages=pages.select("page_id", "html"),
    )


def extract_by_selector(pages: DataFrame, selector: str) -> DataFrame:
    """Trimmed text of every matching element per page, in page order."""
    return extract_by_selectors(pages, {"": selector}).drop("name")
