"""One query for each form of selector, over the link lists of the pages."""

from pyspark.sql import functions as F

from ..operators import dom
from ..sources.html_nodes import with_fragment
from . import query
from .markup_queries import LI_SQL

_ITEMS = f"""WITH {LI_SQL}, x AS (SELECT page_id, pos, regexp_extract(body, 'href="([^"]*)"', 1) AS href, regexp_replace(body, '<[^>]+>', '', 'g') AS title, count(*) OVER (PARTITION BY page_id) AS n FROM li)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS pos, {{value}} AS value FROM x WHERE {{where}}"""

#: Name, selector, what is taken of an item and which items, in SQL.
FORMS = [
    ("css_later_siblings", "css:li:first-child ~ li", "title", "pos > 0"),
    ("css_next_of_next", "css:li + li + li > a", "title", "pos > 1"),
    ("css_child_positions", "css:li:nth-child(2n+1) a", "title", "pos % 2 = 0"),
    ("css_last_positions", "css:nav li:nth-last-child(-n+2)", "title", "pos >= n - 2"),
    ("css_type_positions", "css:ul > li:nth-of-type(3n)", "title", "pos % 3 = 2"),
    ("css_negation", "css:li:not(:first-child, :last-child)", "title", "pos > 0 AND pos < n - 1"),
    ("css_containing", "css:li:has(> a[href^='/t'])", "title", "starts_with(href, '/t')"),
    ("css_attribute_values", "css:nav a::attr(href)", "href", "true"),
    ("css_text_values", "css:nav li:last-child a::text", "title", "pos = n - 1"),
    ("xpath_attribute_values", "xpath://li/a/@href", "href", "true"),
    ("xpath_text_values", "xpath://nav//li[2]//text()", "title", "pos = 1"),
    ("xpath_positions", "xpath://li[position()>1][last()-1]", "title", "pos = n - 2 AND pos > 0"),
    ("xpath_boolean", "xpath://li[a[contains(@href,'th') or starts-with(@href,'/of')] and not(position()=2)]", "title", "(contains(href, 'th') OR starts_with(href, '/of')) AND pos <> 1"),
    ("xpath_text_tests", "xpath://nav//a[contains(text(),'e') and normalize-space(.)!='the']/@href", "href", "contains(title, 'e') AND title <> 'the'"),
    ("xpath_axes", "xpath://li[2]/preceding-sibling::li/a | //li[2]/following-sibling::li[a]/a", "title", "pos <> 1 AND n > 1"),
]


def _register(name: str, path: str, value: str, where: str) -> None:
    @query(name, _ITEMS.format(value=value, where=where))
    def _(t):
        return with_fragment(t.pages.select("page_id", "html")).select("page_id", F.posexplode(dom.text_list("dom", path)).alias("pos", "value"))


for _form in FORMS:
    _register(*_form)


@query("css_next_sibling", "SELECT page_id, regexp_extract(html, '</nav>(?:<!--.*?-->)?<div class=\"ad\">([^<]*)</div>', 1) AS text FROM pages")
def _(t):
    return with_fragment(t.pages).select("page_id", dom.first_text("dom", "css:nav + div.ad").alias("text"))
