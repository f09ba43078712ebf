"""Small literal tables with positive cases, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_quoted, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


class Literal:
    def __init__(self, schema: str, *rows: tuple) -> None:
        self.schema, self.rows, self.table, self.columns, self.where = schema, rows, "", (), ""

    def given(self, table: str, *columns: str, where: str = "") -> Literal:
        """These rows and, below them, columns of a given table, as expressions that Spark and DuckDB read alike."""
        more = Literal(self.schema, *self.rows)
        more.table, more.columns, more.where = table, columns, f" WHERE {where}" if where else ""
        return more

    def _names(self) -> list[list[str]]:
        return [c.strip().split(" ", 1) for c in self.schema.split(",")]

    def df(self, spark: SparkSession, d: str = "") -> DataFrame:
        """The rows, and with a folder also those of the given table."""
        own = spark.createDataFrame(list(self.rows), self.schema)
        if not (d and self.table):
            return own
        more = spark.read.parquet(f"{d}/{self.table}.parquet")
        more = more.filter(self.where.removeprefix(" WHERE ")) if self.where else more
        return own.unionByName(more.selectExpr(*[f"CAST({x} AS {'BIGINT' if k == 'long' else k}) AS {n}" for x, (n, k) in zip(self.columns, self._names(), strict=True)]))

    def sql(self, name: str) -> str:
        """``name(cols) AS (VALUES ...)`` for a WITH clause, types as in the schema."""
        cols = self._names()
        rows = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST(c{i} AS {_KINDS[k]}) AS {n}" for i, (n, k) in enumerate(cols))
        more = " UNION ALL SELECT " + ", ".join(f"CAST({x} AS {_KINDS[k]})" for x, (_, k) in zip(self.columns, cols, strict=True)) + f" FROM {self.table}{self.where}" if self.table else ""
        return f"{name} AS (SELECT {casts} FROM (VALUES {rows}) t({', '.join(f'c{i}' for i in range(len(cols)))}){more})"


URLS = Literal(
    "id int, url string", (1, "https://www.Example.com/path?x=1#frag"), (2, "https://store.example.com/dresses"), (3, "example.com/dresses"), (4, "http://www.shop.com.lb:8080/a"),
    (5, "HTTPS://Sub.Shop.co.uk"), (6, "https://fattal-online.myshopify.com/x"), (7, "https://m.facebook.com/page"), (8, "facebook.com/page"), (9, "https://qatfalebanon.com/"),
    (10, "https://clothing-lebanon.com"), (11, "//cdn.host.org/a"), (12, ""), (13, "https://fashionstore.com/collections/x"),
)
PHONES = Literal("id int, phone string", (1, "+961 3 655 267"), (2, "009613655267"), (3, "03 655 267"), (4, "3655267"), (5, "70123456"), (6, "+1 202 555 0100"), (7, "abc"), (8, None), (9, "00"), (10, "9613655267"))
HANDLES = Literal(
    "id int, handle string", (1, "Curly.Square"), (2, "https://www.instagram.com/curlysquare/"), (3, "@shop_lb"), (4, "https://instagram.com/p/abc"), (5, "https://other.com/x"), (6, "instagram.com/example/?igshid=abc"),
    (7, "reels"), (8, None), (9, "a/b"), (10, "..."), (11, "https://instagram.com/example/?igshid=abc123"),
)
PROFILES = Literal(
    "id int, body string", (1, '{"edge_followed_by":{"count":8200}}'), (2, "117K Followers"), (3, "8,839 followers"), (4, "9M Followers, 3 Following"), (5, "no numbers"), (6, "0 Followers"), (7, "1.5k followers"), (8, None), (9, "1.2.3 followers"),
)
STORES = Literal(
    "row_id long, business_name string, domain string, is_shopify boolean, is_available boolean, strong array<string>, claim array<string>, medium array<string>, us_conflict boolean, dominant_vendor string, dominant_share double, instagram_followers long",
    (1, "Adaline", "adaline.com", True, True, [], ["lebanon_in_domain"], [], False, "Adaline", 1.0, 1272), (2, "Lacoste Lebanon", "lacoste.com.lb", True, True, ["lb_domain"], [], [], False, "Lacoste", 1.0, 9000000),
    (3, "Tech Hub", "techhub.com", True, True, ["lebanese_phone"], [], [], False, "Apple", 0.97, 20000), (4, "Apple Orchard Farm", "orchard-lb.com", True, True, ["lebanese_phone"], [], [], False, None, None, None),
    (5, "My Store", "x1.myshopify.com", True, True, ["lebanese_phone"], [], [], False, None, None, None), (6, "Maureen", "maureen.com", True, True, [], ["lebanon_in_business_name"], ["lbp_currency"], True, "Maureen", 1.0, 45000),
    (7, "Closed", "closed.com", True, False, ["lb_domain"], [], [], False, None, None, None), (8, "Plain", "plain.com", False, True, ["lb_domain"], [], [], False, None, None, None),
    (9, "Edge", "edge.com", True, True, [], [], ["a", "b"], False, "Edge", 0.5, 100000), (10, "Over", "over.com", True, True, ["lb_domain"], [], [], False, "Over", 0.5, 100001), (11, "One", "one.com", True, True, [], [], ["a"], False, None, None, None),
    (12, "Pineapple Boutique", "pineapple.com", True, None, ["lb_domain"], [], [], False, "Mike", 0.9, 0), (13, "Mike Sport ABC", "ms.com", True, True, ["lb_domain"], [], [], False, None, None, 5), (14, "Shop", "mikesport.com", True, True, ["lb_domain"], [], [], False, None, None, None),
    (15, None, "mango.com", True, True, ["lb_domain"], [], [], False, None, None, None),
)
CONTACTS = Literal(
    "id int, ig boolean, wa boolean, email boolean, phone boolean, tier string, share double, followers long", (1, True, True, True, False, "strong", 0.94, 8200), (2, True, False, False, False, "strong", 0.9, None), (3, False, False, True, False, "medium", None, None),
    (4, False, False, False, False, "none", None, None), (5, True, True, True, True, "strong", 1.0, 5000), (6, False, True, False, True, "claim", 0.8, 999), (7, False, False, False, True, "claim", 0.79, 1000), (8, True, False, True, True, "none", 0.85, 0),
)
MESSAGES = Literal(
    "id int, message string", (1, "Hi, I saw your menu lists twelve collections but shoppers cannot tell which one holds new arrivals before they open each of them in turn. Do customers ask you about it often these days?"),
    (2, "Too short?"), (3, "word " * 81 + "?"), (4, "Hi there, we would like to offer you a free audit of the shop so that we can show you some of the many things that could be better for your visitors today?"),
    (5, "Hi there, your menu holds many collections and visitors must open every one of them to find what is new this week and that can take them quite a while on a small phone."),
    (6, "Hi there, what a great collection you have on the home page and all of these many products that visitors can see when they open it on a small phone every day right?"),
    (7, "Hi there, the nav_labels of the home page hold many collections and visitors must open every one of them to find what is new this week on a small phone, is that right?"),
    (8, "I noticed that the sizes are missing on the pages of your dresses and that visitors have to write to you before they can order anything at all from a small phone, is that right?"),
    (9, "Many visitors of stores like yours leave when the checkout asks for much, and your product page is confusing to some of them when they open it on a small phone, is that right?"),
)
CLAIMS = Literal(
    "id int, evidence string, refs array<string>, stated string", (1, '{"pages":[{"title":"Home","products":[{"name":"Blue Dress","price":null}],"price_detection":"absent","search_detection":"unknown","nav_labels":["Shop","About"]}]}', ["pages[0].products[0].price"], "blue dress has no price"),
    (2, '{"pages":[{"title":"Home","products":[{"name":"Blue Dress","price":null}],"price_detection":"unknown"}]}', ["products[0].price"], "blue dress has no price"), (3, '{"pages":[{"search_detection":"unknown"}]}', ["search_detection"], "search missing"),
    (4, '{"pages":[{"nav_labels":["Shop","About"]}]}', ["nav_labels[5]"], "about"), (5, '{"pages":[{"nav_labels":["Shop","About"]}]}', ["nav_labels"], "returns policy hidden behind delivery information"), (6, '{"pages":[{"nav_labels":["Shop All","About"]}]}', [], "about"),
    (7, '{"pages":[{"nav_labels":["New Arrivals","About"]}]}', ["nav_labels[0]"], "new arrival labels"), (8, '{"pages":[{"nav_labels":["New"]}]}', ["nav_labels[0]"], "the a of"),
)
RECORDS = Literal(
    "id long, business_name string, domain string, email string, phone string, whatsapp string, instagram string, city string, industry string",
    (1, "Adaline Lebanon", "adaline.com", "hi@adaline.com", "03 655 267", None, None, "Beirut", "fashion"), (2, "Other", "other.com", "HI@adaline.com", None, None, None, None, None), (3, "Third", "third.com", None, None, "+9613655267", None, None, None),
    (4, "Adaline", "adaline-shop.com", None, None, None, None, "beirut", "general"), (5, "My Store", "a.myshopify.com", None, None, None, None, "Beirut", "general"), (6, "My Store", "b.myshopify.com", None, None, None, None, "Beirut", "general"),
    (7, "Curly", "shop.curly.com", None, None, None, "Curly.Square", None, None), (8, "Curly 2", "curly2.com", None, None, None, "https://instagram.com/curlysquare", None, None), (9, "Curly 3", "curly.com", None, None, None, None, None, None),
    (10, "Nobody", None, None, None, None, None, None, None), (11, "Bridge", "b1.com", "x@b.com", None, None, None, None, None), (12, "Bridge", "b2.com", None, None, None, "bridge_ig", None, None), (13, "Bridge", "b3.com", "x@b.com", None, None, "bridge_ig", None, None),
)
RUNS = Literal("list_pos int, id long, status string, conclusion string", (0, 905, "queued", None), (1, 904, "in_progress", None), (2, 903, "completed", "success"), (3, 902, "completed", "cancelled"), (4, 901, None, None))
PAGES = Literal(
    "page_id long, html string",
    (1, '<title>Opening soon</title><nav><a href="/collections/new">New &amp; Now</a><a href="/x">About</a><a href="/x">ABOUT</a></nav><h1>One</h1><h2>Two</h2><button>Buy</button><a class="btn big" href="/c">Go</a><a href="/collections/new">New</a>'),
    (2, '<title>Shop</title><h1>H</h1><a href="/products/a?v=1"><img></a><a href="/products/a"><b>Dress</b></a><span>$40.00</span><a href="/products/b">Hat</a><input type="submit" value="Send"><p class="money">x</p><input name="q">'),
    (3, '<title>Plain</title><a href="/products/z">Zed</a><script>var p="$5"</script><p>size guide</p>'),
    (4, ""),
)

# --- with rows of given tables -------------------------------------------

_CALLED = "('25-' || (c_custkey % 899 + 100) || '-741-29' || (c_custkey % 89 + 10))"
_SHOP = "lower(replace(c_name, '#', '.'))"
GIVEN_URLS = URLS.given("pages", "page_id + 1000", "url")
GIVEN_PHONES = PHONES.given("customer", "c_custkey + 100", f"CASE c_custkey % 3 WHEN 0 THEN {_CALLED} WHEN 1 THEN '+961 ' || {_CALLED} ELSE '03 ' || (100000 + c_custkey) END")
GIVEN_HANDLES = HANDLES.given("customer", "c_custkey + 100", f"CASE c_custkey % 4 WHEN 0 THEN {_SHOP} WHEN 1 THEN 'https://www.instagram.com/' || {_SHOP} || '/?x=1' WHEN 2 THEN '@' || {_CALLED} ELSE c_mktsegment || '/' END")
GIVEN_PROFILES = PROFILES.given("events", "event_id + 100", """CASE event_id % 4 WHEN 0 THEN '{"edge_followed_by":{"count":' || event_id || '}}' WHEN 1 THEN (event_id % 900) || '.5K Followers' WHEN 2 THEN event_type ELSE (event_id % 90) || ',123 followers' END""")
GIVEN_RECORDS = RECORDS.given(
    "customer", "c_custkey + 100", "(c_custkey * 7919 % 100003) || ' ' || c_mktsegment", "'d' || (c_custkey % 1100) || '.com'", "CASE WHEN c_custkey % 5 = 0 THEN 'm' || (c_custkey % 450) || '@x.com' END",
    "CASE WHEN c_custkey % 7 = 0 THEN '03 ' || (100000 + c_custkey % 903) END", "NULL", "CASE WHEN c_custkey % 3 = 0 THEN 'u' || (c_custkey % 800) END", "c_mktsegment", "NULL",
)
GIVEN_RUNS = RUNS.given("events", "event_id + 10", "event_id + 1000", "CASE event_id % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'waiting' ELSE event_type END", "CASE event_id % 4 WHEN 0 THEN 'success' ELSE event_type END")
GIVEN_STORES = STORES.given(
    "customer", "c_custkey + 100", "CASE c_custkey % 13 WHEN 0 THEN 'Lacoste Lebanon' WHEN 1 THEN 'My Store' ELSE c_custkey || ' ' || lower(c_mktsegment) END", "'d' || c_custkey || '.com'",
    "c_custkey % 7 <> 0", "c_custkey % 11 <> 0", "split('lb_domain', ',')", "split('lebanon_in_domain', ',')", "split('a,b', ',')", "c_custkey % 2 = 0",
    "CASE c_custkey % 5 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Lacoste' ELSE c_mktsegment END", "(c_custkey % 65) / 64.0", "c_custkey * 97",
)
