"""Word lists, patterns and limits that results depend on.

They are data, not logic, and are kept here in plain form and natural order.
"""

from __future__ import annotations

# --- discovery -----------------------------------------------------------

QUERIES = (
    '"Lebanon" "powered by Shopify"', "site:myshopify.com Lebanon", "site:myshopify.com Beirut", '"Beirut" "powered by Shopify"',
    '"Lebanon" "shop now"', '"Lebanon" "online store"', '"Lebanon" "buy online"', '"Lebanon" "free delivery"',
    '"delivery all over Lebanon" shop', '"shipping within Lebanon" store', '"order online" Lebanon store',
    '"Lebanon" online store "LBP"', '"+961" "add to cart"', '"+961" online shop',
    '"Beirut" "online store"', '"Tripoli Lebanon" online shop', '"Saida" OR "Sidon" Lebanon online store', '"Jounieh" online store',
    '"Byblos" OR "Jbeil" online shop', '"Zahle" Lebanon online store',
    "Lebanon online store handmade", "Lebanon online store jewelry", "Lebanon online store fashion boutique",
    "Lebanon online store beauty skincare", "Lebanon online store electronics", "Lebanon online store home decor",
    "Lebanon online store kids toys", "Lebanon online store food gourmet",
)
IGNORED_HOSTS = (
    "bing.com", "google.com", "duckduckgo.com", "yahoo.com", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "youtube.com", "linkedin.com", "tiktok.com", "wikipedia.org", "pinterest.com", "maps.google.com",
)
MAX_NEW_LEADS = 10

# --- storefronts ---------------------------------------------------------

SHOPIFY_SIGNALS = ("cdn.shopify.com", "shopify-section", "shopify-payment-button", "myshopify.com")
ECOMMERCE_SIGNALS = ("add to cart", "addtocart", "add-to-cart", "/cart", "checkout", "buy now", "shopping cart")
CLOSED_STATUS = (401, 402, 403, 503)
CLOSED_TITLES = (
    "store unavailable", "currently unavailable", "this store is unavailable", "opening soon", "coming soon",
    "under construction", "store is closed", "temporarily closed", "account suspended",
)
PLACEHOLDER_NAMES = (
    "my store", "my shop", "your store", "store name", "shopify store", "example store", "my new store", "test store", "demo store",
)
FOLLOWER_CEILING = 100_000
OUTLET_SHARE = 0.80

# --- contacts ------------------------------------------------------------

EMAIL = r"[a-zA-Z0-9][a-zA-Z0-9._%+-]*@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IGNORED_EMAIL_DOMAINS = (
    "sentry.io", "ingest.sentry.io", "wixpress.com", "example.com", "godaddy.com", "schema.org", "domain.com",
    "gist-apps.com", "shopify.com", "sentry-cdn.com",
)
IGNORED_EMAIL_SUFFIXES = (".png", ".jpg", ".jpeg", ".svg", ".webp", ".gif", ".css", ".js", ".map")
PHONE = r"(?:\+961|00961)[\s.-]?\d{1,2}[\s.-]?\d{3}[\s.-]?\d{3}"
WHATSAPP = r"(?:wa\.me/|whatsapp\.com/send\?phone=)(\d{8,15})"
INSTAGRAM_LINK = r"instagram\.com/([A-Za-z0-9_.]+)"
INSTAGRAM_HANDLE = r"^[A-Za-z0-9_][A-Za-z0-9_.]{0,29}$"
IGNORED_INSTAGRAM_PATHS = (
    "p", "reel", "reels", "explore", "accounts", "tv", "stories", "share", "direct", "about", "developer", "legal", "privacy",
)
NON_PROFILE_PATHS = ("p", "reel", "reels", "explore", "stories", "tv", "accounts", "direct", "about", "developer", "legal", "privacy")
PLATFORM_HANDLES = (
    "instagram", "shopify", "shopifyplus", "meta", "facebook", "klaviyo", "gorgias", "yotpo", "judgeme", "oberlo", "printful",
    "mailchimp", "tiktok", "youtube", "pinterest", "twitter", "linkedin", "whatsapp",
)
MIN_INSTAGRAM_CONFIDENCE = 3
FOLLOWERS_JSON = r'"edge_followed_by":\s*\{"count":\s*(\d+)\}'
FOLLOWERS_TEXT = r"([\d][\d.,]*)\s*([KMkm]?)\s*[Ff]ollowers"

# --- site structure ------------------------------------------------------

HREFLANG = r'hreflang="([a-zA-Z\-]+)"'
SENTRY = r"sentry\.io|@sentry|sentry-cdn"
STORE_LOCATOR = (
    r"store locator|our stores|our branches|find a store|store finder|/pages/(stores|locations|branches|our-stores|store-locator)"
)
CORPORATE_TERMS = r"\b(s\.a\.l\.?|s\.a\.r\.l\.?|holdings|franchisee|group of companies|group sal)\b"

# --- Lebanon -------------------------------------------------------------

LEBANON_PHONE = r"(?:\+961|00961)"
CITIES = (
    "beirut", "tripoli", "sidon", "saida", "jounieh", "jouneih", "zahle", "zahleh", "byblos", "jbeil", "jbail", "batroun",
    "nabatieh", "baabda", "achrafieh", "ashrafieh", "hamra", "gemmayzeh", "dbayeh", "antelias", "broummana", "bikfaya",
    "zgharta", "amchit", "faraya", "deir el qamar",
)
SHIPPING_CONTEXT = r"(?i)\b(shipping|delivery|ship|deliver|located|based|dispatch)\b[^.!?]{0,80}\blebanon\b"
US_CONTEXT = (
    r"(?i)mt(\.)?\s*lebanon|\blebanon\b[^.]{0,25}\b(pa|pennsylvania|tn|tennessee|ohio|oh|new york|ny|texas|tx|"
    r"missouri|mo|indiana|kentucky|ky|new hampshire|nh|oregon|virginia|va|wisconsin|wi|kansas|ks|maine|new jersey|nj|"
    r"nebraska|ne|connecticut|ct|usa|us)\b"
)
CITY_CONTEXT = r"(?i)\b(located in|based in|address|store at|visit us|find us|delivering in|delivering to)\b[^.]{0,60}"

# --- business names ------------------------------------------------------

GENERIC_NAME_WORDS = (
    "home", "shop", "shops", "store", "stores", "online", "shopping", "products", "product", "collections",
    "collection", "welcome", "cart", "checkout", "search", "blog", "about", "contact", "login", "register", "account",
    "privacy", "terms", "service", "returns", "refund", "shipping", "policy", "faq", "new", "sale", "featured", "page",
    "not", "found", "error", "dresses", "dress", "jackets", "shoes", "bags", "accessories", "clothing", "clothes",
    "fashion", "lebanon", "beirut", "official", "site", "website", "catalog", "catalogue", "gallery", "lookbook",
    "reviews", "testimonials", "offers", "promotions", "men", "women", "kids", "baby", "best", "top", "buy", "shopify",
    "powered", "by", "wear", "apparel", "outfit", "browse", "promo", "free", "worldwide", "delivery", "discount",
    "coupon", "code", "exchange", "guarantee", "warranty", "exclusive", "extra", "limited", "instant", "clearance",
    "clear", "offer", "furniture", "electronics", "jewelry", "jewellery", "beauty", "toys", "food", "coffee", "gifts",
    "books", "art", "perfume", "skincare", "makeup", "cosmetics", "handbags", "watches", "homeware", "stationery",
    "sports", "fitness", "health", "pharmacy", "flowers", "candles", "decor", "automotive", "pets", "wine", "chocolate",
    "honey", "olive", "spices", "book", "now", "here", "more", "click", "read", "learn", "get", "started", "subscribe",
    "sign", "up", "join", "order", "view", "today", "soon", "back", "news", "drop", "the", "a", "an", "to", "in", "on",
    "at", "for", "with", "and", "of", "all", "our", "your", "we", "is", "are",
)
ERROR_NAME_TERMS = (
    "currently unavailable", "unavailable", "not found", "error", "something went wrong", "looks like you", "maintenance",
    "under construction", "coming soon", "suspended", "access denied", "forbidden", "page cannot", "this page", "no products",
    "there are no", "oops", "sorry", "404", "503", "null", "store is currently", "the store is",
    "just a moment", "attention required", "checking your browser", "verify you are human", "please wait", "cloudflare",
    "enable javascript", "redirecting", "are you a robot", "security check", "ddos protection",
)
MAX_NAME_LEN, MAX_NAME_WORDS, MAX_NAME_PUNCT = 50, 6, 2
COLLECTION_HEADING = r"^(shop by|shop for|shop our|shop the|shop all|browse|all about)\b"
NAME_SEPARATORS = r"\s*[|»›·●◆▪–—\-:;,]\s*"
TITLE_SUFFIXES = (
    "| online store", "| shopify", " - shopify", "| powered by shopify", " - powered by shopify", "online store",
    "official store", "official website", "official online store", "homepage", "home page", "| buy online", " - buy online",
    "shopify", "| official site", "| lebanon", "| beirut", "| official website", " - official", "| official", "| online",
    " - online", "official", "online",
)
DOMAIN_WORDS = (
    "electronics", "accessories", "timepieces", "jewellery", "furniture", "cosmetics", "skincare", "clothing", "lebanese",
    "fragrance", "boutique", "handmade", "official", "lebanon", "fashion", "jewelry", "kitchen", "grocery", "beauty", "online",
    "apparel", "sneakers", "flowers", "candles", "watches", "shoes", "store", "market", "gifts", "home", "shop", "wear", "kids",
    "baby", "food", "plus", "bags", "lb", "good", "house", "studio", "beirut", "lifestyle", "collection",
)
DOMAIN_DROP = ("com", "co", "net", "org", "io", "lb", "myshopify", "ae", "sa", "me", "us", "uk", "ca", "info")
DOMAIN_PREFIX_DROP = ("www", "store", "shop", "my")
ORGANISATION_TYPES = ("organization", "store", "localbusiness", "onlinestore", "corporation", "retailstore", "shoppingcenter")
LOGO_MARKERS = ("logo", "brand", "site-name", "shop-name", "store-name")

# --- industries ----------------------------------------------------------

INDUSTRIES = (
    ("fashion", ("dress", "fashion", "clothing", "apparel", "shirt", "skirt", "blouse", "jacket", "jeans", "couture", "wear", "abaya", "hijab", "modest", "trouser", "outfit")),
    ("jewelry & watches", ("jewelry", "jewellery", "jewel", "gold", "silver", "necklace", "bracelet", "earring", "ring", "diamond", "watch", "timepiece", "bijoux")),
    ("beauty & cosmetics", ("cosmetic", "skincare", "beauty", "makeup", "make-up", "perfume", "fragrance", "serum", "lotion", "haircare", "shampoo", "cream")),
    ("electronics", ("electronics", "phone", "mobile", "smartphone", "laptop", "computer", "gaming", "gadget", "camera", "headphone", "audio", "console", "appliance", "printer")),
    ("home & furniture", ("furniture", "home decor", "decor", "sofa", "cushion", "lamp", "kitchen", "bedding", "linen", "carpet", "rug", "vase", "curtain", "pillow")),
    ("food & grocery", ("grocery", "food", "supermarket", "snack", "coffee", "chocolate", "olive oil", "honey", "spice", "delicatessen", "cheese", "wine", "organic")),
    ("health & pharmacy", ("pharmacy", "vitamin", "supplement", "health", "wellness", "medical", "dental", "protein", "pharma")),
    ("sports & fitness", ("sport", "gym", "fitness", "yoga", "cycling", "running", "football", "soccer", "tennis", "workout", "outdoor", "hiking")),
    ("toys & kids", ("toy", "kids", "baby", "child", "stroller", "diaper", "lego", "puzzle", "plush")),
    ("books & stationery", ("book", "novel", "stationery", "publisher", "literature", "notebook", "reading")),
    ("art & crafts", ("art", "craft", "painting", "canvas", "handmade", "handicraft", "ceramic", "pottery", "sculpture")),
    ("pet supplies", ("pet", "dog", "cat", "aquarium", "veterinary", "leash")),
    ("automotive", ("car", "auto", "automotive", "vehicle", "tire", "spare part")),
    ("flowers & gifts", ("flower", "gift", "bouquet", "gift card", "chocolatier")),
)

# --- identity ------------------------------------------------------------

PLATFORM_DOMAINS = ("myshopify.com", "shopifypreview.com", "wixsite.com", "squarespace.com", "bigcartel.com", "webflow.io")
SECOND_LEVEL = ("com", "co", "net", "org", "gov", "edu", "ac")
NAME_NOISE = ("lebanon", "lebanese", "leb", "lb", "online", "store", "shop", "official", "the", "co", "com")
NON_IDENTIFYING_NAMES = (*PLACEHOLDER_NAMES, "my")
UNKNOWN_VALUES = ("", "general", "unknown", "none", "other")
NAME_SIMILARITY = 0.90
MIN_NAME_CHARS = 4

# --- page evidence -------------------------------------------------------

CAP_STRING, CAP_HEADINGS, CAP_NAV, CAP_COLLECTIONS, CAP_PRODUCTS, CAP_CTAS = 120, 8, 15, 10, 12, 8
SUFFICIENT_PRODUCTS, SUFFICIENT_LABELS = 6, 3
MAX_HTML = 400_000
PRICE = r"(?i)(?:USD|LBP|\$|£|€)\s?\d[\d.,]*|\d[\d.,]*\s?(?:USD|LBP)"
PRICE_WINDOW = 600
# the two halves of PRICE, for linear time: a number begins where its run of digits does
PRICE_SIGN_FIRST = r"(?i)(?:USD|LBP|\$|£|€)\s?\d[\d.,]*"
PRICE_NUMBER_FIRST = r"(?i)(?<![\d.,])[.,]*+(\d[\d.,]*+\s?(?:USD|LBP))"
ENTITIES = (
    ("nbsp", " "), ("amp", "&"), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("ndash", "–"), ("mdash", "—"),
    ("hellip", "…"), ("middot", "·"), ("rsquo", "’"), ("lsquo", "‘"), ("ldquo", "“"), ("rdquo", "”"),
)
BREAKOUTS = (r"(?i)</?untrusted_website_content>", r"<\|[^|>]{0,64}\|>", r"(?i)</?(system|assistant|user)\b[^>]{0,64}>")
PRICE_MARKUP = (r'(?i)class="[^"]*\b(price|money|amount)\b[^"]*"', r"(?i)<(price|sale-price|product-price)[\s>-]", r"(?i)data-(price|product-price)\b")
SEARCH_PROBE = r'(?i)type="search"|name="q"|role="search"|/search'
SIZE_GUIDE_PROBE = r"(?i)size\s?(guide|chart)|fit\s?guide"

# --- message validators --------------------------------------------------

WORDS_MIN, WORDS_MAX = 25, 80
BANNED_PHRASES = (
    "free audit", "free website audit", "free review", "free analysis", "no charge", "free of charge", "complimentary",
    "book a call", "book a time", "hop on a call", "jump on a call", "quick call", "schedule a call", "schedule a time",
    "set up a call", "calendly", "zoom call", "discovery call", "15 minutes of your time",
    "redesign", "re-design", "rebuild your", "revamp", "overhaul", "new website", "website refresh",
    "increase your conversions", "boost your sales", "boost your revenue", "increase your revenue", "double your", "10x",
    "skyrocket", "drive more sales", "maximise your", "maximize your", "leaving money on the table", "losing customers",
    "losing sales", "i hope this message finds you well", "i hope this email finds you well", "reaching out because",
    "as a fellow", "quick question for you", "let me know if you", "circle back", "touch base",
)
DEFICIENCIES = (
    r"\b(no|not|never|nothing|none|without|lacks?|lacking|missing|absent)\b",
    r"\b(isn't|aren't|doesn't|don't|won't|can't|cannot|couldn't|didn't)\b",
    r"\bn't\b",
    r"\b(hidden|hides?|buried|obscured|unclear|ambiguous|confusing|vague)\b",
    r"\b(hard|harder|difficult|awkward|slow|tedious|unintuitive)\b",
    r"\b(broken|fails?|failing|error|empty|blank|placeholder|truncated)\b",
    r"\b(inconsistent|mismatch(ed)?|duplicated?|conflicting|outdated)\b",
    r"\b(only after|forces?|requires?|have to|has to|must first)\b",
    r"\b(before you|until you|unless you)\b",
)
PRAISES = (
    r"\b(great|excellent|lovely|beautiful|gorgeous|impressive|fantastic)\b",
    r"\b(nicely|nice job|well done|good job|love (your|the)|really like)\b",
    r"\b(already (show|display|have|has|include)|does a (great|good) job)\b",
    r"\b(clean|polished|professional|seamless|smooth)\s+(design|look|layout|experience|navigation|menu|site|store|grid)\b",
    r"\bwell[-\s](organised|organized|laid\s?out|designed|structured|built|made|presented)\b",
)
LEAKS = (
    r"\b(shows_prices|has_search|has_size_guide|has_product_cards|nav_labels)\b",
    r"\b(price|search|size_guide|product_card)_detection\b",
    r"\b(evidence_refs|pages_fetched|opportunity_[a-z_]+|problem_type|shopper_impact)\b",
    r"\b(products|collections|pages|headings|ctas)\s*\[\s*\d+\s*\]",
    r"\bprice\s*[:=]\s*null\b",
    r'"[a-z_]+"\s*:\s*(null|true|false)',
    r"\b[a-z]+_[a-z]+\s*[:=]\s*(null|true|false)\b",
    r"\bjson\b",
)
NOTICING = r"\b(noticed|noticing|spotted|saw that|i see that|found that|realis|realiz|observed)\b"
WEAKNESS = (
    r"\b(your|the)\s+[a-z ]{3,30}\s+(is|are|isn't|aren't|looks|seems|feels)\s+(not\s+)?"
    r"(confusing|unclear|hard|difficult|broken|missing|hidden|slow|awkward|cluttered)\b"
)
PROBLEM_TYPES = ("missing", "hidden", "unclear", "inconsistent", "broken", "friction")
FALLBACK_CATEGORY = "generic_shopping_experience"
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "on",
    "at", "for", "with", "from", "by", "as", "it", "its", "this", "that", "these", "those", "there", "then", "than",
    "you", "your", "their", "has", "have", "had", "do", "does", "did", "not", "no", "any", "all", "some", "more",
    "most", "only", "very", "can", "could", "would", "should", "may", "might", "will", "page", "pages", "site",
    "website", "store", "shop", "which", "when", "until", "without", "into", "out", "up", "down", "over", "under",
)
MIN_OVERLAP = 0.5

#: What markup is read for a page's parts.
NAV_PATTERNS = (
    r"(?i)<nav\b[^>]*>([\s\S]{0,8000}?)</nav>",
    r"(?i)<header\b[^>]*>([\s\S]{0,8000}?)</header>",
    r"(?i)<ul\b[^>]*(?:menu|nav)[^>]*>([\s\S]{0,8000}?)</ul>",
)
NAV_LINK = r"(?i)<a\b[^>]*>([\s\S]{0,120}?)</a>"
HEADING_PATTERNS = (r"(?i)<h1\b[^>]*>([\s\S]{0,300}?)</h1>", r"(?i)<h2\b[^>]*>([\s\S]{0,300}?)</h2>")
COLLECTION_LINK = r'(?i)<a\b[^>]*href="[^"]*/collections/[^"]*"[^>]*>([\s\S]{0,200}?)</a>'
ACTION_PATTERNS = (
    r"(?i)<button\b[^>]*>([\s\S]{0,120}?)</button>",
    r'(?i)<input\b[^>]*type="submit"[^>]*value="([^"]{0,120})"',
    r'(?i)<a\b[^>]*class="[^"]*(?:btn|button)[^"]*"[^>]*>([\s\S]{0,120}?)</a>',
)
TITLE_PATTERN = r"(?i)<title\b[^>]*>([\s\S]{0,300}?)</title>"
PRODUCT_PATH = "/products/"
PRODUCT_NAME_MOST = 400
#: Links of a page that are worth another request: a collection but "all", any collection, a product.
FOLLOW_COLLECTION = r'(?i)href="([^"]*/collections/(?!all\b)[^"?#]+)"'
FOLLOW_ANY_COLLECTION = r'(?i)href="([^"]*/collections/[^"?#]+)"'
FOLLOW_PRODUCT = r'(?i)href="([^"]*/products/[^"?#]+)"'

#: What speaks for an account that a page links to.
REL_ME_POINTS = 3
SOCIAL_ATTRIBUTES = ("class", "id", "aria-label", "title", "name")
SOCIAL_WORDS = ("instagram", "social", "follow")
SOCIAL_ATTRIBUTE_POINTS = 3
SOCIAL_BLOCK_TAGS = ("footer", "header", "nav")
SOCIAL_BLOCK_WORDS = ("social", "footer", "contact", "follow")
SOCIAL_BLOCK_POINTS = 4
STRUCTURED_POINTS = 3

# --- runs ----------------------------------------------------------------

ACTIVE_RUN_STATES = ("queued", "in_progress", "requested", "waiting", "pending")

#: What is said when a stage of an analysis fails.
FAILURES = {
    "unreachable": "Could not reach this website.", "timeout": "The website took too long to respond.", "rate_limited": "Analysis is rate-limited right now. Try again in a minute.",
    "not_configured": "Analysis is not configured on the server.", "unavailable": "Could not analyze this lead right now.", "invalid_json": "Could not analyze this lead right now.",
    "timed_out": "Analysis took too long. Try again.", "no_budget": "Analysis took too long. Try again.",
}
