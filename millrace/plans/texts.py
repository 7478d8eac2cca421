"""Text, HTML, JSON and date functions over the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, json, text
from ..operators import catalogue
from ..sources.jsonld import found_postings
from ..sources.readers import structured_postings
from .base import NOW, Tables, query


@query("classify_case", """
WITH p AS (SELECT p_partkey, p_type || CASE p_partkey % 6 WHEN 0 THEN ' Intern' WHEN 1 THEN ' Internal Audit' WHEN 2 THEN ' Co-op' WHEN 3 THEN ' Summer Analyst' WHEN 4 THEN ' Senior Engineer' ELSE '' END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 'Rising senior student, class of 2026' WHEN p_partkey % 4 = 1 THEN '5+ years of experience' ELSE 'Join us' END AS d, CASE WHEN p_partkey % 7 = 0 THEN 'Full-time' ELSE '' END AS k, p_partkey % 11 = 0 AS closed FROM part)
SELECT p_partkey, CASE WHEN closed THEN 'CONFIRMED_CLOSED' WHEN regexp_matches(title, '(?i)\\bintern(ship)?s?\\b|\\bco-?ops?\\b') THEN 'QUALIFYING_INTERNSHIP'
  WHEN title LIKE '%Summer Analyst%' THEN CASE WHEN p_partkey % 4 = 0 THEN 'QUALIFYING_INTERNSHIP' ELSE 'UNCERTAIN_CLASSIFICATION' END
  WHEN p_partkey % 4 = 1 OR title LIKE '%Senior%' OR k <> '' THEN 'NOT_AN_INTERNSHIP' WHEN p_partkey % 4 = 0 THEN 'UNCERTAIN_CLASSIFICATION' ELSE 'NOT_AN_INTERNSHIP' END AS label FROM p
""")
def classify_case(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*map(F.lit, [" Intern", " Internal Audit", " Co-op", " Summer Analyst", " Senior Engineer", ""])), (k % 6 + 1).cast("int"))
    about = F.when(k % 4 == 0, "Rising senior student, class of 2026").when(k % 4 == 1, "5+ years of experience").otherwise("Join us")
    label = text.classify_internship(F.concat("p_type", tail), about, F.when(k % 7 == 0, "Full-time").otherwise(""), k % 11 == 0)
    return t.part.select("p_partkey", label.alias("label"))


_VOCABULARY = {"metal": ["steel", "brass", "copper", "tin", "nickel"], "plated": ["plated"], "polished": ["polished", "burnished"]}


@query("classify_arrays", """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(lower(p_type), 'steel|brass|copper|tin|nickel') THEN 'metal' END, CASE WHEN contains(lower(p_type), 'plated') THEN 'plated' END,
  CASE WHEN regexp_matches(lower(p_type), 'polished|burnished') THEN 'polished' END], lambda x: x IS NOT NULL), ',') AS tags FROM part
""")
def classify_arrays(t: Tables) -> DataFrame:
    return text.with_tags(t.part, F.col("p_type"), _VOCABULARY, "found").select("p_partkey", F.array_join("found", ",").alias("tags"))


@query("season_and_sponsorship", """
SELECT o_orderkey, ['Summer', 'Fall', 'Spring', 'Winter', 'Unknown'][o_orderkey % 5 + 1] AS season, ['Yes', 'No', 'NotSure', 'Unknown'][o_orderkey % 4 + 1] AS sponsorship FROM orders
""")
def season_and_sponsorship(t: Tables) -> DataFrame:
    term = F.element_at(F.array(*map(F.lit, ["2027-Summer", "fall 2026", "Spring", "WINTER term", "any"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    answer = F.element_at(F.array(*map(F.lit, [" Yes", "NO", "Not sure yet", "maybe"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", text.season(term).alias("season"), text.sponsorship(answer).alias("sponsorship"))


@query("regex_extract_years", """
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([2020 + o_orderkey % 14, 2023 + o_orderkey % 5], lambda y: y BETWEEN 2024 AND 2032))), ',') AS years FROM orders
""")
def regex_extract_years(t: Tables) -> DataFrame:
    line = F.concat(F.lit("For the Class of "), F.col("o_orderkey") % 14 + 2020, F.lit(", graduating in "), F.col("o_orderkey") % 5 + 2023)
    return t.orders.select("o_orderkey", F.array_join(text.graduation_years(line), ",").alias("years"))


@query("parse_range", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS low, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size + 10.5 END AS high FROM part")
def parse_range(t: Tables) -> DataFrame:
    pay = F.when(F.col("p_partkey") % 5 == 0, "N/A").otherwise(F.concat(F.lit("$"), F.col("p_size"), F.lit(" - $"), F.col("p_size") + 10, F.lit(".5/hr")))
    return t.part.select("p_partkey", text.compensation(pay)["min"].alias("low"), text.compensation(pay)["max"].alias("high"))


#: Ends that documents are given, by doc_id, so that each signal and some near misses occur.
_ASKS = (
    "Pay a deposit first", "send bitcoin", "buy gift cards", "your routing number", "passport number, please", "contact us on telegram", "https://x.example/run.exe now",
    "send your CV to Ann.Lee@gmail.com or email b@corp.net", "contact c@corp.net", "a gift cardholder", "",
)


@query("fraud_signals", f"""
WITH d AS (SELECT doc_id, text || '\n' || [{", ".join(f"'{a}'" for a in _ASKS)}][CAST(doc_id % {len(_ASKS)} AS INTEGER) + 1] AS text FROM documents)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '(?i)\\b(application fee|processing fee|registration fee|pay (a |an )?(fee|deposit)|purchase (a |your )?(laptop|equipment|starter kit)|wire transfer|western union|moneygram)\\b') THEN 'requests-payment' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(bitcoin|cryptocurrency|crypto wallet|usdt|ethereum payment)\\b') THEN 'requests-cryptocurrency' END,
  CASE WHEN regexp_matches(text, '(?i)\\bgift cards?\\b') THEN 'requests-gift-cards' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(bank account number|routing number|direct deposit (details|information) before)\\b') THEN 'requests-banking-info' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(social security number|ssn|passport number|driver''?s licen[sc]e number)\\b') THEN 'requests-government-id' END,
  CASE WHEN regexp_matches(text, '(?i)\\bcontact (us |me )?(on |via )?(telegram|whatsapp)\\b') THEN 'unusual-contact-channel' END,
  CASE WHEN regexp_matches(text, '(?i)https?://\\S+\\.(exe|scr|bat|msi|jar)\\b') THEN 'executable-download' END,
  CASE WHEN len(list_filter(regexp_extract_all(text, '(?i)\\b(?:contact|email|reach (?:us|out|me)|send (?:your )?(?:resume|application|cv) to)\\b[^.\\n]{{0,60}}?([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', 1),
    lambda x: lower(split_part(x, '@', 2)) IN ('gmail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'aol.com', 'icloud.com'))) > 0 THEN 'personal-email-contact' END
  ], lambda x: x IS NOT NULL), ',') AS signals FROM d
""")
def fraud_signals(t: Tables) -> DataFrame:
    """All signals of whole documents, each with one of the ends."""
    end = F.get(F.array(*map(F.lit, _ASKS)), (F.col("doc_id") % len(_ASKS)).cast("int"))
    return t.documents.select("doc_id", F.array_join(text.fraud_signals(F.concat("text", F.lit("\n"), end)), ",").alias("signals"))


@query("email_extraction", """
SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), ',') AS emails FROM documents
""")
def email_extraction(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), 0), ",").alias("emails"))


#: Ends that pages are given, by page_id, so that each notice and each near miss occurs.
_ENDS = (
    "This job is closed", "the requisition  has been cancelled.", "Job posting expired!", "position has been filled", "job is no longer available",
    "We are sorry", "we''re sorry, this job at Acme is no longer available", "no longer accepting", "this job isclosed", "posting closed", "",
)
#: The same fixed notices for DuckDB, whose blanks are ASCII's and whose word ends are ECMAScript's.
_BLANK = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_CLOSED = "|".join(text.CLOSED_NOTICES).replace(r"\s", _BLANK).replace("'", "''")


@query("closed_html", f"""
WITH e AS (SELECT [{", ".join(f"'{e}'" for e in _ENDS)}] AS ends)
SELECT page_id, regexp_matches(html || ' ' || ends[CAST(page_id % {len(_ENDS)} AS INTEGER) + 1], '(?i)({_CLOSED})') AS closed FROM pages, e
""")
def closed_html(t: Tables) -> DataFrame:
    """Whole pages, each with one of the ends."""
    end = F.get(F.array(*[F.lit(e.replace("''", "'")) for e in _ENDS]), (F.col("page_id") % len(_ENDS)).cast("int"))
    return t.pages.select("page_id", text.looks_closed(F.concat("html", F.lit(" "), end)).alias("closed"))


@query("html_title", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_title(F.col("html")).alias("title"))


@query("html_links", "SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) AS l FROM pages)")
def html_links(t: Tables) -> DataFrame:
    links = text.html_links(F.col("html"))
    return t.pages.select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


@query("html_text", """
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS digest FROM pages
""")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(text.html_text(F.col("html")), 256).alias("digest"))


@query("content_unchanged", "SELECT page_id FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0)")
def content_unchanged(t: Tables) -> DataFrame:
    """Pages whose content differs from every page of the prior snapshot."""
    seen = t.pages.where("page_id % 2 = 0").select(F.sha2("html", 256).alias("h"))
    return t.pages.select("page_id", F.sha2("html", 256).alias("h")).join(seen, "h", "left_anti").select("page_id")


_POSTING = "That thereof: the ontion, hadthe andthe intern for ering. RE th-in C++ your"
_STOPS = ", ".join(f"'{w}'" for w in text.MATCH_STOP_WORDS)


@query("relevance_rank", f"""
WITH f AS (SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') AS content, lang = 'en' AS context FROM documents),
d AS (SELECT doc_id, context, list_distinct(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9+.#-]{{1,}}')) AS have FROM f),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{_POSTING}'), '[a-z0-9][a-z0-9+.#-]{{1,}}')) AS word),
s AS (SELECT doc_id, sum(CASE WHEN length(word) >= 6 THEN 2 ELSE 1 END) AS score FROM (SELECT doc_id, unnest(have) AS word FROM d) JOIN w USING (word) WHERE length(word) >= 3 AND word NOT IN ({_STOPS}) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(score, 0) AS INTEGER) AS score FROM d LEFT JOIN s USING (doc_id) WHERE coalesce(context, false) OR score > 0 ORDER BY coalesce(context, false) DESC, coalesce(score, 0) DESC, doc_id LIMIT 40
""")
def relevance_rank(t: Tables) -> DataFrame:
    """The documents as facts, those in English as context, held against one posting."""
    kind = F.when(F.col("lang") == "en", "education").otherwise("skill")
    facts = t.documents.select("doc_id", kind.alias("type"), F.col("text").alias("content"), F.col("source").alias("detail"))
    return catalogue.relevant_facts(facts, "doc_id", _POSTING).select("doc_id", "score")


@query("parse_dates", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS posted, CASE o_orderkey % 5 WHEN 4 THEN 'UNKNOWN' ELSE 'DATE_ONLY' END AS confidence FROM orders
""")
def parse_dates(t: Tables) -> DataFrame:
    forms = F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "MMMM d yyyy")], F.lit("soon"))
    raw = F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int"))
    got = dates.with_posted_at(t.orders.select("o_orderkey", "o_orderdate"), raw, F.lit(NOW).cast("timestamp"), "got")
    return got.select("o_orderkey", F.to_date("got.posted_at").cast("string").alias("posted"), "got.confidence")


@query("parse_relative", """
SELECT event_id, strftime(TIMESTAMP '2024-01-01' - to_minutes(CAST(CASE event_id % 4 WHEN 0 THEN event_id % 60 WHEN 1 THEN (event_id % 20) * 60 WHEN 2 THEN (event_id % 9) * 1440 ELSE (event_id % 5) * 43200 END AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at FROM events
""")
def parse_relative(t: Tables) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 4 == 0, F.concat(e % 60, F.lit(" minutes ago"))).when(e % 4 == 1, F.concat(F.lit("about "), e % 20, F.lit(" hrs ago"))).when(e % 4 == 2, F.concat(e % 9, F.lit("+ days ago"))).otherwise(F.concat(F.lit("Posted "), e % 5, F.lit(" months ago")))
    got = dates.with_posted_at(t.events.select("event_id"), said, F.lit(NOW).cast("timestamp"), "got")
    return got.select("event_id", F.date_format("got.posted_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("age_label", """
WITH a AS (SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-01-01') AS s FROM events), b AS (SELECT event_id, s, CASE WHEN s < 60 THEN NULL WHEN s < 3600 THEN s // 60 WHEN s < 86400 THEN s // 3600 WHEN s < 604800 THEN s // 86400 WHEN s < 2592000 THEN s // 604800 WHEN s < 31536000 THEN s // 2592000 ELSE s // 31536000 END AS n,
  CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 604800 THEN 'day' WHEN s < 2592000 THEN 'week' WHEN s < 31536000 THEN 'month' ELSE 'year' END AS u FROM a)
SELECT event_id, CASE WHEN n IS NULL THEN 'just now' ELSE n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM b
""")
def age_label(t: Tables) -> DataFrame:
    at = F.date_trunc("second", F.col("ts")).cast("timestamp")
    return t.events.select("event_id", dates.age_label(at, F.lit(NOW).cast("timestamp")).alias("age"))


@query("json_tolerant", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def json_tolerant(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return t.events.select("event_id", json.parsed(broken, "k int", "k")["k"].alias("k"))


@query("string_lists", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a|b' ELSE 'x|y z' END AS items FROM events")
def string_lists(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, '["a", " b", ""]').otherwise(" x ,, y z")
    return t.events.select("event_id", F.array_join(json.string_list(said), "|").alias("items"))


@query("json_ld", "SELECT page_id, 'T' || page_id AS title, CASE WHEN page_id % 3 = 1 THEN 'Org' END AS company, CASE WHEN page_id % 3 = 0 THEN 'Clifton, NJ' END AS location FROM pages WHERE page_id % 4 <> 3")
def json_ld(t: Tables) -> DataFrame:
    k = F.col("page_id")
    body = (
        F.when(k % 4 == 3, '{"@type": "JobPosting", "title": broken')
        .when(k % 3 == 0, F.concat(F.lit('{"@type": "JobPosting", "title": "T'), k, F.lit('", "jobLocation": {"address": {"addressLocality": "Clifton", "addressRegion": "NJ"}}}')))
        .when(k % 3 == 1, F.concat(F.lit('[{"@type": "WebSite"}, {"@type": "JobPosting", "title": "T'), k, F.lit('", "hiringOrganization": {"name": "Org"}}]')))
        .otherwise(F.concat(F.lit('{"@graph": [{"@type": "JobPosting", "title": "T'), k, F.lit('"}]}')))
    )
    html = F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"), F.coalesce("html", F.lit("")))
    return structured_postings(t.pages.select("page_id", html.alias("html"))).select("page_id", "title", "company", "location")


#: Pages by page_id % 10: what their JSON-LD is like, with {i} for the page, and the title, company and location that are found.
_LD_SHAPES = [
    ('[{"@type":"WebSite","name":"x"},{"@type":"JobPosting","title":" T{i} ","hiringOrganization":{"name":"Org"}}]', "T", "Org", None),
    ('{"@graph":[{"@type":"Thing","zone":{"@graph":[{"@type":["Thing","jobposting"],"title":"T{i}","hiringOrganization":"Own"}]}}]}', "T", "Own", None),
    ('{"a":{"b":{"c":{"d":{"e":{"@type":"JobPosting","title":"T{i}"}}}}}}', "T", None, None),
    ('{"a":{"b":{"c":{"d":{"e":{"f":{"@type":"JobPosting","title":"T{i}"}}}}}}}', None, None, None),
    ('{"@type":"JobPosting","title":"T{i}","jobLocation":[{"address":{"addressLocality":"Clifton","addressRegion":"NJ","addressCountry":7}},{"address":{"addressLocality":"Clifton","addressRegion":"NJ"}},{"addressLocality":"Rome"}]}', "T", None, "Clifton, NJ; Rome"),
    ('{"@type":"JobPosting","title":"T{i}"', None, None, None),
    ('{"zz":{"@type":"JobPosting","title":"no"},"@graph":{"x":[{"@type":"JobPosting","title":"T{i}"}]}}', "T", None, None),
    ('{&quot;@type&quot;:&quot;JobPosting&quot;,&quot;title&quot;:&quot;T{i}&quot;,&quot;hiringOrganization&quot;:[&quot;&quot;,&quot;Third&quot;]}', "T", "Third", None),
    ('"JobPosting"', None, None, None),
    ('{"@type":"JobPosting","title":5,"hiringOrganization":{"legal":"x"},"jobLocation":null,"mainEntity":{"@type":"JobPosting","title":"deeper"}}', "", None, None),
]
_LD_ROWS = ", ".join(f"({k}, {'NULL' if t is None else chr(39) + t + chr(39)}, {'NULL' if c is None else chr(39) + c + chr(39)}, {'NULL' if p is None else chr(39) + p + chr(39)})" for k, (_, t, c, p) in enumerate(_LD_SHAPES))


@query("json_ld_deep", f"""
WITH v(k, t, company, location) AS (VALUES {_LD_ROWS})
SELECT page_id, CASE WHEN t = 'T' THEN 'T' || page_id END AS title, company, location FROM pages JOIN v ON k = page_id % 10 WHERE t IS NOT NULL
""")
def json_ld_deep(t: Tables) -> DataFrame:
    """The first JobPosting of every page, nested up to five levels; each page has a malformed and a foreign script before it."""
    i = F.col("page_id").cast("string")
    shapes = F.array(*[F.replace(F.lit(shape), F.lit("{i}"), i) for shape, *_ in _LD_SHAPES])[(F.col("page_id") % 10).cast("int")]
    script = lambda body: F.concat(F.lit('<script id="a" type="application/ld+json">'), body, F.lit("</script>"))
    html = F.concat("html", script(F.lit('{"@type":')), script(F.lit('{"@type":"Organization","name":"x"}')), script(shapes), F.lit("<p>end</p>"))
    return found_postings(t.pages.select("page_id", html.alias("html")), "page_id", "html").select("page_id", "title", "company", "location")
