"""Text classification and similarity (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies of the classifiers.
INTERN = r"(?i)\bintern(ship)?s?\b"
CO_OP = r"(?i)\bco-?ops?\b|\bcooperative education\b"
TRAINEE = r"(?i)\bstudent\s+(trainee|worker|engineer|researcher|assistant|associate)\b"
APPRENTICE = r"(?i)\bapprentice(ship)?s?\b"
SUMMER_ROLE = r"(?i)\bsummer\s+(analyst|associate|scholar|fellow)\b"
CAMPUS_PROGRAM = r"(?i)\b(campus|university|college)\s+(hire|program|recruiting|graduate)\b"
STUDENT_CONTEXT = (
    r"(?i)\b(undergraduate|undergrad|current(ly)?\s+enrolled|pursuing\s+a?\s*(bachelor|master|b\.?s\.?|m\.?s\.?)|"
    r"rising\s+(junior|senior|sophomore)|degree\s+in\s+progress|expected\s+graduation|class\s+of\s+20\d\d|student)\b"
)
SENIOR_TITLE = (
    r"(?i)\b(senior|sr\.?|staff|principal|lead|manager|director|head\s+of|vp|vice\s+president|chief|architect|fellow\s+engineer|distinguished)\b"
)
LEVELED_TITLE = r"(?i)\b(ii|iii|iv|v|2|3|4|5)\b\s*$"
EXPERIENCE = r"(?i)\b(\d{1,2})\+?\s*(\+|or\s+more)?\s*years?(\s+of)?\s+(relevant\s+|professional\s+|industry\s+)?experience\b"
FULL_TIME = r"(?i)\b(full[\s-]?time|permanent|regular\s+full)\b"
INTERN_TYPE = r"(?i)\b(intern(ship)?|co-?op|temporary|seasonal|part[\s-]?time\s+student)\b"
CLOSED = (
    r"(?i)\b(no longer accepting|position (has been )?filled|posting closed|this (job|role|posting) is closed|applications are closed)\b"
)
#: Words of facts and postings, those that never count, and the kinds of facts that are always kept.
MATCH_WORD = r"[a-z0-9][a-z0-9+.#-]{1,}"
MATCH_STOP_WORDS = (
    "and", "are", "for", "from", "have", "intern", "internship", "job", "our",
    "that", "the", "this", "with", "will", "you", "your",
)
CONTEXT_FACTS = ("education", "gpa", "graduationDate", "experience", "project", "activity")
#: The closing notices of whole pages, as patterns of ECMAScript.
CLOSED_NOTICES = (
    r"\bthis\s+(?:job|position|posting|requisition)\s+(?:is|has been)\s+(?:closed|filled|expired|removed|cancelled|canceled|no longer available)\b",
    r"\bthe\s+(?:job|position|posting|requisition)\s+(?:is|has been)\s+(?:closed|filled|expired|removed|cancelled|canceled|no longer available)\b",
    r"\bjob\s+posting\s+(?:has\s+)?expired\b",
    r"\bposition\s+has\s+been\s+filled\b",
    r"\bjob\s+is\s+no\s+longer\s+available\b",
    r"\bwe(?:'|’)re\s+sorry[^.]{0,120}\b(?:job|position)\b[^.]{0,120}\bno\s+longer\s+available\b",
)
STUDENT_ROLE = r"(?i)\b(intern(ship)?s?|co-?ops?|undergrad(uate)?)\b"
CLEARANCE = (
    "u.s. citizen", "us citizen", "united states citizen", "security clearance", "secret clearance", "top secret", "itar",
    "export control", "export-controlled",
)
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "icloud.com")
FRAUD = {
    "requests-payment": r"(?i)\b(application fee|processing fee|registration fee|pay (a |an )?(fee|deposit)|purchase (a |your )?(laptop|equipment|starter kit)|wire transfer|western union|moneygram)\b",
    "requests-cryptocurrency": r"(?i)\b(bitcoin|cryptocurrency|crypto wallet|usdt|ethereum payment)\b",
    "requests-gift-cards": r"(?i)\bgift cards?\b",
    "requests-banking-info": r"(?i)\b(bank account number|routing number|direct deposit (details|information) before)\b",
    "requests-government-id": r"(?i)\b(social security number|\bssn\b|passport number|driver'?s licen[sc]e number)\b",
    "unusual-contact-channel": r"(?i)\b(contact (us |me )?(on |via )?(telegram|whatsapp))\b",
    "executable-download": r"(?i)https?://\S+\.(exe|scr|bat|msi|jar)\b",
}
CONTACT_EMAIL = (
    r"(?i)\b(?:contact|email|reach (?:us|out|me)|send (?:your )?(?:resume|application|cv) to)\b[^.\n]{0,60}?"
    r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def experience_years(text: Column) -> Column:
    """The first number of years of experience that a text asks for."""
    return F.nullif(F.regexp_extract(text, EXPERIENCE, 1), F.lit("")).cast("int")


def classify_internship(title: Column, description: Column, kind: Column, closed: Column) -> Column:
    """QUALIFYING_INTERNSHIP, UNCERTAIN_CLASSIFICATION, NOT_AN_INTERNSHIP, CONFIRMED_CLOSED or PARSE_FAILED."""
    t, d, k = _text(title), _text(description), _text(kind)
    says_student = d.rlike(STUDENT_CONTEXT) | d.rlike(INTERN) | d.rlike(CO_OP)
    by_title = t.rlike(INTERN) | t.rlike(CO_OP) | t.rlike(TRAINEE) | t.rlike(APPRENTICE)
    seasonal = t.rlike(SUMMER_ROLE) | t.rlike(CAMPUS_PROGRAM)
    senior = (F.coalesce(experience_years(d), F.lit(0)) >= 3) | t.rlike(SENIOR_TITLE) | t.rlike(LEVELED_TITLE) | k.rlike(FULL_TIME)
    return (
        F.when(t == "", "PARSE_FAILED")
        .when(F.coalesce(closed, F.lit(False)) | d.rlike(CLOSED), "CONFIRMED_CLOSED")
        .when(by_title | (k.rlike(INTERN_TYPE) & ~k.rlike(FULL_TIME)), "QUALIFYING_INTERNSHIP")
        .when(seasonal & says_student, "QUALIFYING_INTERNSHIP")
        .when(seasonal, "UNCERTAIN_CLASSIFICATION")
        .when(senior, "NOT_AN_INTERNSHIP")
        .when(says_student, "UNCERTAIN_CLASSIFICATION")
        .otherwise("NOT_AN_INTERNSHIP")
    )


def any_word(low: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a text has one of the words; those that have another one inside say nothing more."""
    found = F.lit(False)
    for w in words:
        if not any(v != w and v in w for v in words):
            found = found | low.contains(w)
    return found


def any_keyword(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return any_word(F.lower(text), words)


def with_tags(rows: DataFrame, text: Column, vocabulary: dict[str, list[str]], name: str) -> DataFrame:
    """``rows`` with the vocabulary's tags, in its order, of which the text has a keyword.

    The text is made and lowered in a projection of its own, once a row: within one
    expression it would be again for every keyword.
    """
    low = "_low"
    while low in rows.columns:
        low += "_"
    found = F.array_compact(F.array(*[F.when(any_word(F.col(low), words), tag) for tag, words in vocabulary.items()]))
    return rows.withColumn(low, F.lower(text)).withColumn(name, found).drop(low)


def season(term: Column) -> Column:
    low, found = F.lower(term), None
    for name in ("Summer", "Fall", "Spring", "Winter"):
        found = (F if found is None else found).when(low.contains(name.lower()), name)
    return found.otherwise("Unknown")


def sophomore_eligible(text: Column) -> Column:
    """True, false, or null where the text doesn't say."""
    low = F.lower(text)
    barred = low.rlike(r"\b(junior|rising junior)s?\s+(and|or)\s+seniors?\s+only\b") | low.rlike(r"\bmust be a (rising )?(junior|senior)\b") | low.contains("juniors and seniors only")
    return F.when(low.contains("sophomore"), True).when(barred, False)


def graduation_years(text: Column) -> Column:
    """Years 2024 to 2032 named as a class or a graduation, ascending."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)class of (20\d{2})"), 1), F.regexp_extract_all(text, F.lit(r"(?i)graduat\w*\s+(?:in\s+)?(20\d{2})"), 1))
    years = F.transform(found, lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(2024, 2032))))


def sponsorship(answer: Column) -> Column:
    low = F.lower(F.trim(answer))
    return F.when(low == "yes", "Yes").when(low == "no", "No").when(low.contains("not sure"), "NotSure").otherwise("Unknown")


def needs_clearance(text: Column) -> Column:
    return any_keyword(text, CLEARANCE)


def compensation(text: Column) -> Column:
    """Struct of the two ends of a range such as ``$20 - $30.5``; nulls if there is none."""
    pattern = r"\$?([\d.]+)\s*-\s*\$?([\d.]+)"
    low, high = (F.regexp_extract(text, pattern, g).try_cast("double") for g in (1, 2))
    usable = low.isNotNull() & high.isNotNull() & (F.upper(F.trim(text)) != "N/A")
    return F.struct(F.when(usable, low).alias("min"), F.when(usable, high).alias("max"))


def personal_emails(text: Column) -> Column:
    """Personal addresses that a text tells readers to write to."""
    found = F.regexp_extract_all(text, F.lit(CONTACT_EMAIL), 1)
    return F.filter(found, lambda e: F.lower(F.split(e, "@")[1]).isin(*PERSONAL_DOMAINS))


def fraud_signals(text: Column) -> Column:
    """Reasons for suspicion, in their fixed order."""
    found = [F.when(text.rlike(p), reason) for reason, p in FRAUD.items()]
    return F.array_compact(F.array(*found, F.when(F.size(personal_emails(text)) > 0, "personal-email-contact")))


def java_pattern(pattern: str) -> str:
    """A case-blind ECMAScript pattern as one of Java.

    ``\\s`` has ECMAScript's blanks, and ``\\b`` stands between ASCII letters, digits
    and underscores and anything else, as Java's differ in both.
    """
    blanks = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return "(?i)" + pattern.replace(r"\s", blanks).replace(r"\b", edge)


def looks_closed(html: Column) -> Column:
    """Whether a page, read to its end, has one of the closing notices."""
    found = F.lit(False)
    for notice in map(java_pattern, CLOSED_NOTICES):
        found = found | html.rlike(notice)
    return found


def normalized(text: Column) -> Column:
    """Lower-case words without seasons and the years of the 2020s."""
    bare = F.regexp_replace(F.lower(text), r"\b(202[0-9]|summer|spring|fall|winter)\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def token_set(text: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda t: F.length(t) >= least))


def token_similarity(left: Column, right: Column) -> Column:
    """Shared tokens over the larger token set; 1 for equal texts, 0 without tokens."""
    a, b = token_set(left), token_set(right)
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return F.when((normalized(left) != "") & (normalized(left) == normalized(right)), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared)


def state_code(location: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(location, r"(?i)(?:,|\s)\s*([A-Z]{2})(?:\b|$)", 1)), F.lit(""))


def posting_match(title: Column, location: Column, other_title: Column, other_location: Column, other_direct: Column) -> Column:
    """How well two postings agree, 0 to 1; conflicting states and aggregator links give 0."""
    base = token_similarity(title, other_title)
    a, b = state_code(location), state_code(other_location)
    p, q = normalized(F.coalesce(location, F.lit(""))), normalized(F.coalesce(other_location, F.lit("")))
    near = (p != "") & (q != "") & (p.contains(q) | q.contains(p))
    bonus = F.when(a == b, 0.08).otherwise(0.0) + F.when(near, 0.05).otherwise(0.0)
    return F.when(~other_direct | (base < 0.55) | F.coalesce(a != b, F.lit(False)), 0.0).otherwise(F.least(F.lit(1.0), base + bonus))


def name_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of the names' tokens of three letters or more."""
    tokens = [F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) >= 3)) for c in (left, right)]
    union = F.size(F.array_union(*tokens))
    return F.when(union > 0, F.size(F.array_intersect(*tokens)) / union).otherwise(0.0)


def match_tokens(text: Column) -> Column:
    """The distinct words that count when a fact is held against a posting, such as ``c++`` or ``node.js``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(MATCH_WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*MATCH_STOP_WORDS)))


def relevance(text: Column, tokens: Column) -> Column:
    """Sum over the posting's tokens that the text has: 2 for tokens of six letters or more, else 1."""
    have = F.array_intersect(match_tokens(F.coalesce(text, F.lit(""))), tokens)
    return F.aggregate(have, F.lit(0), lambda s, w: s + F.when(F.length(w) >= 6, 2).otherwise(1))


def html_text(html: Column) -> Column:
    """Visible text: no scripts, styles or tags, common entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"']"), 1)


def strip_repeated_prefixes(text: Column) -> Column:
    """Drops leading ``CODE: `` marks while some lower-case text is left."""
    return F.regexp_replace(text, r"^([A-Z][A-Z0-9_]{2,}:\s+)+(?=.*[a-z])", "")


def take_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")
