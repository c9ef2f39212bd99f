"""Text predicates and normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies. They are a declared choice, collected from common usage.
SECTIONS = {
    "EXPERIENCE": ("experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history", "career overview", "positions held", "professional background"),
    "EDUCATION": ("education", "academic background", "academics", "qualifications", "educational qualifications"),
    "PROJECTS": ("projects", "project experience", "key projects", "personal projects"),
    "SKILLS": ("skills", "technical skills", "core skills", "key skills", "competencies"),
    "PERSONAL": ("personal details", "personal information", "personal profile"),
    "SUMMARY": ("summary", "profile", "objective", "career objective", "professional summary"),
    "OTHER": ("certifications", "awards", "languages", "interests", "references", "publications", "achievements"),
}
COMPANY = r"pvt\.? ltd|ltd|inc|llc|llp|limited|corp(?:oration)?|technolog(?:ies|y)|solutions|systems|services|consulting|digital|labs|group|bank|infotech"
TITLES = r"engineer|developer|manager|analyst|consultant|architect|lead|director|officer|designer|administrator|intern|trainee|specialist|associate|scientist|teacher|accountant"
DEGREES = r"b\.?\s?tech|m\.?\s?tech|b\.?\s?e|b\.?\s?sc|m\.?\s?sc|b\.?\s?com|m\.?\s?com|mba|mca|bca|bachelor|master|ph\.?\s?d|diploma|degree|graduat(?:e|ed|ion)"
INTERNSHIPS = "intern|internship"
VERBS = r"developed|managed|designed|implemented|worked|led|created|built|responsible|maintained|supported|analy[sz]ed|tested|coordinated|delivered"
STOP = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "you", "our", "will", "have", "has", "in", "of", "to", "on", "at", "by", "an", "as", "is", "or", "be")
BULLETS = "•▪●○◦‣⁃∙■□▶►➢➤✓✔★☆"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once and once in the plan."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _has(text: Column, fragments: str) -> Column:
    # each fragment begins with a letter, which tells at most places that none begins there
    letters = "".join(sorted({f[0] for f in fragments.split("|")}))
    return text.rlike(rf"(?i)(?=[{letters}])(?<!\w)(?:{fragments})(?!\w)")


def normalise(text: Column) -> Column:
    """NUL-broken ligatures repaired to ti, bullets made one glyph, spaces collapsed."""
    t = F.regexp_replace(text, r"\x00", "ti")
    return F.trim(F.regexp_replace(F.translate(t, BULLETS, BULLETS[0] * len(BULLETS)), r"[ \t]+", " "))


def strip_leading_caps(text: Column) -> Column:
    """A leading run of two or more all-capital words goes if a capitalised word follows."""
    return F.regexp_replace(text, r"^(?:[A-Z]{2,}\s+){2,}(?=[A-Z][a-z])", "")


def clean_org(text: Column) -> Column:
    """An organisation's name: what stands before the first bar or dash between blanks, without marks and
    brackets at its ends; more than seven words are no name."""
    t = F.regexp_replace(F.trim(text), rf"^[:\[(\-–—\s|*{BULLETS}·]+", "")
    t = F.trim(F.element_at(F.split(t, r"\s+[—|]\s+"), 1))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[\])\s|.,;:\-]+$", ""), r"\s+", " "))
    return F.when(F.size(F.split(t, r"\s+")) > 7, "").otherwise(F.left(t, F.lit(120)))


def strip_project_prefix(text: Column) -> Column:
    """'Project 2 - Name' and 'POC 1: Name' to Name; a bare number stays as it is."""
    t = F.trim(F.regexp_replace(text, r"(?i)^\s*(?:project|poc)\s*[-#:]*\s*\d+\s*[:\-–.]?\s*", ""))
    return F.coalesce(F.nullif(t, F.lit("")), text)


def clean_text(text: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9À-ɏ\s]+", " "), r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    t = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def file_key(name: Column, extensions: int = 2) -> Column:
    """Comparable file name: slashes one way, lower case, up to so many extensions off."""
    t = F.lower(F.replace(name, F.lit("\\"), F.lit("/")))
    t = F.element_at(F.split(t, "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"(?:\.[a-z0-9]{{1,5}}){{1,{extensions}}}$", ""), r"[^a-z0-9]+", " "))


def company(text: Column) -> Column:
    t = clean_text(text)
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"(?<!\w)(?:{COMPANY})(?!\w)", " "), r"\s+", " "))


def title(text: Column) -> Column:
    """A job title to compare: lower case, marks to spaces, spaces collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def phone(text: Column) -> Column:
    """The last ten digits, if they begin with 6 to 9."""
    d = F.right(F.regexp_replace(text, r"\D", ""), F.lit(10))
    return F.when(d.rlike("^[6-9][0-9]{9}$"), d)


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower))


def links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)(?:https?://)?(?:www\.)?(?:linkedin\.com/in|github\.com)/[\w-]+"), F.lit(0)))


def url(text: Column) -> Column:
    """Scheme, www and trailing slashes off; lower case."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(t, r"^www\.", ""), r"/+$", "")


# Other spellings of skills.
SKILL_ALIASES = {
    "nodejs": "node.js", "node js": "node.js", "reactjs": "react", "react js": "react", "vuejs": "vue", "vue js": "vue", "nextjs": "next.js", "next js": "next.js",
    "restapi": "rest api", "rest apis": "rest api", "postgresql": "postgres", "postgressql": "postgres", "mongodb": "mongo", "k8s": "kubernetes", "gcp": "google cloud", "aws": "amazon web services",
}


def skill(text: Column) -> Column:
    """Lower case, other spellings replaced, a version number at the end off."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in SKILL_ALIASES.items() for x in pair))
    return F.regexp_replace(F.coalesce(F.try_element_at(known, t), t), r"\s+\d+(\.\d+)*$", "")


def skills(items: Column) -> Column:
    """Normalised skills without empty ones and repeats, in order of first mention."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), skill), lambda x: x != ""))


def vocabulary_hits(text: Column, words: list[str]) -> Column:
    """The words of a vocabulary that stand alone in text, + and # counting as letters."""
    low = F.lower(text)
    escape = lambda w: "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in w)
    return F.array_compact(F.array(*(F.when(low.rlike(rf"(?<![a-z0-9+#]){escape(w)}(?![a-z0-9+#])"), F.lit(w)) for w in words)))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9+#./]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP))


def years_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0)))


def outer_json(text: Column) -> Column:
    """The outermost object of an answer, code fences or not."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def occurrences(text: Column, needle: Column) -> Column:
    return F.when(needle == "", 0).otherwise((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def header_kind(line: Column) -> Column:
    """Section kind of a header line, else null: known wording or pattern, none of more than three words."""
    journey = r"(?:professional|work|career|chronological)\s+(?:experience|history|timeline|journey)"
    names = [n for some in SECTIONS.values() for n in some]

    def of(t: Column) -> Column:
        out = F.when(t.rlike(f"^{journey}$"), "EXPERIENCE")
        for kind, some in reversed(SECTIONS.items()):
            out = F.when(t.rlike(f"^(?:{'|'.join(some)})$"), kind).otherwise(out)
        return out

    # one search tells most lines, which are no headers; changing the case of a line takes longer
    may_be = rf"(?iu)^(?:{'|'.join(names)}|{journey})$"
    stripped = F.trim(F.regexp_replace(line, r"^[\s#*:\d.)(-]+|[\s#*:.-]+$", ""))
    return let(stripped, lambda t: F.when(t.rlike(may_be), let(F.lower(t), of)))


def is_bullet(text: Column) -> Column:
    return F.trim(text).rlike(rf"^[{BULLETS}*\-–]\s*\S") | is_description(text)


def is_description(text: Column) -> Column:
    return F.trim(text).rlike(rf"(?i)^(?:[{BULLETS}*\-–]\s*)?(?:{VERBS})\b")


def is_personal(text: Column) -> Column:
    return _has(text, r"date of birth|d\.?o\.?b|father'?s name|marital status|nationality|gender|passport")


def is_company(text: Column) -> Column:
    return _has(text, COMPANY)


def is_title(text: Column) -> Column:
    return _has(text, TITLES)


def is_degree(text: Column) -> Column:
    return _has(text, DEGREES)


def is_fragment(text: Column) -> Column:
    """Part of a sentence: starts with a lower-case letter, a mark or a joining word, or is long and mostly lower case."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    long = (F.size(F.split(t, r"\s+")) > 12) & (F.size(words) > 0) & (capital < 0.4 * F.size(words))
    return (t != "") & (t.rlike(r"^[\p{Ll},.;:-]") | t.rlike(r"(?i)^(?:and|with|or|in|at|for)(?:\s|$)") | long)


def is_heading(line: Column) -> Column:
    """3 to 50 characters, six words at most, no digits, all upper case or every word capitalised."""
    t = F.trim(line)
    return F.length(t).between(3, 50) & (F.size(F.split(t, r"\s+")) <= 6) & ~t.rlike("[0-9]") & (((t == F.upper(t)) & t.rlike("[A-Z]")) | t.rlike(r"^(?:[A-Z][a-z]*[:.]?(?:\s+|$))+$"))


def is_profile_page(url_: Column, text: Column) -> Column:
    return F.lower(url_).rlike(r"resume|curriculum|/cv(?:[/.?]|$)|profile") | F.lower(text).rlike(r"\b(?:curriculum vitae|work experience|resume)\b")


def source_variants_found(text: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: F.lower(text).contains(F.lower(v)))


_HIDDEN = r"(?is)<([a-z][a-z0-9]*)\b[^>]*\shidden\b[^>]*>"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def without_hidden(html: Column) -> Column:
    """Without the elements marked hidden: each goes up to the tag that closes it, elements of its name inside it
    counted. One that is never closed goes on to the end; a void one is only its tag."""
    tokens = F.regexp_extract_all(html, F.lit(r"(?s)(<[^>]*>|[^<]+|<)"), F.lit(1))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    zero = F.from_json(F.lit('{"at":0,"tag":"","depth":0,"from":0,"kept":[]}'), "struct<at:int,tag:string,depth:int,from:int,kept:array<struct<s:int,e:int>>>")

    def step(a: Column, t: Column) -> Column:
        end = a["at"] + F.length(t)
        inside = a["tag"] != ""
        same = t.startswith("<") & (name(t) == a["tag"])
        hides = ~inside & t.rlike(_HIDDEN)
        void = hides & name(t).isin(*_VOID)
        depth = F.when(inside, a["depth"] + F.when(~same, 0).when(t.startswith("</"), -1).otherwise(1)).otherwise(F.when(hides & ~void, 1).otherwise(0))
        tag = F.when(depth == 0, "").when(hides, name(t)).otherwise(a["tag"])
        shows = (inside & (depth == 0)) | void  # what follows is visible again
        kept = F.when(hides, F.concat(a["kept"], F.array(F.struct(a["from"].alias("s"), a["at"].alias("e"))))).otherwise(a["kept"])
        return F.struct(end.alias("at"), tag.alias("tag"), depth.alias("depth"), F.when(shows, end).otherwise(a["from"]).alias("from"), kept.alias("kept"))

    def finish(a: Column) -> Column:
        last = F.when(a["tag"] == "", F.array(F.struct(a["from"].alias("s"), a["at"].alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        return F.array_join(F.transform(F.concat(a["kept"], last), lambda x: F.substring(html, x["s"] + 1, x["e"] - x["s"])), "")

    return F.when(html.rlike(_HIDDEN), F.aggregate(tokens, zero, step, finish)).otherwise(html)


def visible_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and elements marked hidden out, a newline at each block end, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|head)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = let(t, without_hidden)
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/section|/article|/table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))
