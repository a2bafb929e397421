"""Text column expressions (regex and higher-order functions, all JVM-side).

Patterns are written so that Java regex (Spark) and RE2 (the DuckDB oracle)
agree on them: explicit characters and ranges, no look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probitas import rules as R

# ---------------------------------------------------------------------------
# Fixed values (patterns of the answer and text rules)
# ---------------------------------------------------------------------------
ANSWER_DELETE_CHARS = '.*"'          # removed from a response before tokenising
ANSWER_STRIP_CHARS = ",;:!?."        # stripped from both ends of the first token (pattern below)
NOTE_CUT = r"(?i)\bNote:\b"          # text from here on is commentary
MARKUP = r"[*_`]+"                   # emphasis marks
COMMENTARY_LINE = r"(?i)(translation|explanation|comment)"
CHATBOT_MARK = "<|CHATBOT_TOKEN|>"
END_MARKS = ["<|im_end|>\n<|endoftext|>", "<|im_end|><|endoftext|>"]
SPECIAL_TOKEN = r"<\|.*?\|>"
# quote styles for yes / no tokens: "x", «x», “x”, ‘x’, 'x'
QUOTED = "\"[^\"]+\"|«[^»]+»|“[^”]+”|‘[^’]+’|'[^']+'"
# white space as Python's str.split and str.strip know it
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LEADING_LABEL = f"^[A-Za-zÀ-ÖØ-öø-ÿ{WHITESPACE}]+:[{WHITESPACE}]*"  # "Translation: ", "Në shqip: "
FIRST_TOKEN = f"^[{WHITESPACE}]*([^{WHITESPACE}]+)"
NOT_BLANK = f"[^{WHITESPACE}]"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Strip leading / trailing whitespace (plain ``trim`` only removes blanks):
    ``trim`` with the explicit whitespace set -- linear in the stripped ends only."""
    return F.trim(_c(x), F.lit(WHITESPACE))


def first_token(x) -> Column:
    return F.regexp_extract(_c(x), FIRST_TOKEN, 1)


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda over one column):
    ``transform(array(value), body)[0]``. Keeps an expensive expression that
    ``body`` uses several times from being evaluated once per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_answer(response, yes, no) -> Column:
    """yes / no / undefined from a raw response (T1): lower-case, delete ``.*"``,
    take the first whitespace token, strip ``,;:!?.`` and compare with the
    language's yes and no tokens. Empty or missing -> undefined."""
    cleaned = F.translate(F.lower(_c(response)), ANSWER_DELETE_CHARS, "")
    strip = "[" + ANSWER_STRIP_CHARS + "]+"
    token = F.regexp_replace(first_token(cleaned), f"^{strip}|{strip}$", "")
    return let(token, lambda tok: F.when((tok != "") & (tok == F.lower(_c(yes))), F.lit(R.YES))
               .when((tok != "") & (tok == F.lower(_c(no))), F.lit(R.NO))
               .otherwise(F.lit(R.UNDEFINED)))


def clean_text(text) -> Column:
    """The translation inside a model reply (T2): cut at "Note:", drop emphasis
    marks and a leading label, split lines, drop commentary lines unless none is
    left, and return the longest line (the first one on a tie)."""
    t = strip_ws(F.coalesce(_c(text), F.lit("")))
    # the case-insensitive regex only runs on texts that contain the marker at all
    t = let(t, lambda s: F.when(F.lower(s).contains("note:"), F.split(s, NOTE_CUT, 2).getItem(0)).otherwise(s))
    t = F.regexp_replace(t, MARKUP, "")
    t = F.regexp_replace(t, LEADING_LABEL, "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda l: strip_ws(l)), lambda l: l != "")

    def longest(pool):
        return F.aggregate(pool, F.try_element_at(pool, F.lit(1)),
                           lambda acc, l: F.when(F.length(l) > F.length(acc), l).otherwise(acc))

    def choose(ls):
        kept = F.filter(ls, lambda l: ~l.rlike(COMMENTARY_LINE))
        pool = let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(ls))
        return F.when(F.size(ls) == 0, F.lit("")).otherwise(let(pool, longest))

    return let(lines, choose)


def extract_answer_text(text) -> Column:
    """Model output after the last chatbot marker, end marks and special tokens removed."""
    t = F.element_at(F.split(_c(text), r"<\|CHATBOT_TOKEN\|>"), -1)
    for m in END_MARKS:
        t = F.replace(t, F.lit(m), F.lit(""))
    t = F.regexp_replace(t, SPECIAL_TOKEN, "")
    return strip_ws(t)


def extract_quoted(text) -> Column:
    """All quoted tokens in order, delimiters cut and whitespace stripped (T4)."""
    hits = F.regexp_extract_all(_c(text), F.lit(f"({QUOTED})"), 1)
    return F.transform(hits, lambda h: strip_ws(h.substr(F.lit(2), F.length(h) - F.lit(2))))


def build_prompt(question, prompt) -> Column:
    """Question and answer instruction on two lines (T5)."""
    return F.concat_ws("\n", _c(question), _c(prompt))


def build_question(base_text, scenario, country, language) -> Column:
    """Question text of a unit before translation (T6): country scenario or English
    -> "In [the ]<country>, <text>"; language scenario -> text; language+country
    -> "In <country>, <text>". The base text is lower-cased first."""
    text = F.lower(_c(base_text))
    article = F.when(_c(country).isin(*R.COUNTRIES_WITH_ARTICLE), F.lit("the ")).otherwise(F.lit(""))
    s = _c(scenario)
    return (F.when((s == R.SCENARIO_COUNTRY) | (_c(language) == R.ENGLISH),
                   F.concat(F.lit("In "), article, _c(country), F.lit(", "), text))
            .when(s == R.SCENARIO_LANGUAGE, text)
            .otherwise(F.concat(F.lit("In "), _c(country), F.lit(", "), text)))


def remap_language_code(code, text) -> Column:
    """Target code of the machine-translation service (T7): pt -> PT-PT,
    en -> EN-GB, others upper-cased; Montenegrin or empty text -> ""."""
    c = _c(code)
    mapped = F.upper(F.when(c == "pt", F.lit("PT-PT")).when(c == "en", F.lit("EN-GB")).otherwise(c))
    return F.when((_c(text) == "") | (c == "cnr"), F.lit("")).otherwise(mapped)


def cosine_similarity(a, b) -> Column:
    """dot(a, b) / (|a| |b|) of two equal-length float arrays."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0),
                           lambda acc, t: acc + t)
    na, nb = F.sqrt(dot(_c(a), _c(a))), F.sqrt(dot(_c(b), _c(b)))
    return F.when((na > 0) & (nb > 0), dot(_c(a), _c(b)) / (na * nb))
