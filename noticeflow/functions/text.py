"""Text expressions.  Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that grouping ignores.
LEGAL_SUFFIX = r"(?i)\b(?:LLC|INC\.?|CORP\.?|CO\.?|LTD\.?|LP|LLP|INCORPORATED|COMPANY)\b"
#: Words that carry no identity.
STOP_WORDS = ["the", "and", "or", "of", "in", "at", "to", "a", "an", "for", "tn"]
SPACES = r"(?U)\s+"


#: The characters that count as white space at the ends of a text.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """Text without white space at its ends, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def best_str(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def clean_str(c: Column, limit: int = 500) -> Column:
    """White space collapsed, cut to `limit` characters, blank becomes null."""
    return F.nullif(F.left(F.trim(F.regexp_replace(c, SPACES, " ")), F.lit(limit)), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower-cased, other characters than letters, digits and space become a space, collapsed."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def slugify(c: Column) -> Column:
    """Runs of other characters than [a-z0-9] become one hyphen; nothing left gives 'unknown'."""
    joined = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(joined, F.lit("-")), F.lit("")), F.lit("unknown"))


def ticket_key(c: Column) -> Column:
    return F.upper(strip(c))


def safe_file_key(c: Column) -> Column:
    return F.translate(ticket_key(c), "/\\:", "___")


def valid_ticket_number(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"(?i)^(\d{10,}|TN\d{8}-\d{6})$"), F.lit(False))


def looks_cancelled(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("cancel") | low.contains("void")


def normalize_company(c: Column) -> Column:
    """A company name without legal suffixes, upper-cased; null when nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, LEGAL_SUFFIX, ""), SPACES, " ")
    return F.nullif(F.upper(F.btrim(bare, F.lit(" .,;:-"))), F.lit(""))


def tokens(*cols: Column) -> Column:
    """Distinct words of the joined texts without stop words, in order of appearance."""
    joined = F.lower(F.concat_ws(" ", *cols))
    return F.array_except(F.array_distinct(F.regexp_extract_all(joined, F.lit("[a-z0-9]+"), 0)), F.array(*map(F.lit, STOP_WORDS)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; two empty sets are alike (1.0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def once(value: Column, then) -> Column:
    """What `then` makes of a value that it reads time and again: the value is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def first_seen_distinct(items: Column, ignore_case: bool = False) -> Column:
    """Distinct items in order of first appearance; case may be ignored, the first spelling stays."""
    if not ignore_case:
        return F.array_distinct(items)
    return F.aggregate(
        items,
        F.slice(items, 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)),
    )


def fallback_label(group: Column, company: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), F.nullif(company, F.lit("")), F.lit("Unassigned"))


def html_escape(c: Column) -> Column:
    out = c
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def nl2br(c: Column) -> Column:
    return F.replace(html_escape(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("<br>"))


def sha256_text(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def subject_line(n: Column, lead_days: int) -> Column:
    noun = F.when(n == 1, "ticket").otherwise("tickets")
    return F.concat(F.lit("Reminder: "), n.cast("string"), F.lit(" relevant "), noun, F.lit(f" expire in {lead_days} days"))


def group_key(company: Column, work: Column, county: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of COMPANY|WORK|COUNTY."""
    upper = lambda c, default: F.upper(strip(F.coalesce(c, F.lit(default))))
    return F.left(F.sha2(F.concat_ws("|", upper(company, "UNKNOWN"), upper(work, ""), upper(county, "")), 256), F.lit(16))


def natural_sort_key(c: Column) -> Column:
    """Text whose digit runs are padded to 18 places, so that plain order is numeric-aware."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # 17 zeros before each run; then of longer runs the first 18 digits stay, of others the last 18
    more = F.regexp_replace(low, r"\d+", "0" * 17 + "$0")
    return F.regexp_replace(more, r"0{17}(\d{18})\d+|\d{0,17}(\d{18})(?!\d)", "$1$2")
