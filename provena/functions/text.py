"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain letters, in the same order.
MARKED = "àáâãäåāçćčèéêëēęìíîïīłñńòóôõöøōùúûüūýÿžźżšś"
PLAIN = "aaaaaaaccceeeeeeiiiiilnnooooooouuuuuyyzzzss"
#: Words that say nothing about a sentence's subject.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "we", "with")
#: Entities and their characters; the ampersand last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def fold(text: Column) -> Column:
    """Lower case, marks off Latin letters, everything else than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def skeleton(text: Column, keep_hyphens: bool = True) -> Column:
    """Lower case without white space, quotes and dashes of one kind; without hyphens if asked."""
    one = F.translate(F.lower(text), "‘’“”–—‐‑", "''\"\"----")
    return F.regexp_replace(one, r"[\s ­​]+" if keep_hyphens else r"[\s ­​-]+", "")


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def digest(text: Column) -> Column:
    """FNV-1a of the code points, 32 bits, in base 36."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    folded = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def decode_entities(text: Column) -> Column:
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def plain(html: Column, most: int = 320) -> Column:
    """Text of a feed's markup: tags off, entities decoded, white space one blank, cut with an ellipsis."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    text = F.trim(F.regexp_replace(decode_entities(bare), r"\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def referrer_host(url: Column, own: str = "") -> Column:
    """Host without www; one's own, and what isn't an address, is direct."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    return F.when((host == "") | host.isNull() | (host == own), F.lit("direct")).otherwise(host)


def terms(text: Column) -> Column:
    """Distinct words of three letters or more, stopwords left out, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS)))


def shorten(title: Column, most: int = 26) -> Column:
    """A title's head before its colon, if short enough, else cut."""
    head = F.trim(F.split_part(title, F.lit(":"), F.lit(1)))
    return F.when(F.length(head) <= most, head).otherwise(F.concat(F.rtrim(F.substring(head, 1, most - 1)), F.lit("…")))


def plausible_title(title: Column) -> Column:
    """At least 12 characters, at least half of them letters, not an address."""
    letters = F.length(F.regexp_replace(title, "[^A-Za-z]", ""))
    return (F.length(title) >= 12) & (letters * 2 >= F.length(title)) & ~title.rlike(r"(?i)https?:|www\.|doi\.org")


def visitor(day: Column, secret: str, address: Column, agent: Column) -> Column:
    """A mark that is the same for a visitor during one day only."""
    return F.substring(F.sha2(F.concat_ws(":", day, F.lit(secret), address, agent), 256), 1, 20)


def is_question(text: Column) -> Column:
    """A leading question word, a question mark at the end, or six words or more."""
    return text.rlike(r"(?i)^\s*(who|what|when|where|which|why|how)\b") | F.trim(text).endswith("?") | (F.size(F.split(F.trim(text), r"\s+")) >= 6)


def citation_key(name: Column, year: Column, title: Column) -> Column:
    """Surname, year and the first word of the title that isn't a stopword."""
    words = F.array_except(F.regexp_extract_all(F.lower(title), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, STOPWORDS)))
    return F.concat(F.regexp_replace(F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1)), "[^a-z0-9]", ""), year.cast("string"), F.coalesce(F.get(words, F.lit(0)), F.lit("")))
