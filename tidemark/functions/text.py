"""Text as Column expressions: tokens, phrases, names, addresses, URLs and rise labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, pattern: str = "[a-z]+") -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def windows(words: Column, n: int) -> Column:
    """All runs of n neighbouring elements; none in shorter arrays."""
    starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i + n <= F.size(words))
    return F.transform(starts, lambda i: F.slice(words, i + 1, n))


def runs(words: Column) -> Column:
    """Every distinct run of neighbouring words, of any length, joined by blanks."""
    each = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.flatten(each))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks: the words zipped with themselves, shifted, in time in proportion to them."""
    out = words
    for k in range(1, n):  # the shorter array ends the pairs with nulls
        out = F.zip_with(out, F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


def gapped(words: Column, keep) -> Column:
    """The words with those that keep(word) refuses replaced by null, so that no phrase crosses them."""
    return F.transform(words, lambda w: F.when(keep(w), w))


def phrases(words: Column, *, stop: list[str], tail: list[str], min_word: int = 4, min_token: int = 2, most: int = 3) -> Column:
    """Distinct phrases of 1 to `most` words that a name supports.

    A single word has at least min_word letters and is neither a stop nor a tail word. Longer phrases don't cross removed words, don't
    begin with a tail word, aren't all tail words and hold a word of min_word letters.
    """
    stops, tails = F.array(*map(F.lit, stop)).cast("array<string>"), F.array(*map(F.lit, tail)).cast("array<string>")
    single = F.filter(words, lambda w: (F.length(w) >= min_word) & ~F.array_contains(stops, w) & ~F.array_contains(tails, w))
    line = gapped(words, lambda w: (F.length(w) >= min_token) & ~F.array_contains(stops, w))
    parts = [single]
    for n in range(2, most + 1):
        good = F.filter(
            windows(line, n),
            lambda p: F.forall(p, lambda w: w.isNotNull()) & ~F.array_contains(tails, F.coalesce(F.get(p, F.lit(0)), F.lit(""))) & F.exists(p, lambda w: F.length(w) >= min_word) & (F.size(F.array_except(p, tails)) > 0),
        )
        parts.append(F.transform(good, lambda p: F.array_join(p, " ")))
    return F.array_distinct(F.concat(*parts))


def has_phrase(words: Column, phrase: str) -> Column:
    """Whether the phrase's words stand side by side."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")


def key_pattern(key: str) -> str:
    """`stem*` matches from a word's beginning, any other key whole words."""
    body = re.escape(key.lower().removesuffix("*"))
    return rf"\b{body}" if key.endswith("*") else rf"\b{body}\b"


def classify(text: Column, taxonomy: list[tuple[str, list[str]]]) -> Column:
    """The class whose longest key the text holds; ties go to the class listed first. One expression, so no join is needed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    keys = sorted(((-len(k.removesuffix("*")), order, name, k) for order, (name, ks) in enumerate(taxonomy) for k in ks))
    found = F.lit(None).cast("string")
    for _, _, name, key in reversed(keys):
        found = F.when(low.rlike(key_pattern(key)), F.lit(name)).otherwise(found)
    return found


SUFFIX = r"\s+(limited|ltd|llp|plc|cic|lp|inc|company|co|uk)$"


def company_name(name: Column) -> Column:
    """Lower case, & as and, no marks, no leading the, up to three legal suffixes gone."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "&", " and ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]", " "), " +", " "))
    out = F.regexp_replace(out, "^the ", "")
    for _ in range(3):
        out = F.regexp_replace(out, SUFFIX, "")
    return F.nullif(F.trim(out), F.lit(""))


def address_key(postcode: Column, premises: Column, line: Column) -> Column:
    """POSTCODE|premises line; null if there is neither."""
    code = F.upper(F.regexp_replace(F.coalesce(postcode, F.lit("")), r"\s+", ""))
    street = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", premises, line)), "[^a-z0-9]+", " "))
    return F.when((code != "") | (street != ""), F.concat_ws("|", code, street))


def officer_key(name: Column, dob_year: Column, dob_month: Column) -> Column:
    """surname|first|yyyy-m, from "SURNAME, First" or "First Surname"; null without a date of birth."""
    low = F.lower(F.trim(name))
    comma = low.contains(",")
    words = F.split(low, r"\s+")
    surname = F.when(comma, F.trim(F.split_part(low, F.lit(","), F.lit(1)))).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.split_part(F.trim(F.split_part(low, F.lit(","), F.lit(2))), F.lit(" "), F.lit(1))).otherwise(F.element_at(words, 1))
    letters = lambda c: F.regexp_replace(c, "[^a-z]", "")
    return F.when(dob_year.isNotNull() & dob_month.isNotNull() & (letters(surname) != ""), F.concat(letters(surname), F.lit("|"), letters(first), F.lit("|"), dob_year.cast("string"), F.lit("-"), dob_month.cast("string")))


def postcode_area(postcode: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(postcode, F.lit("")), r"^\s*([A-Za-z]{1,2})\d", 1)), F.lit(""))


BREAKOUT = ["breakout", "ausbruch", "exponentiel", "aumento puntual"]


def rise_label(label: Column) -> tuple[Column, Column]:
    """(is_breakout, rise) of a label such as "Breakout" or "+4,500%"."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    digits = F.regexp_replace(low, "[^0-9.\\-]", "")
    is_breakout = low.isin(BREAKOUT)
    return is_breakout, F.when(~is_breakout, digits.try_cast("double"))


def domain(url: Column, junk: list[str]) -> Column:
    """Host without www. in lower case; null for junk hosts and their subdomains, or without a dot."""
    full = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.regexp_replace(F.lower(F.try_parse_url(F.trim(full), F.lit("HOST"))), "^www\\.", "")
    bad = F.lit(False)
    for j in junk:
        bad = bad | (host == j) | host.endswith("." + j)
    return F.when(host.contains(".") & ~bad, host)


def path_words(url: Column) -> Column:
    """Words of the URL's path, decoded, without file endings."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return tokens(F.regexp_replace(F.coalesce(F.try_url_decode(path), path), r"\.(html?|php|aspx?)$", ""), "[a-z0-9]+")


def padded(text: Column) -> Column:
    """Space-padded words in lower case, for containment tests."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def is_chemical(code: Column) -> Column:
    """Whether a code is that of a chemical: nine capitals and digits."""
    return F.coalesce(code.rlike("^[0-9A-Z]{9}$"), F.lit(False))


# Short words that name a service.
SHORT_TERMS = ["iv", "ed", "gp"]


def slug_tokens(slug: Column) -> Column:
    """Words of an address without its file ending: no numbers, and none of under three characters but SHORT_TERMS."""
    body = F.regexp_replace(F.lower(F.coalesce(slug, F.lit(""))), r"\.(html?|php|aspx?)$", "")
    return F.filter(F.split(body, "[^a-z0-9']+"), lambda w: ~w.rlike("^[0-9]*$") & ((F.length(w) >= 3) | w.isin(SHORT_TERMS)))


def slug_grams(words: Column, *, stop: list[str], head: list[str], most: int = 3, least: int = 4) -> Column:
    """Distinct runs of 1 to `most` words of at least `least` characters without a stop word, in which a word is no bare head-noun."""
    stops, heads = F.array(*map(F.lit, stop)).cast("array<string>"), F.array(*map(F.lit, head)).cast("array<string>")
    good = [F.filter(windows(words, n), lambda g: ~F.arrays_overlap(g, stops) & (F.size(F.array_except(g, heads)) > 0)) for n in range(1, most + 1)]
    terms = F.transform(F.concat(*good), lambda g: F.array_join(g, " "))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= least))


def clean_name(name: Column, noise: list[str], protect: list[str]) -> Column:
    """The name with noise words blanked, as it is where it has a protected phrase."""
    low = F.lower(F.coalesce(name, F.lit("")))
    kept = F.lit(False)
    for phrase in protect:
        kept = kept | low.contains(phrase)
    words = "|".join(re.escape(w) for w in sorted(noise))
    return F.when(kept, name).otherwise(F.regexp_replace(F.coalesce(name, F.lit("")), rf"(?i)\b({words})\b", " "))


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))


def brand_name(text: Column, brands: dict[str, str], term: Column) -> Column:
    """`Brand (substance)` of the first brand that the text names, else the term."""
    line, found = padded(text), capitalized(term)
    for brand, substance in reversed(brands.items()):
        found = F.when(line.contains(f" {brand} "), F.lit(f"{brand.capitalize()} ({substance})")).otherwise(found)
    return found


def other_words(words: Column, taken: Column) -> Column:
    """The words that are not taken, in order, each once."""
    return F.array_join(F.array_sort(F.array_except(words, taken)), " ")


def catalyst_reason(headline: Column, condition: Column, population: Column) -> Column:
    """The sentence of a licence: its headline, or that it is new, and whom it concerns."""
    lead = F.coalesce(F.regexp_replace(headline, r"[. ]+$", ""), F.concat(F.lit("Newly licensed for "), condition))
    return F.concat(lead, F.lit("; "), population, F.lit("."))


def skeletons(words: Column) -> Column:
    """The name with its first, and with its last, word as a slot: structs of skeleton and filler."""
    n = F.size(words)
    first = F.struct(F.array_join(F.concat(F.array(F.lit("*")), F.slice(words, 2, F.greatest(n - 1, F.lit(0)))), " ").alias("skeleton"), F.get(words, F.lit(0)).alias("filler"))
    last = F.struct(F.array_join(F.concat(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.array(F.lit("*"))), " ").alias("skeleton"), F.get(words, n - 1).alias("filler"))
    return F.when(n >= 2, F.array(first, last)).otherwise(F.array().cast("array<struct<skeleton:string,filler:string>>"))
