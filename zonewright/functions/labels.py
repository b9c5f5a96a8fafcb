"""Column functions over domain names and labels; all stay inside the JVM for ASCII names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike characters and the letters they stand for (ASCII part).
LOOKALIKES = ("0134578@$", "oleastbas")
# Second-level labels under two-letter endings that count as part of the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def round4(x: Column) -> Column:
    """Half up to four digits, by plain double arithmetic so that any engine agrees."""
    return F.floor(x * 10000.0 + 0.5) / 10000.0


def once(value: Column, use) -> Column:
    """use(value), with value computed once: Spark would else repeat its expression wherever it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the alphanumeric words, each padded with two blanks before and one after.

    The padded words stand in one text; of its windows only those between two words end with two blanks.
    """
    return once(padded(x), padded_trigrams)


def padded(x: Column) -> Column:
    """The padded words of trigrams()."""
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(x), "[^a-z0-9]+", "   "), F.lit(" "))


def padded_trigrams(w: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))
    return F.array_distinct(F.filter(windows, lambda g: ~F.endswith(g, F.lit("  "))))


def padded_count(w: Column) -> Column:
    """How many trigrams padded words have: of one word without a repeat they are all its windows, and none is made."""
    return F.when(F.contains(w, F.lit("   ")) | F.rlike(w, F.lit(r"(?=(...)).+\1")), F.size(padded_trigrams(w))).otherwise(F.length(w) - 2)


def padded_shared(w: Column, grams: Column) -> Column:
    """How many of a set of trigrams padded words have: those that their text holds."""
    return F.size(F.filter(grams, lambda g: F.contains(w, g)))


def counted_similarity(both: Column, x: Column, y: Column) -> Column:
    """Jaccard similarity of sets of x and y, of which both have so many; 0 where both are empty."""
    return F.when(x + y == 0, F.lit(0.0)).otherwise(both / (x + y - both))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigram sets; 0 where both are empty."""
    return once(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), lambda g: set_similarity(g["x"], g["y"]))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 where both are empty."""
    sizes = F.struct(F.size(F.array_intersect(x, y)).alias("both"), (F.size(x) + F.size(y)).alias("all"))
    return once(sizes, lambda n: F.when(n["all"] == 0, F.lit(0.0)).otherwise(n["both"] / (n["all"] - n["both"])))


def trigrams_of(text: str) -> list[str]:
    """The same set for one text at hand."""
    words = (f"  {w} " for w in re.findall("[a-z0-9]+", text.lower()))
    return list(dict.fromkeys(w[i : i + 3] for w in words for i in range(len(w) - 2)))


def trigram_similarity_to(x: Column, text: str) -> Column:
    """trigram_similarity with one text, whose set is a constant."""
    grams = trigrams_of(text)
    held = F.array(*map(F.lit, grams)).cast("array<string>")
    sizes = once(trigrams(x), lambda g: F.struct(F.size(F.array_intersect(g, held)).alias("both"), F.size(g).alias("n")))
    return once(sizes, lambda s: F.when(s["n"] + len(grams) == 0, F.lit(0.0)).otherwise(s["both"] / (s["n"] + len(grams) - s["both"])))


def trigram_threshold(label: Column) -> Column:
    n = F.length(label)
    return F.when(n <= 5, 0.55).when(n <= 8, 0.45).otherwise(0.35)


def extract_label(name: Column, tld: Column) -> Column:
    """The name without `.tld`; else without its last component; else whole."""
    return F.when(F.endswith(name, F.concat(F.lit("."), tld)), F.substr(name, F.lit(1), F.length(name) - F.length(tld) - 1)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def left_of_tld(name: Column, tld: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(tld) - 1)


def normalize_domain(raw: Column) -> Column:
    """Trimmed, lower-cased, without outer dots; null where that is no ASCII host name."""
    x = F.btrim(F.lower(F.trim(raw)), F.lit("."))
    ok = (F.length(x) <= 253) & x.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$")
    return F.when(ok, x)


def public_suffix(name: Column) -> Column:
    p = F.split(name, r"\.")
    n = F.size(p)
    two = (n >= 3) & (F.length(F.element_at(p, -1)) == 2) & F.try_element_at(p, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(two, F.substring_index(name, ".", -2)).when(n >= 2, F.substring_index(name, ".", -1))


def registrable_domain(name: Column) -> Column:
    return F.when(F.contains(public_suffix(name), F.lit(".")), F.substring_index(name, ".", -3)).when(public_suffix(name).isNotNull(), F.substring_index(name, ".", -2))


def registrable_label(name: Column) -> Column:
    return F.substring_index(registrable_domain(name), ".", 1)


def hostname_stem(name: Column) -> Column:
    s = public_suffix(name)
    return F.when(F.contains(s, F.lit(".")), F.concat_ws(".", registrable_label(name), F.substring_index(s, ".", 1)))


def brand_text(x: Column) -> Column:
    """Only the letters a-z and digits of ASCII brand text."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def registrant_id(x: Column) -> Column:
    return F.regexp_replace(x, r"[.\-/\s]", "")


def unmasked(x: Column) -> Column:
    """ASCII look-alike characters replaced by the letters they stand for."""
    return F.translate(F.lower(x), *LOOKALIKES)


def closeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def normalized_levenshtein(label: Column, brand: Column) -> Column:
    return F.greatest(closeness(label, brand), closeness(unmasked(label), unmasked(brand)))


def brand_boundary(label: Column, brand: Column) -> Column:
    """brand occurs in label with something else than a letter on one side at least."""
    quoted = F.concat(F.lit("\\Q"), brand, F.lit("\\E"))
    # A pattern is made for a label that holds the brand alone.
    return F.when(F.length(brand) == 0, F.lit(False)).otherwise(F.contains(label, brand) & F.regexp_like(label, F.concat(F.lit(r"(?<!\p{L})"), quoted, F.lit("|"), quoted, F.lit(r"(?!\p{L})"))))


def residual(label: Column, brand: Column) -> Column:
    return F.when(F.length(brand) == 0, label).otherwise(F.replace(label, brand, F.lit(" ")))


def residual_tokens(label: Column, brand: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(residual(label, brand), F.lit("[a-z0-9]+"), F.lit(0))))


def keyword_hits(label: Column, brand: Column, keywords: Column) -> Column:
    """How many keywords are a token left beside the brand, or part of it when longer than four letters."""
    return F.when(F.size(keywords) == 0, 0).otherwise(tidy_keyword_hits(label, brand, tidy_keywords(keywords)))


def tidy_keywords(keywords: Column) -> Column:
    """In lower case without outer blanks."""
    return F.transform(keywords, lambda k: F.trim(F.lower(k)))


def tidy_keyword_hits(label: Column, brand: Column, keys: Column) -> Column:
    """keyword_hits of tidy_keywords."""
    # A keyword that is a token is in the text too. Few are, and tokens are cut for their texts alone, and once for all of them.
    likely = lambda x: F.filter(keys, lambda k: (F.length(k) > 0) & F.contains(x, k))
    cut = lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))
    found = lambda x, ks: once(cut(x), lambda tokens: F.size(F.filter(ks, lambda k: (F.length(k) > 4) | F.array_contains(tokens, k))))
    none = (F.size(keys) == 0) | ~F.exists(keys, lambda k: (F.length(k) > 0) & F.contains(residual(label, brand), k))
    return F.when(none, 0).otherwise(once(residual(label, brand), lambda x: once(likely(x), lambda ks: F.when(F.size(ks) == 0, 0).otherwise(found(x, ks)))))


def stable_shard(x: Column, n: int) -> Column:
    return (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % n).cast("int")


def date_int(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def int_date(x: Column) -> Column:
    return F.try_to_timestamp(x.cast("string"), F.lit("yyyyMMdd")).cast("date")


def age_days(day: Column, as_of: Column) -> Column:
    """Whole days since an int day, 0 at least; 999 where there is none."""
    return F.coalesce(F.greatest(F.datediff(as_of, int_date(day)), F.lit(0)), F.lit(999))
