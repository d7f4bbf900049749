"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHARS = {
    "\xa0": " ", "&nbsp;": " ", " ": " ", "‘": "'", "’": "'", "“": '"', "”": '"',
    "‑": "-", "–": "-", "&ndash;": "-", "—": "--", "&mdash;": "--", "\xad": "",
}

IRREGULAR_PLURALS = {
    "annex": "annexes", "appendix": "appendices", "ccl_category": "ccl_categories", "index": "indices", "datum": "data", "addendum": "addenda",
    "erratum": "errata", "analysis": "analyses", "memorandum": "memoranda", "basis": "bases", "thesis": "theses",
}

_SURROUNDED = r"""(?s)^\s*(?:"(.*)"|'(.*)'|\*+(.*?)\*+|_+(.*?)_+)\s*$"""


# characters whose capital is several characters, such as ß
_LONGER = "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if len(c.upper()) > 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def upper(c: Column) -> Column:
    """Capitals, one for one: characters whose capital would be several, such as
    ß, stay, so that lower case gives them back."""
    parts = F.split(c, f"(?<=[{_LONGER}])|(?=[{_LONGER}])", -1)
    apart = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^[{_LONGER}]"), x).otherwise(F.upper(x))), "")
    return F.when(c.rlike(f"[{_LONGER}]"), apart).otherwise(F.upper(c))


def clean_text(c: Column) -> Column:
    """Plain quotes, dashes and spaces; single line breaks, none at the ends."""
    for old, new in _CHARS.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "\n\t+ *", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n+", "\n"), "^\n|\n$", "")


def clean_summary_text(c: Column) -> Column:
    return strip(F.regexp_replace(clean_text(c), "^-+", ""))


def strip_emphasis(c: Column) -> Column:
    """Takes surrounding quotes, stars and underscores off, layer by layer,
    until none is left; marks on one side only stay."""
    # a layer takes one of the marks that the text begins with at least
    steps = F.sequence(F.lit(0), F.length(F.regexp_extract(c, r"""^[\s"'*_]*""", 0)))
    return strip(F.aggregate(steps, c, lambda x, _: F.regexp_replace(x, _SURROUNDED, "$1$2$3$4")))


def plural_of(c: Column) -> Column:
    """Lower-case plural: a few irregular nouns, else an s."""
    name = F.lower(c)
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR_PLURALS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.concat(name, F.lit("s")))


def strip_sub_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)^sub-?", "")


def normalize_term(c: Column) -> Column:
    """Lower case without one leading article that a word follows; null becomes empty."""
    return strip(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^(?:a|an|the)\s+(.+)$", "$1"))


def normalize_term_loose(c: Column) -> Column:
    """The twin for terms with many definitions: one article and one space, no further trimming."""
    return F.regexp_replace(strip(F.lower(c)), "^(?:the|an|a) ", "")


def normalize_fact(c: Column) -> Column:
    """For comparing facts: any quote becomes a double one, white space single, lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[“”‘’`]", '"'), r"\s+", " ")))


def same_question(proposed: Column, primary: Column) -> Column:
    """Whether a proposed question repeats the primary one: one contains the
    other, or, both being over 20 characters, over three quarters of the words of the larger
    set are common."""
    clean = lambda c: strip(F.regexp_replace(strip(F.lower(c)), r"\?+$", ""))
    p, q = clean(proposed), clean(primary)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    common = F.size(F.array_intersect(words(p), words(q)))
    overlap = common / F.greatest(F.size(words(p)), F.size(words(q)), F.lit(1))
    return q.contains(p) | p.contains(q) | ((F.length(p) > 20) & (F.length(q) > 20) & (overlap > 0.75))


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]*>", ""))


def attribute_key(c: Column) -> Column:
    """The last six characters in lower case, for keys made from a parent's id."""
    return F.lower(F.right(c, F.lit(6)))


def bracket_surplus(c: Column) -> Column:
    """Opening less closing square brackets."""
    n = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return n("[") - n("]")


def drop_unbalanced_brackets(c: Column) -> Column:
    """A lone leading [ or trailing ] goes where brackets don't balance."""
    surplus = bracket_surplus(c)
    return F.when((surplus > 0) & c.startswith("["), F.substr(c, F.lit(2))).when((surplus < 0) & c.endswith("]"), F.left(c, F.length(c) - 1)).otherwise(c)


def indent_of_identifier(c: Column) -> Column:
    """Depth of an identifier like /us/usc/t1/s2/a."""
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def file_size(c: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    return F.when(c < kb, F.format_string("%d B", c)).when(c < mb, F.format_string("%.1f KB", c / kb)).when(c < gb, F.format_string("%.1f MB", c / mb)).otherwise(F.format_string("%.1f GB", c / gb))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 3)), F.lit("...")))


def token_estimate(c: Column) -> Column:
    """A token for four characters."""
    return F.floor(F.length(c) / 4)


def cache_key(context: Column, prompt: Column, model: Column, max_tokens: Column) -> Column:
    """SHA-256 of a model call's parts, each under its heading."""
    head = lambda x: F.lit(f"\n\n---{x}---\n\n")
    return F.sha2(F.concat(F.coalesce(context, F.lit("")), head("QUERY"), F.coalesce(prompt, F.lit("")), head("MODEL"), F.coalesce(model, F.lit("")), head("MAX_TOKENS"), F.coalesce(max_tokens, F.lit(0)).cast("string")), 256)


def signature(*parts: Column) -> Column:
    """SHA-256 of a unit's fields joined by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts]), 256)


def parser_of_path(c: Column) -> Column:
    """The parser that a path hints at."""
    p = F.lower(c)
    return F.when(p.contains("uslm") | p.contains("usc"), "uslm").when(p.contains("cfr"), "cfr").when(p.contains("formex") | p.contains("eu"), "formex").when(p.contains("ca_"), "ca_html").otherwise("unknown")


def excerpt(c: Column, most: int = 6000) -> Column:
    """A text's beginning, with a mark where it was cut."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(" [...]"))).otherwise(c)


def oxford_list(items: Column, word: str = "and") -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    last = F.try_element_at(items, n)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.try_element_at(items, F.lit(1)))
        .when(n == 2, F.concat(F.try_element_at(items, F.lit(1)), F.lit(f" {word} "), last))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(f", {word} "), last))
    )


def filter_map(c: Column) -> Column:
    """'k=v,k=v' as a map."""
    return F.str_to_map(c, F.lit(","), F.lit("="))
