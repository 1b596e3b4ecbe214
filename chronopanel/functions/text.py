"""Text functions as column expressions: names, tokens, tickers, items, markup and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal suffixes that don't tell companies apart, and words that don't identify one.
SUFFIXES = ("INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LLC", "LP", "PLC", "SA", "NV", "AG", "GROUP", "HOLDINGS")
STOP_WORDS = ("the", "of", "and", "inc", "corp", "co", "company", "ltd", "plc", "group", "holdings")


def normal_ticker(c: Column) -> Column:
    """Upper case, dots and slashes as hyphens."""
    return F.translate(F.upper(F.trim(c)), "./", "--")


def normal_name(c: Column) -> Column:
    """Upper-case letters and digits, without a state suffix, a leading THE and trailing legal suffixes."""
    c = F.regexp_replace(F.upper(c), r"\s*/[A-Z]{2,3}/?\s*$", "")
    c = F.trim(F.regexp_replace(c, r"[^A-Z0-9]+", " "))
    c = F.regexp_replace(c, r"^THE ", "")
    return F.regexp_replace(c, rf"( ({'|'.join(SUFFIXES)}))+$", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def name_tokens(c: Column) -> Column:
    """Distinct identifying words, plurals without their s."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def names_agree(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def strip_markup(c: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; common entities resolved; single blanks."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def items(c: Column) -> Column:
    """Sorted distinct item numbers like 2.02 that follow the word Item."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)item\s+(\d\.\d{2})"), 1)))


def cashtags(c: Column) -> Column:
    """Ticker mentions of a text, upper-case: words of one to five letters after a dollar sign, in any case, and bare words
    of two to five letters in upper case. Which of them are tickers is for a join with the universe to say."""
    words = F.split(c, r"[^\p{L}\p{N}_$]+")
    return F.transform(F.filter(words, lambda w: w.rlike(r"^([A-Z]{2,5}|\$[A-Za-z]{1,5})$")), lambda w: F.upper(F.replace(w, F.lit("$"), F.lit(""))))


def seen_date(c: Column) -> Column:
    """YYYYMMDDTHHMMSSZ as ISO text; empty if it is anything else."""
    ok = c.rlike(r"^\d{8}T\d{6}Z$")
    t = F.try_to_timestamp(F.when(ok, F.regexp_replace(c, r"[TZ]", "")), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def first_of(c: Column, patterns: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Group 1 of the first pattern that matches, and that pattern's name."""
    value, name = F.lit(None).cast("string"), F.lit("none")
    for label, p in reversed(patterns):
        hit = F.regexp_extract(c, p, 1)
        value, name = F.when(hit != "", hit).otherwise(value), F.when(hit != "", F.lit(label)).otherwise(name)
    return value, name


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a share; null if n is 0."""
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    return F.when(n > 0, (mid - half) / d), F.when(n > 0, (mid + half) / d)


def rule_hit(text: Column, pattern: str, before: int = 3, after: int = 0, negations: str = "no|not|never|without") -> Column:
    """Whether a text has a match of pattern (case ignored) without a negation among the ``before`` words ahead of it and
    the ``after`` words behind it."""
    word, gap = "[A-Za-z0-9]+", "[^A-Za-z0-9]+"
    if before:
        text = F.regexp_replace(text, rf"(?i)(^|[^A-Za-z0-9])({negations})({gap}{word}){{0,{before - 1}}}{gap}({pattern})", " ")
    if after:
        text = F.regexp_replace(text, rf"(?i)({pattern})[A-Za-z0-9]*({gap}{word}){{0,{after - 1}}}{gap}({negations})($|[^A-Za-z0-9])", " ")
    return text.rlike(f"(?i)({pattern})")


def classified(text: Column, rules: list[tuple[int, str, str, bool]], windows: dict[str, tuple[int, int]] | None = None) -> Column:
    """Label of a text under frozen rules (rank, label, pattern, abstain only): abstain if an abstain-only rule hits or none
    does; else the label of the least rank that hits, conflict if it has several. ``windows``: by label, the words before
    and after a match in which a negation undoes it (default: 3 and 0)."""
    hits = [(rank, label, rule_hit(text, pattern, *(windows or {}).get(label, (3, 0))), only) for rank, label, pattern, only in rules]
    stop = F.lit(False)
    for _, _, hit, only in hits:
        stop = stop | hit if only else stop
    out = F.lit("abstain")
    for rank in sorted({h[0] for h in hits if not h[3]}, reverse=True):
        labels = F.array_distinct(F.array_compact(F.array(*[F.when(hit, F.lit(label)) for r, label, hit, only in hits if r == rank and not only])))
        out = F.when(F.size(labels) > 1, "conflict").when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise(out)
    return F.when(stop, "abstain").otherwise(out)


def person_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))


def merged_persons(rows: DataFrame) -> DataFrame:
    """(name, n, roles, n_stripped) of rows (raw, age, role) by normal name. A two-digit tail of a name is taken for an age
    and stripped only if the row's own age says so, or if the name is known without it from another row."""
    tail, bare = F.col("raw").rlike(" [0-9][0-9]$"), F.regexp_replace("raw", " [0-9][0-9]$", "")
    keyed = rows.select("*", tail.alias("__tail"), person_key(bare).alias("__bare"))
    known = keyed.where(~F.col("__tail")).select(F.col("__bare").alias("__known")).distinct()
    keyed = keyed.join(known, F.col("__bare") == F.col("__known"), "left")
    seen = F.coalesce(F.substring("raw", -2, 2) == F.col("age"), F.lit(False))
    keyed = keyed.withColumn("__strip", F.col("__tail") & (seen | F.col("__known").isNotNull()))
    name = F.when(F.col("__strip"), F.col("__bare")).otherwise(person_key(F.col("raw")))
    return keyed.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count_if("__strip").alias("n_stripped"))


# Fixed patterns: where a percentage of a class stands, in order of trust, and the former one of an amendment.
PERCENT_NOW = [("tag", r"(?i)<percentofclass>\s*([0-9]+(?:\.[0-9]+)?)\s*</percentofclass>"), ("label", r"(?i)percent of class[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)\s*%"), ("narrative", r"(?i)represent(?:s|ing) ([0-9]+(?:\.[0-9]+)?)\s*% of")]
PERCENT_BEFORE = r"(?i)previously[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)\s*%"


def percent_of_class(text: Column, is_amendment: Column) -> tuple[Column, Column, Column]:
    """Percentage now, the kind of place it was found in (none if nowhere), and that before, for amendments only. Numbers
    over 100 are nobody's share and count as not found."""
    value, source = first_of(text, PERCENT_NOW)
    clean = lambda c: F.when(c.cast("double") <= 100, c.cast("double"))
    now = clean(value)
    before = clean(F.nullif(F.regexp_extract(text, PERCENT_BEFORE, 1), F.lit("")))
    return now, F.when(now.isNotNull(), source).otherwise("none"), F.when(is_amendment, before)


def offer_price(text: Column) -> tuple[Column, Column]:
    """Price per share and how sure it is: exact at its anchor, low for any other amount, none for a range, a draft with an
    open amount, or an example."""
    amount = r"\$([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
    refused = text.rlike(rf"(?i)between {amount} and|\$\[|for example|hypothetical")
    at, loose = F.regexp_extract(text, rf"(?i)price of {amount} per share", 1), F.regexp_extract(text, amount, 1)
    kind = F.when(refused, "none").when(at != "", "exact").when(loose != "", "low").otherwise("none")
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).cast("double")
    return F.when(kind == "exact", number(at)).when(kind == "low", number(loose)), kind
